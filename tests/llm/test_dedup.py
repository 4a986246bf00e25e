"""Suffix arrays, exact substring deduplication, SimHash and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lakeweave.llm import components, dedup, jaccard, merkle, simhash, suffix


def thue_morse(a, b, n):
    """Two strings that hashes by powers modulo 2**64 do not tell apart."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_suffix_arrays_and_prefixes():
    r = random.Random(3)
    for _ in range(400):
        n, k = r.randint(0, 90), r.choice([1, 2, 3, 250])
        t = np.array([r.randrange(k) for _ in range(n)], dtype=np.int64)
        if n and r.random() < 0.3:
            t = np.tile(t[: r.randint(1, n)], r.randint(1, 6))
        own = t.tolist()
        sa = suffix.suffix_array(t).tolist()
        assert sa == sorted(range(len(own)), key=lambda i: own[i:])
        want = [0] * len(own)
        for a, b in zip(sa, sa[1:], strict=False):
            while a + want[b] < len(own) and b + want[b] < len(own) and own[a + want[b]] == own[b + want[b]]:
                want[b] += 1
        assert suffix.common_prefixes(t, np.array(sa, dtype=np.int64)).tolist() == want if own else True


def removed(rows, length):
    """Brute force: rows in order of id and checksum; every string seen before takes its bytes."""
    import zlib

    seen, out = set(), []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), len(b) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [36, 100])
def test_repeated_strings_go(docs, rows, length):
    got = dedup.remove_repeated(docs, length, ("n_bytes", "n_removed", "n_spans", "kept_sha256")).collect()
    assert Counter(map(tuple, got)) == removed(rows, length)


@pytest.mark.parametrize("hot", [1, 8, 10**6])
def test_hot_passages_are_split_and_still_whole(spark, hot):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(300)
    rows = [(i, word(r.randint(0, 90)) + passage[r.randint(0, 30) : 300 - r.randint(0, 30)] + word(r.randint(0, 90))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.remove_repeated(df, 100, ("n_bytes", "n_removed", "n_spans", "kept_sha256"), hot=hot).collect()
    assert Counter(map(tuple, got)) == removed(rows, 100)


def test_strings_that_plain_sums_of_powers_confuse(spark):
    head = "a shared head of some thirty letters"
    for i, (a, b) in enumerate(("ab", "xy", "eo", "q7")):
        x, y = thue_morse(a, b, 1024)
        rows = [(1, head + x), (2, head + y), (3, head + x)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for length, hot in ((1052, 2048), (1052, 1), (100, 2048), (100, 1)):
            got = dedup.remove_repeated(df, length, ("n_bytes", "n_removed", "n_spans", "kept_sha256"), hot=hot).collect()
            assert Counter(map(tuple, got)) == removed(rows, length), (a, b, length)
        if i:
            break


def test_very_long_texts(spark):
    r = random.Random(41)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    one, passage = word(400_000), word(5000)
    rows = [(1, one), (2, passage + word(100_000) + passage), (3, one[1000:300_000]), (4, "x" * 300_000), (5, None), (6, "")]
    got = dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 100, ("n_bytes", "n_removed", "n_spans", "kept_sha256")).collect()
    assert Counter(map(tuple, got)) == removed(rows, 100)


def test_pipeline_form_keeps_columns(docs, rows, none):
    out = dedup.without_repeated(docs, 100)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and sum(r.text is None for r in got) == sum(t is None for _, t in rows)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert dedup.without_repeated(none).count() == 0 and dedup.remove_repeated(none).count() == 0
    with pytest.raises(ValueError):
        dedup.remove_repeated(docs, 20)


def slow_fingerprint(t, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = sorted({slow_fingerprint(t) for _, t in rows})
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    at = {p: group[i] for i, p in enumerate(prints)}
    least = {}
    for d, t in rows:
        g = at[slow_fingerprint(t)]
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    return Counter((d, f"{slow_fingerprint(t):016x}", least[at[slow_fingerprint(t)]]) for d, t in rows)


def test_near_duplicates(docs, rows, none):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == slow_components(rows)
    assert simhash.near_duplicates(none).count() == 0


def test_null_ids_do_not_name_a_component(spark):
    text = " ".join(f"w{i}" for i in range(200))
    near = next(t for k in range(200) for t in [text.replace(f"w{k} ", "", 1)] if 0 < bin(slow_fingerprint(t) ^ slow_fingerprint(text)).count("1") <= 3)
    other = "quite another text " * 5
    rows = [(None, text), (7, near), (9, near), (None, other), (None, other), (11, None), (11, text)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == slow_components(rows)
    assert {r.component_id for r in got if r.doc_id in (7, 9)} == {7}


def test_large_buckets_are_split_and_still_whole(spark):
    r = random.Random(21)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 400:
        values.add(r.choice(sorted(values)[:50]) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")

    def classes(pairs):
        group = {v: {v} for v in values}
        for a, b in pairs:
            ga, gb = group[a % 2**64], group[b % 2**64]
            if ga is not gb:
                ga |= gb
                for x in gb:
                    group[x] = ga
        return {frozenset(g) for g in group.values()}

    want = classes([(a, b) for a in values for b in values if bin(a ^ b).count("1") <= 3])
    assert classes(simhash.links(df, 3, split=5).collect()) == want == classes(simhash.links(df, 3).collect())


def test_masks_cover_every_set_of_three_bits():
    masks = simhash.covering_masks(3)
    r = random.Random(6)
    for _ in range(3000):
        bits = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not m & bits for m in masks)


def test_links_connect_what_is_near():
    r = random.Random(2)
    values = set()
    for _ in range(5):
        x = r.getrandbits(64)
        for _ in range(80):
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    own = np.array(sorted(values), dtype=np.uint64)

    def sets(pairs):
        group = {v: v for v in values}
        for a, b in pairs:
            old, new = group[a], group[b]
            group = {k: new if g == old else g for k, g in group.items()}
        out = {}
        for k, g in group.items():
            out.setdefault(g, set()).add(k)
        return sorted(map(sorted, out.values()))

    full = [(int(a), int(b)) for a in own for b in own[np.bitwise_count(own ^ a) <= 3]]
    assert sets(simhash.linked(own, 3, 2**64 - 1)) == sets(full) == sets(simhash.linked(own, 3, 2**64 - 1, compared=4))


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in components.components(df).collect()}
    group = {}
    for a, b in edges:
        if a != b:
            ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
            if ga is not gb:
                ga |= gb
                for x in gb:
                    group[x] = ga
    assert got == {n: min(g) for n, g in group.items()}
    assert components.components(df.limit(0)).count() == 0


def test_components_in_one_task_and_by_steps(spark):
    r = random.Random(17)
    edges = [(x - 900, x - 899) for x in r.sample(range(300), 300)] + [(r.randint(0, 700), r.randint(0, 700)) for _ in range(300)] + [(2**63 - 1, -(2**63)), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    one, steps = (sorted((x.node, x.component) for x in components.components(df, gathered).collect()) for gathered in (600, 0))
    assert one == steps and len(dict(one)) == len(one) == len({x for a, b in edges if a != b for x in (a, b)})
    assert components.components(df.limit(0), 0).count() == components.components(df.limit(0)).count() == 0


def test_few_links_take_few_tasks(spark):
    """Each task of a small shuffle leaves files and events of its own: hundreds of partitions made more of them than of data."""
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    sc = spark.sparkContext
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(kept, ("20", "false"), strict=True):
        spark.conf.set(k, v)
    sc.setJobGroup("few links", "")
    try:
        assert {x.component for x in components.components(df).collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    assert 0 < tasks <= 100


def test_fingerprints_tell_edits(texts):
    own = [t or "" for t in texts]
    prints = merkle.fingerprints(own)
    assert len({(a, b) for a, b in zip(own, prints, strict=True)}) == len(set(own)) == len(set(prints))
    assert merkle.fingerprints([own[3]])[0] == prints[3]  # whatever stands beside it
    long = " ".join(own[:20])
    edited = long.replace("the", "xyz", 1)
    a, b = merkle.fingerprints([long, edited])
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1.0
    assert 1 <= len(merkle.differing(a, b)) <= 3 and merkle.differing(a, a) == []
    empty = merkle.fingerprints([""])[0]
    assert merkle.likeness(empty, empty) == 1.0 and merkle.likeness(empty, a) == 0.0


def test_roots_test_equality():
    for a, b in ("ab", "xy", "q7", "AZ", "eo"):
        x, y = thue_morse(a, b, 2048)
        one, two = merkle.fingerprints([x, y])
        assert one.split("/")[0] != two.split("/")[0] and merkle.likeness(one, two) < 1
    r = random.Random(17)
    lines = ["".join(r.choice("abcd\n") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    assert len(set(merkle.fingerprints(lines))) == len(set(lines))


def test_long_and_empty_texts(spark):
    texts = ["ab cd\n" * 300_000, "", None, "x" * 2_000_000, "\n" * 5000, "é" * 100_001]
    got = {r.doc_id: r for r in merkle.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t, u = t or "", texts[i - 1] or ""  # descending ids
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == edited)


def test_compare_with_next(docs, rows, none):
    got = merkle.compare_with_next(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    single = [(d, t) for d, t in rows if d is not None and sum(e == d for e, _ in rows) == 1]
    order = sorted(single, reverse=True, key=lambda x: x[0])
    by_id = {r.doc_id: r for r in got}
    sure = 0
    for (d, t), (e, u) in zip(order, order[1:], strict=False):
        between = [x for x, _ in rows if x is not None and e < x < d]
        if between:
            continue
        t, u = t or "", u or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        r = by_id[d]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = merkle.fingerprints([t, edited, u])
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a, b, merkle.likeness(a, b), merkle.likeness(a, c))
        sure += 1
    assert sure > 50 and merkle.compare_with_next(none).count() == 0


def test_lone_row_follows_itself(spark):
    r = merkle.compare_with_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def slow_groups(rows, least=0.8):
    """Brute force: groups of rows by steps of an exact five-word Jaccard similarity."""
    def of(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])

    sets = [of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and (a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j])):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_one_row_of_each_group_of_near_copies(spark, docs, rows, none):
    r = random.Random(12)
    text = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    made = []
    for i in range(30):  # copies with edits, a third of the ids null, an id with two texts
        w = text(r.randint(60, 200))
        for k in range(3):
            v = list(w)
            for _ in range(k and r.randint(1, 6)):
                v[r.randrange(len(v))] = "edited"
            made.append((None if (i + k) % 3 == 0 else 5000 + i if k < 2 else 5000 + (i + 1) % 30, " ".join(v)))
    made += [(None, "same without an id " * 9)] * 2
    base = text(80)
    for i in range(120):  # a large group, some only near others of it
        v = list(base if i % 3 else made[-1][1].split() if i > 3 else base)
        v[r.randrange(len(v))] = f"new{i}"
        made.append((9000 + i, " ".join(v)))
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    for df, own, together in ((docs, rows, 2000), (table, made, 2000), (table, made, 9)):
        got = jaccard.one_of_each(df, together=together)
        assert got.columns == df.columns
        group = slow_groups(own)
        best = {}
        for g, (d, t) in zip(group, own, strict=True):
            key = (d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())
            best[g] = min(best.get(g, key), key)
        assert Counter((x.doc_id is None, x.doc_id or 0, hashlib.md5((x.text or "").encode()).hexdigest()) for x in got.collect()) == Counter(best.values())
    assert jaccard.one_of_each(none).count() == 0


def at_threshold(seed, at=22):
    """Two texts of 45 shingles that share 40: a similarity of 0.8."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(49)]
    return " ".join(words), " ".join([*words[:at], "edited", *words[at + 1 :]])


def slow_best(rows, least=0.8):
    """The least id of each group, by brute force; texts without words aside."""
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(d for (d, _), x in zip(rows, label, strict=True) if x == y) for y in set(label))


def test_similar_sets_share_a_window():
    r = np.random.default_rng(5)
    for trial in range(3000):
        both, one, other = int(r.integers(1, 120)), 0, 0
        while 5 * both >= 4 * (both + one + other + 1) and r.random() < 0.98:
            one, other = (one + 1, other) if r.random() < trial % 5 / 4 else (one, other + 1)
        own = r.integers(0, 2**64, both + one + other, dtype=np.uint64)
        a, b = np.sort(own[: both + one]), np.sort(np.r_[own[:both], own[both + one :]])
        assert set(jaccard.windows(a).tolist()) & set(jaccard.windows(b).tolist())
        rows = [(0, i, i, len(x), jaccard.parity(x)) for i, x in enumerate((a, b))]
        assert len(jaccard.bounded(rows, 0.8)[0]) == 1
        assert jaccard.bounded([(0, 0, 7, len(a), jaccard.parity(a)), (0, 1, 7, len(b), jaccard.parity(b))], 0.8) == ([], [])
    a, b = (np.unique(r.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2))
    assert jaccard.bounded([(0, 0, 0, 300, jaccard.parity(a)), (0, 1, 1, 300, jaccard.parity(b))], 0.8) == ([], [])


def test_pairs_that_bands_and_fingerprints_miss(spark):
    rows = []
    for k, seed in enumerate((1390, 2024, 2932, 5672, 6927, 9236)):
        a, b = at_threshold(seed)
        assert not set(jaccard.bands(jaccard.shingles(a))) & set(jaccard.bands(jaccard.shingles(b)))
        assert (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > 3
        rows += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, a)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(x.doc_id for x in got.collect()) == slow_best(rows) == [0, 10, 20, 30, 40, 50]


def test_windows_of_very_many_sets_are_dealt_in_blocks(spark):
    r = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, common + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(6 if i % 2 else 60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard.sketches(df).withColumnRenamed("doc_id", "set")
    met = spark.createDataFrame([], "set long, candidate long")
    pairs = [{tuple(sorted(x)) for x in jaccard.missed(df, found, met, 5, 0.6, most).collect()} for most in (4096, 7)]
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert near and pairs[0] == pairs[1] >= near


def test_classes_of_different_leaders_are_linked(spark):
    """Two texts with many near copies, of which only one each is near the other's."""
    r = random.Random(21)
    new = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for _ in range(3):
        words = [new() for _ in range(90)]
        for k in range(4):  # two next to each other share 77 of 95 shingles, others less than 0.8
            rows.append((len(rows), " ".join(words)))
            for at in range(20) if k in (0, 3) else ():
                rows.append((len(rows), " ".join([*words[: 4 * at + 5], new(), *words[4 * at + 6 :]])))
            words[20 * k + 10 : 20 * k + 15] = [new() for _ in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for together in (2000, 8):
        assert sorted(x.doc_id for x in jaccard.one_of_each(df, together=together).collect()) == slow_best(rows) == [0, 44, 88]
