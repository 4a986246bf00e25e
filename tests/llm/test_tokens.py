"""BPE, counts, packing and token files against the library itself."""

import copy
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeweave.llm import bpe, dac, packing, tokens

WORD, BYTE = bpe.vocabulary("word_bpe_49k.json"), bpe.vocabulary("byte_bpe_50k.json")


def library_ids(path, texts):
    return [e.ids for e in bpe.library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def strange():
    r = random.Random(1)
    return ["".join(r.choice("ab Ac'é\n\t<|endoftext|>12!. ́s_*") for _ in range(r.randint(0, 40))) for _ in range(1500)]


@pytest.mark.parametrize("merge", [bpe.merge_by_pair_index, bpe.merge_by_rank_rounds])
def test_merging_words_equals_the_library_on_texts(strange, texts, merge):
    corpus = strange + [t or "" for t in texts]
    words = sorted({w for t in corpus for w in bpe.words_of(t)})
    known = dict(zip(words, bpe.encode_words(WORD, words, merge), strict=True))
    for t, want in zip(corpus, library_ids(WORD, corpus), strict=True):
        assert [i for w in bpe.words_of(t) for i in known[w].tolist()] == want


@pytest.mark.parametrize("path, encoder", [(WORD, bpe.WordEncoder), (BYTE, bpe.SpacedEncoder)])
def test_encoders_equal_the_library(strange, texts, path, encoder):
    corpus = strange + [t or "" for t in texts]
    made = encoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in made(corpus)] == library_ids(path, corpus)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_letters_of_every_symbol_merge_to_it(path):
    """So words may be merged by the ranks of symbols instead of those of pairs."""
    own = copy.copy(bpe.merges(path))
    special = {t.content for t in bpe.library(path).get_added_tokens_decoder().values()}
    for suffix in {own.suffix, ""}:
        named = {t: i for t, i in own.vocab.items() if t not in special and (own.suffix != "" and t.endswith(own.suffix)) == (suffix != "")}
        own.suffix = suffix
        ids, counts = bpe.merge_by_rank_rounds(own, [t.removesuffix(suffix) for t in named])
        assert set(counts.tolist()) == {1} and ids.tolist() == list(named.values())
        own.suffix = bpe.merges(path).suffix


def test_ready_words_by_ranks_equal_the_library():
    r = random.Random(33)
    letters = "abcdeghinorstuyßéüñÄÖZQ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) + r.choice(["", "", ".", ",!!", "%%%", "\0", "1"]) for _ in range(3000)] + ["\0", "a\0b", "'s", "it's", "A" * 300]
    got = bpe.WordEncoder(WORD)(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library_ids(WORD, words)


def test_new_spaced_words_are_encoded_together(monkeypatch):
    """One call of the faster library for all words that a run of texts brings, odd ones apart, with the ids of each."""
    r = random.Random(34)
    letters = "aeinrst é日🙂'.,!1\n\t\x85\xa0\u2028\u200b\x1f\x00Ġ"
    made = bpe.SpacedEncoder(BYTE)
    calls = []
    encode = made.words.encode_ordinary
    monkeypatch.setattr(made, "words", type("", (), {"encode_ordinary": staticmethod(lambda text: calls.append(text) or encode(text))}))
    for corpus in ([" " + " ".join("".join(r.choice(letters[:7]) for _ in range(r.randint(1, 9))) for _ in range(200)) for _ in range(5)], ["  ", " \n \n", " <|endoftext|> a"]):
        calls.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in made(corpus)] == library_ids(BYTE, corpus)
        assert len(calls) == 1
    corpus = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in made(corpus)] == library_ids(BYTE, corpus)


def test_long_words_by_changed_places_only():
    r = random.Random(31)
    words = ["".join(r.choice("aeinrst") for _ in range(n)) for n in (63, 64, 65, 66, 200, 1000, 30_000)] + ["a" * 500, "ab" * 333, "the" * 100, "x"]
    merges = bpe.merges(WORD)
    one, two = bpe.merge_by_rank_rounds(merges, words), bpe.merge_by_pair_index(merges, words)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()
    assert one[1].tolist() == [len(i) for i in library_ids(WORD, words)]


def test_texts_without_spaces_take_time_in_proportion_and_bounded_memory(spark):
    import time

    r = random.Random(32)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    start = time.time()
    counts = bpe.merge_by_rank_rounds(bpe.merges(WORD), [word])[1]
    assert counts.tolist() == [len(library_ids(WORD, [word])[0])] and time.time() - start < 60
    memory = bpe.Remembered(lambda words: [len(w) for w in words])
    for i in range(300):
        assert memory.look([["日本" * 20_000 + str(i)]]) == [[40_000 + len(str(i))]]
    assert sum(map(len, memory)) + sum(map(len, memory.older)) < 3 * bpe.LONG_LETTERS
    texts = [word[i : i + 50_000] for i in range(0, 400_000, 50_000)] + ["日本語のテキスト" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(ids) for i, ids in enumerate(library_ids(WORD, texts))}
    assert {x.doc_id: x.n_tokens for x in tokens.token_counts(df, WORD).collect()} == want
    assert {x.doc_id: x.n_tokens for x in tokens.encode_decode(df, WORD).collect()} == want


def test_forgetting_changes_nothing(texts):
    corpus = [t or "" for t in texts]
    small = bpe.WordEncoder(WORD)
    small.memory.limit = 40
    want = library_ids(WORD, corpus)
    for t, ids in zip(corpus, want, strict=True):
        assert np.frombuffer(small([t])[0], "<u4").tolist() == ids


def test_workers_give_back_what_other_operators_remembered(spark, docs):
    import gc

    import pyarrow as pa

    from lakeweave.llm import common, pii

    def left(batches):
        common.keep_only()
        rows = sum(b.num_rows for b in batches)
        caches = (bpe.spaced_encoder, bpe.library, bpe.merges, bpe.same_by_ranks, pii._shape)
        n = sum(c.cache_info().currsize for c in caches) + len(pii._BROUGHT) + sum(isinstance(x, bpe.SpacedEncoder) for x in gc.get_objects())
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows]), "n": pa.array([n])})

    for run in (lambda: packing.pack(docs, BYTE), lambda: pii.redact(docs)):
        run().count()
        found = spark.range(0, 1000, 1, 8).mapInArrow(left, "rows long, n long").collect()
        assert sum(x.rows for x in found) == 1000 and sum(x.n for x in found) == 0


def test_encode_decode(docs, rows, none):
    got = tokens.encode_decode(docs, WORD, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    lib = bpe.library(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, ids) for (d, _), ids in zip(rows, library_ids(WORD, [t for _, t in rows]), strict=True)]
    full = Counter((d, len(i), tuple(i), lib.decode(i, skip_special_tokens=False), sha(" ".join(map(str, i))), sha(lib.decode(i, skip_special_tokens=False))) for d, i in want)
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in got) == full
    assert tokens.encode_decode(none, WORD).count() == 0


def test_counts(docs, rows, none):
    got = Counter(tuple(r) for r in tokens.token_counts(docs, WORD, limit=50).collect())
    n = [len(i) for i in library_ids(WORD, [t for _, t in rows])]
    assert got == Counter((d, len((t or "").encode()), k, k > 50) for (d, t), k in zip(rows, n, strict=True))
    assert tokens.token_counts(none, WORD).count() == 0


@pytest.mark.parametrize("windows", [1, 3, 16])
def test_packing(docs, rows, windows):
    got = packing.pack(docs, BYTE, window=64, open_windows=windows).collect()
    check_pieces(got, rows, 64)


def check_pieces(got, rows, window):
    want = Counter((d, len(i) + 1) for (d, _), i in zip(rows, library_ids(BYTE, [t for _, t in rows]), strict=True))
    texts = {}
    for (d, _), i in zip(rows, library_ids(BYTE, [t for _, t in rows]), strict=True):
        texts.setdefault((d, len(i) + 1), []).append([*i, 1])
    sums = Counter()
    sequences = {}
    for p in got:
        assert any(crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in texts[p.doc_id, p.doc_tokens])
        assert np.frombuffer(bytes(p.ids), "<u4").size == p.length > 0
        sums[p.doc_id, p.doc_tokens] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sums == Counter({k: n * k[1] for k, n in want.items()})
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_packing_nothing(none):
    assert packing.pack(none, BYTE).count() == 0


def test_token_files(spark, docs, rows, tmp_path, none):
    dac.write_tokens(docs, WORD, str(tmp_path / "t"))
    got = dac.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    order = sorted(zip(rows, library_ids(WORD, [t for _, t in rows]), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    assert [r.doc_id for r in got] == [d for (d, _), _ in order]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, (*i, 1)) for (d, _), i in order)
    dac.write_tokens(none, WORD, str(tmp_path / "e"))
    assert dac.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70000, 7)), [300] * 1025])
def test_any_id_is_read_alone(ids):
    codes = dac.Codes(dac.encode(np.array(ids, dtype=np.uint32)))
    assert len(codes) == len(ids)
    r = random.Random(2)
    for i in {0, len(ids) - 1, *(r.randrange(len(ids)) for _ in range(200) if ids)}:
        if 0 <= i < len(ids):
            assert codes[i] == ids[i]
    for _ in range(30):
        a = r.randint(0, len(ids))
        b = r.randint(a, len(ids))
        assert codes.slice(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        codes[len(ids)]
