import random

import pytest

#: Documents with every oddity that the operators must bear.
ODD = [None, "", " ", "\n\n", "one", "a b", "Ünïcödé ﬁ ½ é́ 日本語 🙂🙂", "x" * 5000, "don't I'LL <|endoftext|>x <|startoftext|>", "mail a.b@c.de or +1 (437) 555-0118, 10.0.0.1, 4111111111111111", "\x1c\x1d a\x1eb\x00c"]


@pytest.fixture(scope="session")
def texts():
    """Random prose with shared passages, copies and near copies."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "the", "in", "é", "ou", "st", "re"]) for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(15, 90))) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(1, 120)))]
        parts += [r.choice(passages)[r.randint(0, 40) :] for _ in range(r.randint(0, 2))]
        out.append(".\n".join(parts))
    out += [out[0], out[1], out[0], out[2].replace("the", "THE", 1), out[3] + " end"]
    return out + ODD


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table: extra columns with names that operators use inside, repeated rows, a null id, ids out of order."""
    rows = [((i * 37) % 1009, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (rows[7][0], "another text of the same id " * 9), (None, "no id here " * 12), (None, None)]
    random.Random(8).shuffle(rows)
    df = spark.createDataFrame([(*row, "l", "s", 1, "h", 2, "k", b"b", 3, 4) for row in rows], "doc_id long, text string, lang string, source string, n_chars long, home string, to int, kind string, blob binary, fp int, bucket int")
    return df.repartition(5)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
