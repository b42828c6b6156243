import random

import pytest

WORDS = "the of and to in is on by with edrest thint anouhe onerst esand lyin hathe ".split()


@pytest.fixture(scope="session")
def corpus():
    """Documents with every odd case: nulls, empties, long texts, ties, repeated rows, near and exact copies."""
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", "x", "é"]) for _ in range(n))
    rows = [(k, text(rnd.randint(1, 80)) + ("\n" + text(12) if k % 3 else "")) for k in range(60)]
    base = text(60)
    rows += [(100 + k, " ".join(w for j, w in enumerate(base.split()) if j != k * 7)) for k in range(8)]
    rows += [(120, base), (121, base), (122, base.upper()), (123, base + " tail")]
    rows += [(130, None), (131, ""), (132, " \n\t "), (133, "one two"), (134, "one two"), (135, "ONE  two\n")]
    rows += [(140, text(20000)), (141, "x" * 5000), (142, "a\x00b \x01 ▁ 😀 里\n\n  b  ")]
    rows += [(150, "same row"), (150, "same row"), (None, "no id here"), (None, None)]
    return rows


#: Columns named like those that the operators use or add.
CLASH = ["spans", "hits", "items", "ids", "decoded", "removed", "doc", "tie", "block", "chunk", "kind", "key", "n", "score", "stats", "first", "n_words", "label"]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame([(i, t, None, "src0", None) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(CLASH):
        df = df.selectExpr("*", f"{k} AS {c}")
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
