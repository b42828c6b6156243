"""The similarity of many pairs equals that of the standard library, pair by pair."""

import difflib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import blocks, names


def _pairs(n: int, letters: str, longest: int, seed: int):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(0, longest)))

    def near(x: str) -> str:
        cut = r.randint(0, len(x))
        return x[:cut] + word()[: r.randint(0, 3)] + x[cut + r.randint(0, 2) :]

    a = [word() for _ in range(n)]
    return a, [near(x) if r.random() < 0.6 else word() for x in a]


def _expected(a, b):
    return np.array([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@pytest.mark.parametrize("letters, longest", [("ab", 12), ("abcdefghijklmnopqrstuvwxyz", 20), ("aé日𝄞 ", 30), ("abc", 64), ("abcdef", 90), ("ab", 260)])
def test_equal_to_difflib(letters, longest):
    a, b = _pairs(300 if longest > 64 else 3000, letters, longest, longest)
    assert (blocks.ratios(a, b) == _expected(a, b)).all()


def test_empty_and_equal_names():
    assert blocks.ratios([], []).tolist() == []
    assert blocks.ratios(["", "", "a", "x" * 64, "x" * 65], ["", "a", "", "x" * 64, "x" * 65]).tolist() == [1.0, 0.0, 0.0, 1.0, 1.0]


def test_bounds_lose_no_pair():
    a, b = _pairs(20_000, "abcdefghij", 18, 5)
    whole, bounded = blocks.ratios(a, b), blocks.ratios(a, b, names.CUTOFF)
    left_out = np.isnan(bounded)
    assert left_out.any() and (whole[left_out] < names.CUTOFF).all() and (bounded[~left_out] == whole[~left_out]).all()


def test_many_pairs_are_ten_times_faster():
    a, b = _pairs(200_000, "abcdefghijklmnopqrstuvwxyz", 24, 7)
    t = time.perf_counter()
    got = blocks.ratios(a, b)
    fast = time.perf_counter() - t
    t = time.perf_counter()
    expected = _expected(a[:20_000], b[:20_000])
    slow = 10 * (time.perf_counter() - t)
    print(f"{fast:.2f} s, pair by pair {slow:.2f} s")
    assert (got[:20_000] == expected).all()
    assert fast * 3 < slow  # about ten times on an idle machine


def test_as_columns(spark):
    rows = [("manchesterunited", "manchesterunitd"), ("abc", None), (None, None), ("", ""), ("arsenal", "chelsea")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", names.similarity("a", "b").alias("r"), names.similarity_from(names.CUTOFF)("a", "b").alias("c")).collect()
    for x, y, r, c in got:
        want = None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
        assert r == want and c == (want if want is not None and want >= names.CUTOFF else None)
    assert df.where(F.col("a").isNull()).select(names.similarity("a", "b")).first()[0] is None
