"""Kept ratings equal a full build after increments, late, changed and withdrawn matches; a run that dies changes nothing."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from touchline.catalog import features
from touchline.operators import rating
from touchline.params import Params
from touchline.plans import ratings
from touchline.sources import releases

CELLS = [(0, 10.0, 3.0, 0.0), (1, 10.0, 3.0, 0.5)]
P = Params(elo_burn_in_end=date(1996, 1, 1), elo_newcomer_pool=4)


def _same(spark, root, rows, grid, params=P, burn_in=True):
    want = {(r["cfg"], r["match_id"]): tuple(r)[4:] for r in rating.run(rows, grid, params, burn_in).collect()}
    got = [r for r in ratings.rated(spark, root).collect()]
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[4:] == pytest.approx(want[r["cfg"], r["match_id"]], abs=1e-12)


@pytest.fixture(scope="module")
def rows(spark, small):
    out = rating.engine_rows(features._clean(spark, small), features._countries(spark, small)).persist()
    yield out
    out.unpersist()


def _until(rows, year, month=1):
    return rows.where(F.col("day") < (date(year, month, 1) - date(1970, 1, 1)).days)


def test_increments_equal_a_full_build(spark, rows, tmp_path):
    root, grid = str(tmp_path / "log"), spark.createDataFrame(CELLS, rating.GRID)
    late = _until(rows, 1998, 3).orderBy(F.desc("day")).first()["match_id"]
    first = ratings.update(_until(rows, 1997).where(F.col("match_id") != late), root, grid, P)
    assert first["from"] is not None
    # a season more, one match of it missing
    assert ratings.update(_until(rows, 1999, 6).where(F.col("match_id") != late), root, grid, P)["from"] == 199701
    # the missing match, late
    assert ratings.update(_until(rows, 1999, 6), root, grid, P)["from"] in (199802, 199801, 199712)
    _same(spark, root, _until(rows, 1999, 6), grid)
    # the rest
    assert ratings.update(rows, root, grid, P)["from"] == 199906
    _same(spark, root, rows, grid)
    used = ratings.manifest(spark, root)
    assert len(set(used["months"].values())) == 4
    assert ratings.update(rows, root, grid, P) == {"version": used["version"], "from": None}


def test_changes_withdrawals_and_other_runs(spark, rows, tmp_path):
    root, grid = str(tmp_path / "log"), spark.createDataFrame(CELLS[:1], rating.GRID)
    early = _until(rows, 1997)
    ratings.update(early, root, grid, P)
    # withdrawn months
    assert ratings.update(_until(rows, 1996, 9), root, grid, P)["from"] == 199609
    _same(spark, root, _until(rows, 1996, 9), grid)
    # a score that was wrong
    changed = early.withColumn("score", F.when(F.col("day") >= (date(1996, 11, 1) - date(1970, 1, 1)).days, 1 - F.col("score")).otherwise(F.col("score")))
    assert ratings.update(changed, root, grid, P)["from"] == 199609
    _same(spark, root, changed, grid)
    # before the burn-in's end, other parameters, other runs: all anew
    least = min(int(m) for m in ratings.manifest(spark, root)["months"])
    assert ratings.update(early.where(F.col("day") >= (date(1995, 6, 1) - date(1970, 1, 1)).days), root, grid, P)["from"] >= least
    fewer = Params(elo_burn_in_end=date(1996, 1, 1), elo_newcomer_pool=9)
    assert len(set(ratings.manifest(spark, root)["months"].values())) == 1
    ratings.update(early, root, grid, fewer)
    _same(spark, root, early, grid, fewer)
    ratings.update(early, root, spark.createDataFrame(CELLS, rating.GRID), fewer, burn_in=False)
    _same(spark, root, early, spark.createDataFrame(CELLS, rating.GRID), fewer, False)


def test_a_run_that_dies_changes_nothing(spark, rows, tmp_path, monkeypatch):
    root, grid = str(tmp_path / "log"), spark.createDataFrame(CELLS[:1], rating.GRID)
    ratings.update(_until(rows, 1996), root, grid, P)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(releases, "point", dies)
        ratings.update(_until(rows, 1996, 6), root, grid, P)
    _same(spark, root, _until(rows, 1996), grid)
    ratings.update(_until(rows, 1996, 6), root, grid, P)
    _same(spark, root, _until(rows, 1996, 6), grid)


def test_no_matches(spark, rows, tmp_path):
    root, grid = str(tmp_path / "log"), spark.createDataFrame(CELLS, rating.GRID)
    with pytest.raises(FileNotFoundError):
        ratings.rated(spark, root)
    assert ratings.update(rows.limit(0), root, grid, P)["from"] is None
    assert ratings.rated(spark, root).count() == 0
    ratings.update(_until(rows, 1995), root, grid, P)
    _same(spark, root, _until(rows, 1995), grid)
