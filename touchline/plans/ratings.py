"""Ratings that are kept: a periodic run folds only the months that changed.

The log of a set of runs is a folder of versions. A version holds, in the order
of days, the rated matches and each team's state after the last day of a month,
for the months it folded; its manifest names the version of every other month and each month's
signature (rows and the sum of their hashes). ``update`` compares signatures,
takes the state after the last month before the first difference and folds from
there on. New, late, changed and withdrawn matches are all such differences. The
burn-in passes over its days several times, so a difference before its end, other
parameters or another grid fold everything.

The manifest is in use once the pointer names it (one rename), so a run that dies
leaves the log as it was, and readers of an older version keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict
from datetime import date
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.operators import rating
from touchline.params import DEFAULT, Params
from touchline.sources import releases

STATE = "cfg int, team string, country string, played long, elo double, start double"
LOG = f"kind string, month int, {rating.RATED}, {STATE.removeprefix('cfg int, ')}"
#: The day that rows of a saved state carry: before all others.
BEFORE_ALL = -(1 << 40)


def _month(day: np.ndarray) -> np.ndarray:
    """Days since 1970 as year and month, 199704."""
    months = np.asarray(day, "M8[D]").astype("M8[M]").astype(np.int64)
    return ((1970 + months // 12) * 100 + months % 12 + 1).astype(np.int32)


def _first_day(month: int) -> int:
    return (date(month // 100, month % 100, 1) - date(1970, 1, 1)).days


def _marked(days: Iterator[dict]) -> Iterator[dict]:
    """Days that know whether they are their month's last."""
    before = None
    for day in days:
        if before is not None:
            before["closes"] = _month(before["day"][:1]) != _month(day["day"][:1])
            yield before
        before = day
    if before is not None:
        before["closes"] = True
        yield before


def _wide(kind: str, month: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    fields = [(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in LOG.split(", ")]
    n = len(month)
    given = {"kind": pa.array([kind] * n, pa.string()), "month": pa.array(month)} | columns
    return pa.RecordBatch.from_arrays([given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in fields], names=[c for c, _ in fields])


def _state_batch(engine: rating.Engine, runs: list[int], month: int) -> pa.RecordBatch:
    state, k = engine.saved(), len(runs)
    none = [None] * k
    teams = len(state["team"])
    each = lambda c: pa.array([x for x in state[c] for _ in runs])
    spread = lambda c: pa.array([v for row in state[c] for v in (none if row is None else row)], pa.float64())
    columns = {"cfg": pa.array(runs * teams, pa.int32()), "team": each("team"), "country": each("country"), "played": each("played"), "elo": spread("elo"), "start": spread("start")}
    return _wide("state", np.full(teams * k, month, np.int32), columns)


def _state_of(batches: list[pa.RecordBatch], k: int) -> dict[str, list]:
    """Rows of a state, k for each team, as ``Engine.resume`` takes them."""
    t = pa.Table.from_batches(batches)
    every = {c: t.column(c).to_pylist() for c in ("home_key", "home_country", "played", "elo", "start")}
    rows = lambda c: [None if every[c][at] is None else every[c][at : at + k] for at in range(0, len(t), k)]
    return {"team": every["home_key"][::k], "country": every["home_country"][::k], "played": every["played"][::k], "elo": rows("elo"), "start": rows("start")}


def _folded(rows: DataFrame, grid: list[tuple], params: Params, burn_in: bool, state: DataFrame | None) -> DataFrame:
    """Rated matches and the states after each month, from ``state`` on or from the first day."""
    groups = [grid[k : k + rating.TOGETHER] for k in range(0, len(grid), rating.TOGETHER)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        own = groups[first.column(0)[0].as_py()]
        runs = [c[0] for c in own]
        engine = rating.Engine(np.array([c[1:] for c in own], float).reshape(len(own), 3), params)
        saved, left = [], []
        for b in chain([first], batches):
            n = int((b.column("day").to_numpy() == BEFORE_ALL).sum())
            if n:
                saved.append(b.slice(0, n))
            if n < b.num_rows:
                left = [b.slice(n)]
                break
        if saved:
            engine.resume(_state_of(saved, len(own)))
        held = []
        for day, after in rating._fold(engine, _marked(rating._days(chain(left, batches), rating.INPUT)), params, burn_in and not saved):
            held.append((day, after))
            if day["closes"]:
                b = rating._rated_batch(held, runs)
                yield _wide("rated", _month(b.column("day").to_numpy()), dict(zip(b.schema.names, b.columns)))
                yield _state_batch(engine, runs, int(_month(day["day"][:1])[0]))
                held = []

    group = F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("group")
    every = rows.select(group, *rating.INPUT)
    if state is not None:
        place = F.element_at(F.create_map(*[F.lit(x) for k, own in enumerate(groups) for c in own for x in (c[0], k)]), F.col("cfg"))
        told = state.select(
            place.alias("group"), F.col("cfg").cast("long").alias("match_id"), F.lit(BEFORE_ALL).cast("long").alias("day"), F.col("team").alias("home_key"), F.col("country").alias("home_country"), "played", "elo", "start"
        )
        every = every.unionByName(told, allowMissingColumns=True)
    return every.repartitionById(len(groups), "group").sortWithinPartitions("group", "day", "home_key", "match_id").mapInArrow(fold, LOG)


def _signatures(rows: DataFrame) -> dict[int, list]:
    """Rows and the sum of their hashes by month; as many as the history has months."""
    month = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyyMM").cast("int")
    told = rows.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rating.INPUT).cast("decimal(38,0)")).cast("string").alias("hashes"))
    return {r["month"]: [r["n"], r["hashes"]] for r in told.collect()}


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is in use: the runs, and version and signature of each month."""
    place = releases.current(spark, root)
    return None if place is None else json.loads(spark.read.text(f"{place}/manifest", wholetext=True).first()[0])


def _read(spark: SparkSession, root: str, kind: str, schema: str, months: dict[str, str]) -> DataFrame:
    """One scan of the versions' folders, each cut to the months that it stands for."""
    spans: dict[str, list[int]] = {}
    for month, version in months.items():
        spans.setdefault(version, []).append(int(month))
    if not spans:
        return spark.createDataFrame([], schema)
    base = f"{root.rstrip('/')}/log"
    df = spark.read.schema(f"{schema}, month int, version string").option("basePath", base).parquet(*[f"{base}/version={v}/kind={kind}" for v in spans])
    # a later version takes over all months from its first on, so what a version still stands for is one span
    used = [(F.col("version") == v) & F.col("month").between(min(own), max(own)) for v, own in spans.items()]
    return df.where(reduce(or_, used)).select(*[x.split()[0] for x in schema.split(", ")])


def rated(spark: SparkSession, root: str) -> DataFrame:
    """All rated matches of the log, as ``rating.run`` gives them."""
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"no ratings in {root}")
    return _read(spark, root, "rated", rating.RATED, m["months"])


def update(rows: DataFrame, root: str, grid: DataFrame, params: Params = DEFAULT, burn_in: bool = True) -> dict:
    """Brings the log to the state of ``rows`` (all matches, see ``rating.engine_rows``).

    Returns ``{"version", "from"}``: the version in use and the first month that was folded, None where nothing changed.
    """
    spark = rows.sparkSession
    # the grid is a literal of a few dozen rows
    literal = [[r["cfg"], r["k"], r["uefa_mult"], r["market_weight"]] for r in grid.orderBy("cfg").collect()]
    runs = {"grid": literal, "params": json.loads(json.dumps(asdict(params), default=str)), "burn_in": burn_in}
    now = _signatures(rows)
    old = manifest(spark, root)
    known = old is not None and old["runs"] == runs
    before = {int(m): s for m, s in old["signatures"].items()} if known else {}
    differ = sorted(m for m in now.keys() | before.keys() if now.get(m) != before.get(m))
    if known and not differ:
        return {"version": old["version"], "from": None}
    start = differ[0] if differ else None
    kept = sorted(m for m in before if start is not None and m < start)
    if not kept or (burn_in and _first_day(start) < rating.burn_in_end(params)):
        start, kept, state = min(now, default=None), [], None
    else:
        state = _read(spark, root, "state", STATE, {str(kept[-1]): old["months"][str(kept[-1])]})
        rows = rows.where(F.col("day") >= _first_day(start))
    version = f"v{(int(old['version'][1:].split('-')[0]) if old else 0) + 1:06d}-{uuid.uuid4().hex[:8]}"
    place = f"{root.rstrip('/')}/{version}"
    if literal:
        _folded(rows, [tuple(x) for x in literal], params, burn_in, state).write.partitionBy("kind").mode("overwrite").parquet(f"{root.rstrip('/')}/log/version={version}")
    months = {str(m): old["months"][str(m)] for m in kept} | {str(m): version for m in sorted(now) if m not in kept and literal}
    told = {"version": version, "runs": runs, "months": months, "signatures": {str(m): s for m, s in sorted(now.items())}}
    spark.createDataFrame([(json.dumps(told),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{place}/manifest")
    releases.point(spark, root, version)
    return {"version": version, "from": start}
