"""Duplicates: full, first of a subset, all of a repeated key, and same-day conflicts of a team."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def keep_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row of each ``subset`` by ``order``, which must be unique within it."""
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_same_day_conflicts(matches: DataFrame) -> DataFrame:
    """Leaves out every match of a team that plays twice on one day."""
    sides = matches.select(F.explode(F.array("home_key", "away_key")).alias("team"), "d")
    clash = repeated_keys(sides, ["team", "d"]).select("team", "d")
    for side in ("home_key", "away_key"):
        matches = matches.join(clash.withColumnRenamed("team", side), [side, "d"], "left_anti").select(*matches.columns)
    return matches
