"""Raw tables to the standard match, appearance, valuation and player tables."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.functions.scalar import first_valid_odds, lookup, mixed_date, not_in, number, result, round_class, season_start
from touchline.schemas import APPEARANCE, MATCH, PLAYER, VALUATION
from touchline.sources.leagues import COUNTRY_CODES, COVERED, EXTRA_LEAGUES, MAIN_LEAGUES, ODDS_PREFIXES, UEFA_MAIN, UEFA_QUALIFYING, tier as tier_of
from touchline.sources.readers import by_file_name, csv, file_heads, with_columns

UEFA = UEFA_MAIN + UEFA_QUALIFYING
_STATS = {"fouls": "F", "yellow": "Y", "red": "R", "shots": "S", "sot": "ST"}


def _text(df: DataFrame, name: str):
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def _odds(df: DataFrame, prefixes=ODDS_PREFIXES):
    there = {p: tuple(number(_text(df, f"{p}{x}")) for x in "HDA") for p in prefixes if all(f"{p}{x}" in df.columns for x in "HDA")}
    none = F.lit(None).cast("struct<home:double,draw:double,away:double,type:string>")
    return first_valid_odds(there) if there else none


def _finished(df: DataFrame, first_season: int) -> DataFrame:
    df = df.na.drop(subset=["date", "home_team", "away_team", "home_goals", "away_goals"])
    df = df.withColumn("season_start", season_start("date")).withColumn("result", result("home_goals", "away_goals"))
    return with_columns(df.where(F.col("season_start") >= first_season), MATCH)


def _named(competition: str | Column, values: dict) -> tuple[Column, Column]:
    """A competition, given by name or as a column of names, and its value in a table."""
    if isinstance(competition, Column):
        return competition, lookup(competition, values)
    return F.lit(competition), F.lit(values.get(competition))


def league(df: DataFrame, competition: str | Column, country: str | None = None, tier: int | None = None, first_season: int = 2008) -> DataFrame:
    """Season files of main leagues; country and tier are the league's unless given."""
    name, of = _named(competition, MAIN_LEAGUES)
    level = _named(competition, {c: tier_of(c) for c in MAIN_LEAGUES})[1]
    of, level = F.lit(country) if country else of, F.lit(tier) if tier else level
    o = _odds(df)
    stats = {f"{side}_{n}": number(_text(df, f"{letter}{c}")) for n, c in _STATS.items() for side, letter in (("home", "H"), ("away", "A"))}
    rows = df.select(
        mixed_date(_text(df, "Date")).alias("date"), F.lit("results").alias("source"), F.concat(F.lit("league:"), name).alias("competition"), level.alias("tier"), F.lit(False).alias("is_uefa"), of.alias("country"),
        F.trim(_text(df, "HomeTeam")).alias("home_team"), F.trim(_text(df, "AwayTeam")).alias("away_team"), number(_text(df, "FTHG")).cast("int").alias("home_goals"), number(_text(df, "FTAG")).cast("int").alias("away_goals"),
        F.lit(0).alias("is_knockout"), F.lit(0).alias("neutral"), _text(df, "Referee").alias("referee"), *[c.alias(n) for n, c in stats.items()],
        *[o[n].alias(f"odds_{n}") for n in ("home", "draw", "away")], o["type"].alias("odds_type"),
    )
    return _finished(rows, first_season)


def extra_league(df: DataFrame, competition: str | Column, country: str | None = None, first_season: int = 2008) -> DataFrame:
    """All-seasons files of other leagues: fewer columns, no match statistics; the country is the league's unless given."""
    name, of = _named(competition, EXTRA_LEAGUES)
    of = F.lit(country) if country else of
    o = _odds(df)
    rows = df.select(
        mixed_date(_text(df, "Date")).alias("date"), F.lit("results").alias("source"), F.concat(F.lit("league:"), name).alias("competition"), F.lit(1).alias("tier"), F.lit(False).alias("is_uefa"), of.alias("country"),
        F.trim(_text(df, "Home")).alias("home_team"), F.trim(_text(df, "Away")).alias("away_team"), number(_text(df, "HG")).cast("int").alias("home_goals"), number(_text(df, "AG")).cast("int").alias("away_goals"),
        F.lit(0).alias("is_knockout"), F.lit(0).alias("neutral"), *[o[n].alias(f"odds_{n}") for n in ("home", "draw", "away")], o["type"].alias("odds_type"),
    )
    return _finished(rows, first_season)


def league_files(spark: SparkSession, paths: list[str], first_season: int = 2008) -> tuple[DataFrame | None, list[str]]:
    """All season files (``1415_E0.csv``) and all-seasons files (``extra_AUT.csv``) as matches, and the paths whose names are neither, with a warning.

    One job reads the files' heads; files of one kind, header and encoding are one scan, told apart by their names. An empty file adds nothing.
    """
    shapes, unknown = {r"\d{4}_(\w+)\.csv": (league, MAIN_LEAGUES), r"extra_(\w+)\.csv": (extra_league, EXTRA_LEAGUES)}, []
    kinds = {}
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        found = next((s for s, (_, known) in shapes.items() if (m := re.fullmatch(s, name)) and m[1] in known), None)
        if found:
            kinds[path] = found
        else:
            unknown.append(path)
            warnings.warn(f"no league's file: {path}", stacklevel=2)
    alike: dict[tuple, list[str]] = {}
    for path, head in (file_heads(spark, list(kinds)) if kinds else {}).items():
        alike.setdefault((kinds[path], *head), []).append(path)
    parts = [shapes[shape][0](by_file_name(csv(spark, same, encoding), shape), F.col("g1"), first_season=first_season) for (shape, _, encoding), same in alike.items()]
    return (union(parts) if parts else None), unknown


def union(parts: list[DataFrame]) -> DataFrame:
    """All sources by name; exact repetitions go."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


def platform_games(games: DataFrame, competitions: DataFrame, country_codes: dict[str, str] = COUNTRY_CODES, first_season: int = 2008, uefa=UEFA) -> DataFrame:
    """Games of the player platform: first divisions of known countries, and international competitions."""
    domestic = competitions.where("type = 'domestic_league'").select("competition_id", lookup("country_name", country_codes).alias("country")).where("country is not null")
    kept = games.join(domestic, "competition_id", "left").where(F.col("country").isNotNull() | F.col("competition_id").isin(*uefa))
    is_uefa = F.col("competition_id").isin(*uefa)
    day = F.col("date").cast("string").try_cast("date")
    season = F.col("season").try_cast("int")
    cup = round_class("competition_id", "round", season, day)
    rows = kept.select(
        day.alias("date"), F.lit("platform").alias("source"), F.concat(F.when(is_uefa, "uefa:").otherwise("league:"), "competition_id").alias("competition"), F.lit(1).alias("tier"), is_uefa.alias("is_uefa"),
        F.when(~is_uefa, F.col("country")).alias("country"), F.trim("home_club_name").alias("home_team"), F.trim("away_club_name").alias("away_team"), F.col("home_club_id").try_cast("long").alias("home_tm_id"), F.col("away_club_id").try_cast("long").alias("away_tm_id"),
        F.col("home_club_goals").try_cast("int").alias("home_goals"), F.col("away_club_goals").try_cast("int").alias("away_goals"), F.when(is_uefa, cup["is_knockout"]).otherwise(0).alias("is_knockout"), F.when(is_uefa, cup["neutral"]).otherwise(0).alias("neutral"), F.col("referee").cast("string").alias("referee"),
    )
    return _finished(rows, first_season)


def appearances(df: DataFrame) -> DataFrame:
    renamed = df.withColumnsRenamed({"player_club_id": "club_id", "minutes_played": "minutes"})
    return with_columns(renamed, APPEARANCE).na.drop(subset=["game_id", "player_id", "club_id", "date"])


def valuations(df: DataFrame) -> DataFrame:
    """One positive value for each player and day (the greatest, where a day has several)."""
    rows = with_columns(df.withColumnsRenamed({"market_value_in_eur": "value_eur"}), VALUATION).na.drop()
    return rows.where("value_eur > 0").groupBy("player_id", "date").agg(F.max("value_eur").alias("value_eur"))


def players(df: DataFrame) -> DataFrame:
    """Only what does not change with time: later snapshots would leak."""
    return with_columns(df, PLAYER)


def canonical(first: DataFrame, second: DataFrame, keys: DataFrame, covered_countries: tuple = COVERED) -> DataFrame:
    """Both sources with team keys; of the second one, leagues that the first one covers go.

    ``keys``: country, name, key for the first source; the second one's keys are its club ids.
    """
    named = first
    for side in ("home", "away"):
        k = keys.select("country", F.col("name").alias(f"{side}_team"), F.col("key").alias(f"{side}_key"))
        named = named.join(k, ["country", f"{side}_team"], "left")
    missing = named.where("home_key is null or away_key is null").limit(1).count()
    if missing:
        raise KeyError("a team of the first source has no key")
    rest = second.where(F.col("is_uefa") | not_in("country", covered_countries))
    for side in ("home", "away"):
        rest = rest.withColumn(f"{side}_key", F.concat(F.lit("tm:"), F.col(f"{side}_tm_id").cast("string")))
    return named.unionByName(rest, allowMissingColumns=True)
