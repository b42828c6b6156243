"""Schemas of the domain tables, as DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_STATS = ", ".join(f"{side}_{x} DOUBLE" for x in ("fouls", "yellow", "red", "shots", "sot") for side in ("home", "away"))

MATCH = (
    "date DATE, season_start INT, source STRING, competition STRING, tier INT, is_uefa BOOLEAN, country STRING, home_team STRING, away_team STRING, "
    "home_tm_id LONG, away_tm_id LONG, home_goals INT, away_goals INT, result STRING, is_knockout INT, neutral INT, referee STRING, "
    f"{_STATS}, odds_home DOUBLE, odds_draw DOUBLE, odds_away DOUBLE, odds_type STRING"
)
APPEARANCE = "game_id LONG, player_id LONG, club_id LONG, date DATE, competition_id STRING, minutes INT, goals INT, assists INT"
VALUATION = "player_id LONG, date DATE, value_eur DOUBLE"
PLAYER = "player_id LONG, position STRING, date_of_birth DATE"
CLUB = "club_id LONG, name STRING, country STRING"
FIXTURE = "date DATE, home_key STRING, away_key STRING, neutral DOUBLE, is_knockout DOUBLE, is_uefa DOUBLE"
TEAM_ALIAS = "alias STRING, target STRING, country STRING"
SIM_MAPPING = "competition STRING, sim_name STRING, sim_country STRING, key STRING, model_name STRING, model_country STRING, method STRING"
RATING_HISTORY = "team STRING, day LONG, elo DOUBLE"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
