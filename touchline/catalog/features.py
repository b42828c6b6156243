"""Queries over matches, squads and players: each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from touchline.functions import scalar
from touchline.operators import checks, dedupe, metrics, player, rating, rolling, snapshot
from touchline.operators.asof import Lookup, as_of
from touchline.params import FEATURES, Params
from touchline.plans import ratings, store
from touchline.session import checkpointed, shared_folder
from touchline.sources import adapters as A

GAP = A.GAP_DAYS
#: The adapter's minutes are at most about 50 a game, so the minute gates are lower here.
PARAMS = Params(production_min_minutes=200, continuity_minutes=25)
REFERENCE = "club_id % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 2))"


def _r(c, n: int = 6):
    return F.round(c, n)


def _clean(spark, d) -> DataFrame:
    return dedupe.without_same_day_conflicts(A.matches(spark, d))


def _clean_in_proportion(spark, d) -> DataFrame:
    return dedupe.without_same_day_conflicts(A.matches_in_proportion(spark, d))


CLEAN = """SELECT m.* FROM matches m
 WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.team = m.home_key AND c.d = m.d)
   AND NOT EXISTS (SELECT 1 FROM clash c WHERE c.team = m.away_key AND c.d = m.d)"""
CLASH = """SELECT team, d FROM (SELECT home_key AS team, d FROM matches UNION ALL SELECT away_key, d FROM matches) s
 GROUP BY team, d HAVING count(*) > 1"""
SIDES = """SELECT match_id, home_key AS team, d AS day,
   CASE WHEN home_goals > away_goals THEN 3e0 WHEN home_goals = away_goals THEN 1e0 ELSE 0e0 END AS points,
   cast(home_goals AS double) AS goals_for, cast(away_goals AS double) AS goals_against,
   cast(home_sot AS double) AS sot_for, cast(away_sot AS double) AS sot_against,
   cast(home_shots AS double) AS shots_for, cast(away_shots AS double) AS shots_against FROM clean
 UNION ALL SELECT match_id, away_key, d,
   CASE WHEN away_goals > home_goals THEN 3e0 WHEN home_goals = away_goals THEN 1e0 ELSE 0e0 END,
   cast(away_goals AS double), cast(home_goals AS double), cast(away_sot AS double), cast(home_sot AS double),
   cast(away_shots AS double), cast(home_shots AS double) FROM clean"""


def _segmented(source: str) -> str:
    return f"""SELECT *, sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY team ORDER BY day, match_id) AS segment
 FROM (SELECT *, day - lag(day) OVER (PARTITION BY team ORDER BY day, match_id) AS gap FROM {source}) g"""


def _mean(column: str, n: int, least: int, shifted: bool = False) -> str:
    frame = f"(PARTITION BY team, segment ORDER BY day, match_id ROWS BETWEEN {n if shifted else n - 1} PRECEDING AND {'1 PRECEDING' if shifted else 'CURRENT ROW'})"
    return f"CASE WHEN count({column}) OVER {frame} >= {least} THEN avg({column}) OVER {frame} END"


def _share(num: str, den: str, n: int, least: int) -> str:
    frame = f"(PARTITION BY team, segment ORDER BY day, match_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({num}) OVER {frame} >= {least} AND sum({den}) OVER {frame} > 0 THEN sum({num}) OVER {frame} / sum({den}) OVER {frame} END"


LOG = f"SELECT *, {_mean('points', 5, 3)} AS form_after, {_mean('goals_for', 10, 5)} AS gf_after, {_mean('goals_against', 10, 5)} AS ga_after FROM seg"
SHOTS = f"SELECT *, {_share('sot_for', 'sot_total', 10, 5)} AS sot_share_after, {_share('shots_for', 'shots_total', 10, 5)} AS shot_share_after FROM shot_seg"
SHOT_SIDES = "SELECT *, sot_for + sot_against AS sot_total, shots_for + shots_against AS shots_total FROM sides WHERE sot_for IS NOT NULL AND sot_against IS NOT NULL AND shots_for IS NOT NULL AND shots_against IS NOT NULL"


def _chain(sql: str, **more: str) -> str:
    return A.with_views(sql, "matches", clash=CLASH, clean=CLEAN, sides=SIDES, seg=_segmented("sides"), shot_sides=SHOT_SIDES, shot_seg=_segmented("shot_sides"), log=LOG, shots=SHOTS, **more)


# -- scalars ----------------------------------------------------------------


def season_derivation(spark, d):
    m = A.matches(spark, d)
    start = scalar.season_start("d")
    return m.select("match_id", start.alias("season_start"), scalar.season_code(start).alias("season_code"), scalar.month_start("d").alias("month"), F.unix_date("d").alias("day"))


SEASON = A.with_views(
    """SELECT match_id, cast(year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END AS int) AS season_start,
 lpad(cast((year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END) % 100 AS varchar), 2, '0') || lpad(cast((year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END + 1) % 100 AS varchar), 2, '0') AS season_code,
 cast(date_trunc('month', d) AS date) AS month, cast(d - DATE '1970-01-01' AS int) AS day FROM matches""",
    "matches",
)


def result_case(spark, d):
    m = A.matches(spark, d).withColumn("result", scalar.result("home_goals", "away_goals"))
    return m.groupBy("tier", "result", scalar.class_index("result").alias("class")).agg(F.count(F.lit(1)).alias("n"))


RESULT = A.with_views(
    """SELECT tier, result, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS class, count(*) AS n
 FROM (SELECT tier, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result FROM matches) r GROUP BY 1, 2, 3""",
    "matches",
)


def odds_first_valid(spark, d):
    m = A.matches(spark, d)
    o = scalar.first_valid_odds({"first": ("odds_home", "odds_draw", "odds_away"), "second": (F.expr("2.1e0"), F.col("odds_draw"), F.expr("CASE WHEN match_id % 4 = 0 THEN 0.9e0 ELSE 3.3e0 END"))})
    return m.select("match_id", *[o[n].alias(n) for n in ("home", "draw", "away", "type")])


_ONE = "coalesce(odds_home > 1 AND odds_draw > 1 AND odds_away > 1, false)"
_TWO = "coalesce(odds_draw > 1 AND match_id % 4 <> 0, false)"
ODDS = A.with_views(
    f"""SELECT match_id, CASE WHEN {_ONE} THEN odds_home WHEN {_TWO} THEN 2.1e0 END AS home, CASE WHEN {_ONE} OR {_TWO} THEN odds_draw END AS draw,
 CASE WHEN {_ONE} THEN odds_away WHEN {_TWO} THEN 3.3e0 END AS away, CASE WHEN {_ONE} THEN 'first' WHEN {_TWO} THEN 'second' END AS type FROM matches""",
    "matches",
)


def market_expected_score(spark, d):
    m = A.matches(spark, d)
    p = scalar.market_probabilities("odds_home", "odds_draw", "odds_away")
    return m.select("match_id", *[_r(p[n], 9).alias(f"p_{n}") for n in ("home", "draw", "away")], _r(scalar.market_expected_score("odds_home", "odds_draw", "odds_away"), 9).alias("expected"))


_INV = "(1e0/odds_home + 1e0/odds_draw + 1e0/odds_away)"
MARKET = A.with_views(
    f"""SELECT match_id, CASE WHEN {_ONE} THEN round((1e0/odds_home)/{_INV}, 9) END AS p_home, CASE WHEN {_ONE} THEN round((1e0/odds_draw)/{_INV}, 9) END AS p_draw,
 CASE WHEN {_ONE} THEN round((1e0/odds_away)/{_INV}, 9) END AS p_away, CASE WHEN {_ONE} THEN round((1e0/odds_home)/{_INV} + 0.5e0*(1e0/odds_draw)/{_INV}, 9) END AS expected FROM matches""",
    "matches",
)


def goal_multiplier(spark, d):
    m = A.matches(spark, d)
    gd = F.col("home_goals") - F.col("away_goals")
    return m.select("match_id", scalar.goal_multiplier(gd).cast("double").alias("multiplier"), _r(scalar.expected_score(gd * 25.0), 9).alias("expected"))


GOALS = A.with_views(
    """SELECT match_id, CASE WHEN abs(home_goals - away_goals) <= 1 THEN 1e0 WHEN abs(home_goals - away_goals) = 2 THEN 1.5e0 ELSE (abs(home_goals - away_goals) + 11)/8e0 END AS multiplier,
 round(1e0/(1e0 + pow(10e0, -((home_goals - away_goals)*25e0)/400e0)), 9) AS expected FROM matches""",
    "matches",
)

_CUP = "CASE match_id % 7 WHEN 0 THEN 'CL' WHEN 1 THEN 'CLQ' WHEN 2 THEN 'EL' WHEN 3 THEN 'ELQ' WHEN 4 THEN 'UCOL' WHEN 5 THEN 'ECLQ' ELSE NULL END"
_ROUND = "CASE match_id % 6 WHEN 0 THEN ' Third Round' WHEN 1 THEN 'Group A' WHEN 2 THEN 'Final' WHEN 3 THEN 'Quarter-Finals' WHEN 4 THEN 'Semi-Finals 1st leg' ELSE NULL END"


def round_classifier(spark, d):
    m = A.matches(spark, d).withColumns({"cup": F.expr(_CUP), "round": F.expr(_ROUND)}).withColumn("season", scalar.season_start("d") + F.expr("CASE WHEN match_id % 7 = 0 THEN 2019 - year(d) ELSE 0 END"))
    c = scalar.round_class("cup", "round", "season", F.add_months("d", 300))
    return m.select("match_id", c["is_knockout"].alias("is_knockout"), c["neutral"].alias("neutral"))


ROUND = A.with_views(
    f"""SELECT match_id, CASE WHEN early OR low LIKE 'group%' THEN 0 ELSE 1 END AS is_knockout,
 CASE WHEN early OR low LIKE 'group%' THEN 0 WHEN low = 'final' OR (season = 2019 AND later >= DATE '2020-08-01' AND low NOT LIKE '%leg%') THEN 1 ELSE 0 END AS neutral
 FROM (SELECT match_id, coalesce({_CUP}, '') IN ('CLQ', 'ELQ', 'ECLQ') AS early, lower(trim(coalesce({_ROUND}, ''))) AS low, cast(d + INTERVAL 300 MONTH AS date) AS later,
 year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END + CASE WHEN match_id % 7 = 0 THEN 2019 - year(d) ELSE 0 END AS season FROM matches) r""",
    "matches",
)

_RAW_DATE = "CASE WHEN match_id % 9 = 0 THEN 'not a day' WHEN match_id % 2 = 0 THEN {full} ELSE {short} END"


def date_parse_mixed(spark, d):
    m = A.matches(spark, d)
    text = F.expr(_RAW_DATE.format(full="date_format(d, 'dd/MM/yyyy')", short="date_format(date_add(d, 3653), 'dd/MM/yy')"))
    goals = F.expr("CASE WHEN match_id % 5 = 0 THEN 'x' ELSE cast(home_goals AS string) END")
    rows = m.select("match_id", scalar.mixed_date(F.concat(F.lit(" "), text)).alias("parsed"), scalar.number(goals).alias("goals"))
    return rows.na.drop(subset=["parsed"])


DATES = A.with_views(
    """SELECT match_id, CASE WHEN match_id % 2 = 0 THEN d ELSE cast(d + INTERVAL 3653 DAY AS date) END AS parsed, CASE WHEN match_id % 5 = 0 THEN NULL ELSE cast(home_goals AS double) END AS goals
 FROM matches WHERE match_id % 9 <> 0""",
    "matches",
)


def union_conform(spark, d):
    m = A.matches(spark, d)
    one = m.where("match_id % 2 = 0").select("match_id", F.col("d").alias("date"), "odds_home", F.lit("results").alias("source"))
    two = m.where("match_id % 3 = 0").select("match_id", F.col("d").alias("date"), F.lit("platform").alias("source"), F.concat(F.lit("uefa:"), F.lpad(F.col("match_id").cast("string"), 6, "0")).alias("competition"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("source").agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("n"), F.count("odds_home").alias("n_odds"), F.max("competition").alias("competition"))


CONFORM = A.with_views(
    """SELECT source, max(date) AS last, count(*) AS n, count(odds_home) AS n_odds, max(competition) AS competition FROM (
 SELECT d AS date, odds_home, 'results' AS source, NULL AS competition FROM matches WHERE match_id % 2 = 0
 UNION ALL SELECT d, NULL, 'platform', 'uefa:' || lpad(cast(match_id AS varchar), 6, '0') FROM matches WHERE match_id % 3 = 0) u GROUP BY source""",
    "matches",
)


# -- logs ---------------------------------------------------------------------


def match_unpivot(spark, d):
    s = rolling.both_sides(A.matches(spark, d))
    return s.select("match_id", "team", "day", "points", "goals_for", "goals_against", "sot_for", "shots_against")


UNPIVOT = A.with_views("SELECT match_id, team, day, points, goals_for, goals_against, sot_for, shots_against FROM sides", "matches", clean="SELECT * FROM matches", sides=SIDES)


def same_day_conflict_anti(spark, d):
    return _clean(spark, d).select("match_id", "home_key", "away_key", "d")


def same_day_conflicts(spark, d):
    m = A.matches(spark, d).select(F.explode(F.array("home_key", "away_key")).alias("team"), "d")
    return dedupe.repeated_keys(m, ["team", "d"])


def keep_first_dedupe(spark, d):
    return dedupe.keep_first(A.matches(spark, d), ["home_key", "away_key"], ["d", "match_id"]).select("home_key", "away_key", "match_id", "d")


FIRST = A.with_views("SELECT home_key, away_key, match_id, d FROM (SELECT *, row_number() OVER (PARTITION BY home_key, away_key ORDER BY d, match_id) AS n FROM matches) r WHERE n = 1", "matches")


def gap_segments(spark, d):
    log = rolling.segments(rolling.both_sides(_clean(spark, d)), GAP)
    return log.select("match_id", "team", F.col("gap").cast("long").alias("gap"), F.col("segment").cast("long").alias("segment"))


def rolling_form(spark, d):
    log = rolling.team_log(_clean(spark, d), gap_days=GAP)
    return log.select("match_id", "team", *[_r(c, 9).alias(c) for c in ("form_after", "gf_after", "ga_after")])


def rolling_shift_form(spark, d):
    log = rolling.segments(rolling.both_sides(_clean(spark, d)), GAP)
    return log.select("match_id", "team", _r(rolling.rolling_mean("points", 5, 3, shifted=True), 9).alias("form_before"), _r(rolling.rolling_mean("goals_for", 10, 5, shifted=True), 9).alias("gf_before"))


def rolling_share(spark, d):
    log = rolling.shots_log(_clean(spark, d), gap_days=GAP)
    return log.select("match_id", "team", _r("sot_share_after", 9).alias("sot_share"), _r("shot_share_after", 9).alias("shot_share"))


# -- as-of ----------------------------------------------------------------------


def _sides_of(m: DataFrame) -> DataFrame:
    return m.select("match_id", "d", F.explode(F.array("home_key", "away_key")).alias("team"))


def form_as_of(spark, d):
    m = _clean(spark, d)
    log = rolling.team_log(m, gap_days=GAP)
    found = as_of(_sides_of(m), "team", "d", [Lookup(log, "team", "day", {"form": "form_after"}, strict=True, max_gap=GAP, tie=("match_id",))])
    return found.select("match_id", "team", _r("form", 9).alias("form"))


def _asof_sql(values: str, op: str, gap: int | None, table: str = "log", day: str = "day") -> str:
    fresh = f"CASE WHEN s.d - l.{day} <= {gap} THEN {{}} END" if gap is not None else "{}"
    picked = ", ".join(f"round({fresh.format('l.' + v)}, 9) AS {n}" for n, v in (x.split(":") for x in values.split(",")))
    return f"SELECT s.match_id, s.team, {picked} FROM probes s ASOF LEFT JOIN {table} l ON s.team = l.team AND s.d {op} l.{day}"


PROBES = "SELECT match_id, d, home_key AS team FROM clean UNION ALL SELECT match_id, d, away_key FROM clean"


def asof_inclusive(spark, d):
    m = _clean(spark, d)
    log = rolling.team_log(m, gap_days=GAP)
    found = as_of(_sides_of(m), "team", "d", [Lookup(log, "team", "day", {"form": "form_after", "gf": "gf_after"}, strict=False, tie=("match_id",))], bucket_days=365)
    return found.select("match_id", "team", _r("form", 9).alias("form"), _r("gf", 9).alias("gf"))


def asof_last_row_null(spark, d):
    """Shots of the last match before a day: NULL where that match has none, not those of an earlier one."""
    m = _clean(spark, d)
    found = as_of(_sides_of(m), "team", "d", [Lookup(rolling.both_sides(m), "team", "day", {"shots": "shots_for"}, tie=("match_id",))])
    return found.select("match_id", "team", _r("shots", 9).alias("shots"))


def asof_many(spark, d):
    """Form, goals and shares of both sides in one shuffle, pivoted back to the match."""
    m = _clean(spark, d)
    sides = m.select("match_id", "d", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("team")) for s in ("home", "away")])).alias("s")).select("match_id", "d", "s.*")
    found = as_of(sides, "team", "d", [
        Lookup(rolling.team_log(m, gap_days=GAP), "team", "day", {"form": "form_after", "goals_for": "gf_after"}, max_gap=GAP, tie=("match_id",)),
        Lookup(rolling.shots_log(m, gap_days=GAP), "team", "day", {"sot_share": "sot_share_after"}, max_gap=GAP, tie=("match_id",)),
    ])
    pick = lambda s, c: _r(F.max(F.when(F.col("side") == s, F.col(c))), 9).alias(f"{s}_{c}")
    return found.groupBy("match_id").agg(*[pick(s, c) for s in ("home", "away") for c in ("form", "goals_for", "sot_share")])


ASOF_MANY = _chain(
    "SELECT match_id, " + ", ".join(f"round(max(CASE WHEN side = '{s}' THEN {c} END), 9) AS {s}_{c}" for s in ("home", "away") for c in ("form", "goals_for", "sot_share")) + " FROM found GROUP BY match_id",
    found=f"""SELECT p.match_id, p.side, CASE WHEN p.d - l.day <= {GAP} THEN l.form_after END AS form, CASE WHEN p.d - l.day <= {GAP} THEN l.gf_after END AS goals_for,
 CASE WHEN p.d - h.day <= {GAP} THEN h.sot_share_after END AS sot_share FROM (SELECT match_id, d, home_key AS team, 'home' AS side FROM clean UNION ALL SELECT match_id, d, away_key, 'away' FROM clean) p
 ASOF LEFT JOIN log l ON p.team = l.team AND p.d > l.day ASOF LEFT JOIN shots h ON p.team = h.team AND p.d > h.day""",
)


def rest_days(spark, d):
    m = _clean(spark, d)
    found = as_of(_sides_of(m), "team", "d", [Lookup(rolling.last_matches(m), "team", "day", {"last": "day"})])
    return found.select("match_id", "team", scalar.capped(F.datediff("d", "last"), 30).cast("long").alias("rest"))


REST = _chain("SELECT s.match_id, s.team, CASE WHEN l.day IS NOT NULL THEN cast(least(s.d - l.day, 30) AS bigint) END AS rest FROM probes s ASOF LEFT JOIN played l ON s.team = l.team AND s.d > l.day", probes=PROBES, played="SELECT DISTINCT team, day FROM sides")


# -- squads -------------------------------------------------------------------------

FANOUT = """SELECT DISTINCT {keys}, snapshot FROM (SELECT {keys}, last, cast(month + to_months(cast(o AS int)) AS date) AS snapshot
 FROM (SELECT {keys}, cast(date_trunc('month', d) AS date) AS month, max(d) AS last FROM {source} GROUP BY ALL) x, range(1, {n} + 1) t(o)) y WHERE snapshot - last <= {days}"""
VALUED = "SELECT r.*, CASE WHEN r.snapshot - v.d <= 540 THEN v.value_eur END AS value_eur FROM roster r ASOF LEFT JOIN valuations v ON r.player_id = v.player_id AND r.snapshot > v.d"
TOTALS = """SELECT club_id, snapshot, sum(value_eur) AS total, cast(max(n) AS bigint) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY club_id, snapshot ORDER BY value_eur DESC, player_id) AS rank, count(*) OVER (PARTITION BY club_id, snapshot) AS n FROM valued WHERE value_eur IS NOT NULL) q
 WHERE rank <= 16 AND n >= 11 GROUP BY club_id, snapshot"""


def _squads(sql: str, **more: str) -> str:
    return A.with_views(sql, "appearances", "valuations", roster=FANOUT.format(keys="player_id, club_id", source="appearances", n=7, days=180), valued=VALUED, totals=TOTALS, **more)


def _reference(spark, d) -> F.Column:
    from touchline.sources.adapters import table

    nations = [r["n_nationkey"] for r in table(spark, d, "nation").where("n_regionkey in (0, 1, 2)").select("n_nationkey").collect()]  # 25 rows at most
    return (F.col("club_id") % 25).isin(*nations)


def month_snapshot_fanout(spark, d):
    return snapshot.month_fanout(A.appearances(spark, d, "player_id"), ["player_id", "club_id"], 180)


def snapshot_topk_sum(spark, d):
    t = snapshot.squad_totals(A.appearances(spark, d, "player_id"), A.valuations(spark, d, "player_id"), PARAMS)
    return t.select("club_id", "snapshot", _r("total", 2).alias("total"), "n")


def reference_median_diff(spark, d):
    t = snapshot.squad_totals(A.appearances(spark, d, "player_id"), A.valuations(spark, d, "player_id"), PARAMS)
    return snapshot.squad_values(t, _reference(spark, d)).select("club_id", "snapshot", _r("squad_value").alias("squad_value"))


SQUAD_VALUES = """SELECT t.club_id, t.snapshot, round(log10(t.total) - m.reference, 6) AS squad_value FROM totals t
 JOIN (SELECT snapshot, median(log10(total)) AS reference FROM totals WHERE """ + REFERENCE + """ GROUP BY snapshot) m ON m.snapshot = t.snapshot"""


def value_index_median(spark, d):
    i = snapshot.value_index(A.appearances(spark, d, "player_id"), A.valuations(spark, d, "player_id"), _reference(spark, d), PARAMS, A.parts(spark, d))
    return i.select("month", _r("idx").alias("idx"))


INDEX_VIEWS = {
    "ref_apps": "SELECT * FROM appearances WHERE " + REFERENCE,
    "index_roster": FANOUT.format(keys="player_id", source="ref_apps", n=14, days=365),
    "index_valued": VALUED.replace("FROM roster r", "FROM index_roster r"),
    "idx": "SELECT snapshot AS month, median(log10(value_eur)) AS idx FROM index_valued WHERE value_eur IS NOT NULL GROUP BY snapshot",
}


# -- players ----------------------------------------------------------------------


def _apps(spark, d, by: str | None = None) -> DataFrame:
    return A.appearances(spark, d, by).withColumn("uefa", F.col("game_id") % 4 == 0)


def club_match_ordinal(spark, d):
    return player.club_games(A.appearances(spark, d)).select("club_id", "game_id", "d", F.col("idx").cast("long").alias("idx"))


GAMES = "SELECT club_id, game_id, d, row_number() OVER (PARTITION BY club_id ORDER BY d, game_id) - 1 AS idx FROM (SELECT club_id, game_id, min(d) AS d FROM appearances GROUP BY 1, 2) g"
RANKED = """SELECT * FROM (SELECT club_id, tidx, player_id, minutes, row_number() OVER (PARTITION BY club_id, tidx ORDER BY minutes DESC, player_id) - 1 AS rank FROM (
 SELECT a.club_id, g.idx + o AS tidx, a.player_id, sum(a.minutes) AS minutes FROM appearances a JOIN games g ON g.club_id = a.club_id AND g.game_id = a.game_id, range(0, 5) t(o)
 WHERE g.idx + o <= (SELECT max(x.idx) FROM games x WHERE x.club_id = a.club_id) GROUP BY 1, 2, 3) m) r WHERE rank < 18"""


def last5_minutes_rank(spark, d):
    r = player.ranked_minutes(A.appearances(spark, d, "club_id"), params=PARAMS)
    return r.select("club_id", F.col("tidx").cast("long").alias("tidx"), "player_id", F.col("minutes").cast("long").alias("minutes"), F.col("rank").cast("long").alias("rank"))


LINEUPS = """SELECT r.*, g.game_id, g.d, p.pos, CASE WHEN g.d - v.d <= 540 THEN v.value_eur END AS value_eur, coalesce(a.minutes, 0) AS minutes_at, (g.d - p.born)/365.25e0 AS age
 FROM ranked r JOIN games g ON g.club_id = r.club_id AND g.idx = r.tidx LEFT JOIN appearances a ON a.club_id = r.club_id AND a.game_id = g.game_id AND a.player_id = r.player_id
 LEFT JOIN players p ON p.player_id = r.player_id ASOF LEFT JOIN valuations v ON v.player_id = r.player_id AND g.d >= v.d"""
DAILY = "SELECT player_id, d, sum(minutes) AS minutes, sum(goals + assists) AS ga, sum(CASE WHEN game_id % 4 = 0 THEN 1 ELSE 0 END) AS uefa FROM appearances GROUP BY 1, 2"
CUM = "SELECT player_id, d, " + ", ".join(f"sum({c}) OVER (PARTITION BY player_id ORDER BY d) AS cum_{c}" for c in ("minutes", "ga", "uefa")) + " FROM daily"
XI = """SELECT l.*, coalesce(n.cum_minutes, 0) - coalesce(b.cum_minutes, 0) AS d_minutes, coalesce(n.cum_ga, 0) - coalesce(b.cum_ga, 0) AS d_ga, coalesce(n.cum_uefa, 0) - coalesce(u.cum_uefa, 0) AS d_uefa
 FROM (SELECT *, d - 365 AS d1, d - 1095 AS d2 FROM lineups WHERE rank < 11) l ASOF LEFT JOIN cum n ON n.player_id = l.player_id AND l.d >= n.d
 ASOF LEFT JOIN cum b ON b.player_id = l.player_id AND l.d1 >= b.d ASOF LEFT JOIN cum u ON u.player_id = l.player_id AND l.d2 >= u.d"""
STATE = """SELECT x.club_id, x.tidx, x.d, CASE WHEN xi_n >= 8 THEN log10(xi_sum) - i.idx END AS xi_value, CASE WHEN xi_n >= 8 THEN log10(xi_max) - i.idx END AS xi_star,
 CASE WHEN coalesce(b.n, 0) >= 3 THEN log10(b.total) - i.idx END AS bench_value, CASE WHEN xi_n >= 8 THEN log10(att) - i.idx END AS att_value, CASE WHEN xi_n >= 8 THEN log10(mid) - i.idx END AS mid_value,
 CASE WHEN xi_n >= 8 THEN log10(def) - i.idx END AS def_value, CASE WHEN xi_n >= 8 THEN log10(gk) - i.idx END AS gk_value, CASE WHEN mins >= 200 THEN 90e0*ga/mins END AS xi_ga90, xi_age, xi_uefa_apps,
 CASE WHEN xi_n >= 8 THEN played/xi_sum END AS xi_last_match_share FROM (
 SELECT club_id, tidx, min(d) AS d, sum(value_eur) AS xi_sum, count(value_eur) AS xi_n, max(value_eur) AS xi_max, sum(CASE WHEN minutes_at >= 25 THEN value_eur ELSE 0e0 END) AS played,
 sum(d_minutes) AS mins, sum(d_ga) AS ga, avg(age) AS xi_age, avg(d_uefa) AS xi_uefa_apps, """ + ", ".join(f"sum(CASE WHEN pos = '{p}' THEN value_eur END) AS {n}" for n, p in (("att", "Attack"), ("mid", "Midfield"), ("def", "Defender"), ("gk", "Goalkeeper"))) + """
 FROM xi GROUP BY 1, 2) x LEFT JOIN (SELECT club_id, tidx, sum(value_eur) AS total, count(value_eur) AS n FROM lineups WHERE rank >= 11 GROUP BY 1, 2) b ON b.club_id = x.club_id AND b.tidx = x.tidx
 LEFT JOIN idx i ON i.month = date_trunc('month', x.d)"""


def _players_sql(sql: str) -> str:
    return A.with_views(sql, "appearances", "valuations", "players", games=GAMES, ranked=RANKED, lineups=LINEUPS, daily=DAILY, cum=CUM, xi=XI, **INDEX_VIEWS, state=STATE)


#: The first eleven alone.
ELEVEN = replace(PARAMS, bench_size=0)


def xi_conditional_sums(spark, d):
    rows = player.lineups(A.appearances(spark, d, "club_id"), A.valuations(spark, d, "player_id"), A.players(spark, d), ELEVEN, parts=A.parts(spark, d))
    out = rows.groupBy("club_id", "tidx").agg(F.count("value_eur").alias("valued"), _r(F.sum(F.when(F.col("pos") == "Attack", F.col("value_eur"))), 2).alias("attack"), _r(F.avg("age")).alias("age"), F.sum("minutes_at").cast("long").alias("minutes_at"))
    return out.withColumn("tidx", F.col("tidx").cast("long"))


def trailing_range_sum(spark, d):
    rows = player.ranked_minutes(A.appearances(spark, d, "club_id"), params=ELEVEN)
    t = player.totals_between(rows, player.daily_totals(_apps(spark, d, "player_id")), ELEVEN, A.parts(spark, d))
    return t.select("club_id", F.col("tidx").cast("long").alias("tidx"), "player_id", *[F.col(c).cast("long").alias(c) for c in ("d_minutes", "d_ga", "d_uefa")])


def trailing_window_sum(spark, d):
    """The same trailing sum as a range window, at days with a game."""
    daily = _apps(spark, d).groupBy("player_id", "d").agg(F.sum("minutes").alias("minutes"))
    w = Window.partitionBy("player_id").orderBy(F.unix_date("d")).rangeBetween(-364, 0)
    return daily.select("player_id", "d", F.sum("minutes").over(w).cast("long").alias("minutes_365"))


RANGE = A.with_views("SELECT player_id, d, cast(sum(minutes) OVER (PARTITION BY player_id ORDER BY d RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW) AS bigint) AS minutes_365 FROM daily", "appearances", daily=DAILY)


def _player_state(spark, d, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """The state and the index it is relative to. Tables are dealt once by club and once by player. ``written``: the index is made once for all that read it."""
    v, played = A.valuations(spark, d, "player_id"), _apps(spark, d, "player_id")
    index = snapshot.value_index(played, v, _reference(spark, d), PARAMS, A.parts(spark, d))
    index = checkpointed(index) if written else index
    return player.player_state(_apps(spark, d, "club_id"), v, A.players(spark, d), index, PARAMS, player.daily_totals(played), A.parts(spark, d)), index


def player_state(spark, d):
    s, _ = _player_state(spark, d)
    return s.select("club_id", F.col("tidx").cast("long").alias("tidx"), "d", *[_r(c, 5).alias(c) for c in store.PLAYER_METRICS])


# -- ratings ------------------------------------------------------------------------


def percentile_newcomer(spark, d):
    s = A.table(spark, d, "supplier")
    return s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), _r(F.percentile("s_acctbal", 0.25)).alias("p25"), _r(F.median("s_acctbal")).alias("p50"))


NEWCOMER = "SELECT s_nationkey, count(*) AS n, round(quantile_cont(s_acctbal, 0.25), 6) AS p25, round(median(s_acctbal), 6) AS p50 FROM supplier GROUP BY s_nationkey"
#: No provisional boost, no newcomers' pool: the rating rule alone, which SQL can follow day by day.
PLAIN = Params(elo_provisional_mult=1.0, elo_newcomer_pool=10**9)


def _grid(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, rating.GRID)


def _by_team(rated: DataFrame) -> DataFrame:
    return rating.history(rated).select(F.col("team").cast("long").alias("team"), F.date_from_unix_date(F.col("day").cast("int")).alias("day"), _r("elo").alias("elo"))


def elo_plain(spark, d):
    rows = rating.engine_rows(_clean(spark, d))
    return _by_team(rating.run(rows, _grid(spark, [(0, 10.0, 3.0, 0.0)]), PLAIN, burn_in=False))


def elo_incremental(spark, d):
    """All ratings as a kept log has them after its third run: matches until 1998, until 2000, and the rest."""
    rows, grid, root = checkpointed(rating.engine_rows(_clean(spark, d))), _grid(spark, [(0, 10.0, 3.0, 0.0)]), f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}"
    for until in (date(1998, 1, 1), date(2000, 1, 1)):
        ratings.update(rows.where(F.col("day") < (until - date(1970, 1, 1)).days), root, grid, PLAIN, burn_in=False)
    ratings.update(rows, root, grid, PLAIN, burn_in=False)
    return _by_team(ratings.rated(spark, root))


ELO = A.with_views(
    "SELECT team, day, round(elo, 6) AS elo FROM run WHERE day = last",
    "matches",
    clash=CLASH,
    clean=CLEAN,
    days="SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM clean) x",
    games="""SELECT n, home_key, away_key, CASE WHEN home_goals > away_goals THEN 1e0 WHEN home_goals = away_goals THEN 0.5e0 ELSE 0e0 END AS score,
 CASE WHEN abs(home_goals - away_goals) <= 1 THEN 1e0 WHEN abs(home_goals - away_goals) = 2 THEN 1.5e0 ELSE (abs(home_goals - away_goals) + 11)/8e0 END AS mult,
 CASE WHEN is_uefa THEN 30e0 ELSE 10e0 END AS k, 55e0*(1 - neutral) AS bonus FROM clean JOIN days USING (d)""",
    teams="SELECT DISTINCT home_key AS team FROM clean UNION SELECT away_key FROM clean",
    run="""SELECT team, cast(0 AS bigint) AS n, 1500e0 AS elo, DATE '1900-01-01' AS day, DATE '1900-01-02' AS last FROM teams
 UNION ALL SELECT r.team, r.n + 1, r.elo + coalesce(c.gain, 0e0), w.d, CASE WHEN c.gain IS NOT NULL THEN w.d ELSE DATE '1900-01-02' END FROM run r JOIN days w ON w.n = r.n + 1
 LEFT JOIN (SELECT n, team, sum(gain) AS gain FROM (
 SELECT g.n, unnest([g.home_key, g.away_key]) AS team, unnest([1e0, -1e0]) * g.k * g.mult * (g.score - 1e0/(1e0 + pow(10e0, -(h.elo - a.elo + g.bonus)/400e0))) AS gain
 FROM games g JOIN run h ON h.n = g.n - 1 AND h.team = g.home_key JOIN run a ON a.n = g.n - 1 AND a.team = g.away_key) e GROUP BY n, team) c ON c.n = r.n + 1 AND c.team = r.team""",
).replace("WITH ", "WITH RECURSIVE ", 1)


def _countries(spark, d) -> DataFrame:
    m = A.matches_in_proportion(spark, d)
    teams = m.select(F.explode(F.array("home_key", "away_key")).alias("team")).distinct()
    return teams.withColumn("country", F.when(F.col("team") % 7 != 0, (F.col("team") % 25).cast("string")))


#: The adapter's matches end in 2001, so the burn-in does too, earlier.
FULL = Params(elo_burn_in_end=date(1997, 1, 1))


def elo_full(spark, d):
    rows = rating.engine_rows(_clean_in_proportion(spark, d), _countries(spark, d))
    rated = rating.run(rows, _grid(spark, [(0, 10.0, 3.0, 0.0), (1, 10.0, 3.0, 0.5)]), FULL)
    return rated.select("cfg", "match_id", _r("pre_home").alias("pre_home"), _r("pre_away").alias("pre_away"))


def elo_grid_objective(spark, d):
    m = _clean_in_proportion(spark, d)
    grid = [(i, k, u, 0.0) for i, (k, u) in enumerate((k, u) for k in FULL.k_grid for u in FULL.uefa_mult_grid)]
    rated = rating.run(rating.engine_rows(m), _grid(spark, grid), FULL)
    out = rating.objective(rated, m, date(1997, 1, 1), date(2001, 1, 1), FULL).join(_grid(spark, grid), "cfg")
    return out.select("cfg", "k", "uefa_mult", *[_r(c, 8).alias(c) for c in ("mse_domestic", "mse_uefa", "objective")])


def elo_grid_argmin(spark, d):
    return metrics.first_least(elo_grid_objective(spark, d), "objective", "k", "uefa_mult")


# -- assembly and checks ---------------------------------------------------------------


def _store(spark, d, matches: DataFrame) -> store.Store:
    return store.build(matches, _apps(spark, d), A.valuations(spark, d), A.players(spark, d), F.col("club_id"), _reference(spark, d), params=FULL_FEATURES, gap_days=GAP, parts=A.parts(spark, d))


FULL_FEATURES = Params(elo_burn_in_end=date(1997, 1, 1), production_min_minutes=200, continuity_minutes=25)


def _fixtures(m: DataFrame) -> DataFrame:
    return m.select("match_id", "d", "home_key", "away_key", F.col("is_uefa").cast("double").alias("is_uefa"), F.col("neutral").cast("double").alias("neutral"), F.lit(0.0).alias("is_knockout"))


def feature_assembly(spark, d):
    m = _clean_in_proportion(spark, d)
    return _store(spark, d, m).compute(_fixtures(m)).select("match_id", *[_r(f, 5).alias(f) for f in FEATURES])


def check_form_leakage(spark, d):
    m = _clean(spark, d)
    s = store.Store({}, {}, gap_days=GAP)
    found = as_of(m.select("match_id", "d", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"{x}_key").alias("team")) for x in ("home", "away")])).alias("s")).select("match_id", "d", "s.*"), "team", "d", [
        Lookup(rolling.team_log(m, gap_days=GAP), "team", "day", {"form": "form_after", "goals_for": "gf_after", "goals_against": "ga_after"}, max_gap=s.gap_days, tie=("match_id",)),
        Lookup(rolling.shots_log(m, gap_days=GAP), "team", "day", {"sot_share": "sot_share_after"}, max_gap=GAP, tie=("match_id",)),
    ])
    wide = found.groupBy("match_id").agg(*[F.max(F.when(F.col("side") == x, F.col(c))).alias(f"{x}_{c}") for x in ("home", "away") for c in ("form", "goals_for", "goals_against", "sot_share")])
    return checks.form_leakage(m, wide, gap_days=GAP).unionByName(checks.shots_leakage(m, wide, gap_days=GAP))


LEAKS = _chain("""SELECT feature, cast(0 AS bigint) AS mismatches, n FROM (SELECT unnest(['home_form', 'home_goals_for', 'home_goals_against', 'away_form', 'away_goals_for', 'away_goals_against']) AS feature, (SELECT count(*) FROM clean) AS n
 UNION ALL SELECT unnest(['home_sot_share', 'away_sot_share']), (SELECT count(*) FROM clean WHERE home_sot IS NOT NULL AND away_sot IS NOT NULL AND home_shots IS NOT NULL AND away_shots IS NOT NULL)) f""")


def check_rating_consistency(spark, d):
    m = _clean_in_proportion(spark, d)
    # read twice below, so folded once
    rated = checkpointed(rating.run(rating.engine_rows(m, _countries(spark, d)), _grid(spark, [(0, 10.0, 3.0, 0.0)]), FULL))
    history = rating.history(rated)
    sides = m.select("match_id", "d", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"{x}_key").cast("string").alias("team")) for x in ("home", "away")])).alias("s")).select("match_id", "d", "s.*")
    found = as_of(sides, "team", "d", [Lookup(history, "team", "day", {"elo": "elo"}, max_gap=400)])
    wide = found.groupBy("match_id").agg(*[F.max(F.when(F.col("side") == x, F.col("elo"))).alias(f"{x}_elo") for x in ("home", "away")])
    return checks.rating_consistency(rated, wide)


def check_player_state(spark, d):
    """All eleven metrics of 300 sampled club days recomputed row by row, against the fast path: how many differ."""
    a, v = _apps(spark, d), A.valuations(spark, d)
    state, index = _player_state(spark, d, written=True)
    days = a.select("club_id", F.date_add("d", 9).alias("d")).distinct().withColumn("id", F.concat_ws(":", "club_id", "d"))
    # read several times below
    sampled = checkpointed(metrics.seeded_sample(days, "id", 300).drop("id"))
    slow = checks.brute_force_state(a, v, A.players(spark, d), index, sampled, PARAMS)
    fast = as_of(sampled, "club_id", "d", [Lookup(state, "club_id", "d", {f"fast_{m}": m for m in store.PLAYER_METRICS}, max_gap=PARAMS.player_gap_days, tie=("tidx",))])
    both = fast.join(slow, ["club_id", "d"], "left")
    counted = both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(checks.differs(F.col(f"fast_{m}"), F.col(m))).alias(m) for m in store.PLAYER_METRICS], *[F.count(m).alias(f"known_{m}") for m in store.PLAYER_METRICS])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).alias("mismatches"), F.col(f"known_{m}").alias("known"), F.col("n").alias("n")) for m in store.PLAYER_METRICS])))


def seeded_sample(spark, d):
    return metrics.seeded_sample(A.matches(spark, d), "match_id", 300).select("match_id", "d")


QUERIES = {
    "season_derivation": (season_derivation, SEASON),
    "result_case": (result_case, RESULT),
    "odds_first_valid": (odds_first_valid, ODDS),
    "market_expected_score": (market_expected_score, MARKET),
    "goal_multiplier": (goal_multiplier, GOALS),
    "round_classifier": (round_classifier, ROUND),
    "date_parse_mixed": (date_parse_mixed, DATES),
    "union_conform": (union_conform, CONFORM),
    "match_unpivot": (match_unpivot, UNPIVOT),
    "same_day_conflict_anti": (same_day_conflict_anti, A.with_views("SELECT match_id, home_key, away_key, d FROM clean", "matches", clash=CLASH, clean=CLEAN)),
    "same_day_conflicts": (same_day_conflicts, A.with_views("SELECT team, d, count(*) AS n FROM (SELECT home_key AS team, d FROM matches UNION ALL SELECT away_key, d FROM matches) s GROUP BY team, d HAVING count(*) > 1", "matches")),
    "keep_first_dedupe": (keep_first_dedupe, FIRST),
    "gap_segments": (gap_segments, _chain("SELECT match_id, team, cast(gap AS bigint) AS gap, cast(segment AS bigint) AS segment FROM seg")),
    "rolling_form": (rolling_form, _chain("SELECT match_id, team, round(form_after, 9) AS form_after, round(gf_after, 9) AS gf_after, round(ga_after, 9) AS ga_after FROM log")),
    "rolling_shift_form": (rolling_shift_form, _chain(f"SELECT match_id, team, round({_mean('points', 5, 3, True)}, 9) AS form_before, round({_mean('goals_for', 10, 5, True)}, 9) AS gf_before FROM seg")),
    "rolling_share": (rolling_share, _chain("SELECT match_id, team, round(sot_share_after, 9) AS sot_share, round(shot_share_after, 9) AS shot_share FROM shots")),
    "asof_strict_stale": (form_as_of, _chain(_asof_sql("form:form_after", ">", GAP), probes=PROBES)),
    "asof_inclusive": (asof_inclusive, _chain(_asof_sql("form:form_after,gf:gf_after", ">=", None), probes=PROBES)),
    "asof_last_row_null": (asof_last_row_null, _chain(_asof_sql("shots:shots_for", ">", None, "sides"), probes=PROBES)),
    "asof_many": (asof_many, ASOF_MANY),
    "rest_days": (rest_days, REST),
    "month_snapshot_fanout": (month_snapshot_fanout, _squads("SELECT player_id, club_id, snapshot FROM roster")),
    "snapshot_topk_sum": (snapshot_topk_sum, _squads("SELECT club_id, snapshot, round(total, 2) AS total, n FROM totals")),
    "reference_median_diff": (reference_median_diff, _squads(SQUAD_VALUES)),
    "value_index_median": (value_index_median, A.with_views("SELECT month, round(idx, 6) AS idx FROM idx", "appearances", "valuations", **INDEX_VIEWS)),
    "club_match_ordinal": (club_match_ordinal, A.with_views("SELECT club_id, game_id, d, idx FROM games", "appearances", games=GAMES)),
    "last5_minutes_rank": (last5_minutes_rank, A.with_views("SELECT club_id, tidx, player_id, cast(minutes AS bigint) AS minutes, rank FROM ranked", "appearances", games=GAMES, ranked=RANKED)),
    "xi_conditional_sums": (xi_conditional_sums, _players_sql("SELECT club_id, tidx, count(value_eur) AS valued, round(sum(CASE WHEN pos = 'Attack' THEN value_eur END), 2) AS attack, round(avg(age), 6) AS age, cast(sum(minutes_at) AS bigint) AS minutes_at FROM lineups WHERE rank < 11 GROUP BY club_id, tidx")),
    "trailing_range_sum": (trailing_range_sum, _players_sql("SELECT club_id, tidx, player_id, cast(d_minutes AS bigint) AS d_minutes, cast(d_ga AS bigint) AS d_ga, cast(d_uefa AS bigint) AS d_uefa FROM xi")),
    "trailing_window_sum": (trailing_window_sum, RANGE),
    "player_state": (player_state, _players_sql("SELECT club_id, tidx, d, " + ", ".join(f"round({m}, 5) AS {m}" for m in store.PLAYER_METRICS) + " FROM state")),
    "percentile_newcomer": (percentile_newcomer, NEWCOMER),
    "elo_plain": (elo_plain, ELO),
    "elo_incremental": (elo_incremental, ELO),
    "elo_full": (elo_full, None),
    "elo_grid_objective": (elo_grid_objective, None),
    "elo_grid_argmin": (elo_grid_argmin, None),
    "feature_assembly": (feature_assembly, None),
    "check_form_leakage": (check_form_leakage, LEAKS),
    "check_rating_consistency": (check_rating_consistency, None),
    "check_player_state": (check_player_state, None),
    "seeded_sample": (seeded_sample, None),
}
