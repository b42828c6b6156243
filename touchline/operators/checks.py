"""Leakage and consistency checks: each gives rows with numbers of mismatches, ``verify`` raises on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions.scalar import log10_or_null, month_start
from touchline.operators import rolling
from touchline.params import DEFAULT, FEATURES, Params
from touchline.session import checkpointed


class SchemaMismatch(RuntimeError):
    """A model, a store or a frame of features does not keep the contract."""


class UnknownTeam(ValueError):
    """A name that no team, or more than one, answers to."""


def differs(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """True unless both are NULL, or close."""
    far = F.abs(a - b) > tolerance + 1e-5 * F.abs(b)
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(far)


def _of_sides(matches: DataFrame, features: DataFrame, expected: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Mismatches of ``{side}_{feature}`` with a team's expected value on the day, by feature."""
    out = None
    for side in ("home", "away"):
        joined = matches.select("match_id", F.col(f"{side}_key").alias("team"), F.col("d").alias("day")).join(features, "match_id").join(expected, ["team", "day"])
        bad = joined.agg(*[F.count_if(differs(F.col(f"{side}_{f}"), F.col(e))).alias(f"{side}_{f}") for f, e in pairs.items()], F.count(F.lit(1)).alias("n"))
        rows = bad.select(F.inline(F.array(*[F.struct(F.lit(f"{side}_{f}").alias("feature"), F.col(f"{side}_{f}").alias("mismatches"), F.col("n").alias("n")) for f in pairs])))
        out = rows if out is None else out.unionByName(rows)
    return out


def form_leakage(matches: DataFrame, features: DataFrame, params: Params = DEFAULT, gap_days: int | None = None) -> DataFrame:
    """Looked-up form and goals against means of the rows before each match. The lookup also bounds staleness by the gap, as segments do."""
    log = rolling.segments(rolling.both_sides(matches), gap_days or params.gap_days)
    expected = log.withColumns(
        {
            "x_form": rolling.rolling_mean("points", params.form_window, params.form_min, shifted=True),
            "x_goals_for": rolling.rolling_mean("goals_for", params.goals_window, params.goals_min, shifted=True),
            "x_goals_against": rolling.rolling_mean("goals_against", params.goals_window, params.goals_min, shifted=True),
        }
    ).select("team", "day", "x_form", "x_goals_for", "x_goals_against")
    return _of_sides(matches, features, expected, {"form": "x_form", "goals_for": "x_goals_for", "goals_against": "x_goals_against"})


def shots_leakage(matches: DataFrame, features: DataFrame, params: Params = DEFAULT, gap_days: int | None = None) -> DataFrame:
    """The same for the share of shots on target, on matches with shot data."""
    log = rolling.shots_log(matches, params, gap_days)
    expected = log.withColumn("x_sot_share", rolling.rolling_share("sot_for", "sot_total", params.shots_window, params.shots_min, shifted=True)).select("team", "day", "x_sot_share")
    shot = matches.dropna(subset=["home_sot", "away_sot", "home_shots", "away_shots"])
    return _of_sides(shot, features, expected, {"sot_share": "x_sot_share"})


def rating_consistency(rated: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Ratings looked up by day against the engine's ratings before each match, where one was found."""
    joined = rated.join(looked_up, "match_id")
    bad = [F.count_if(F.col(f"{s}_elo").isNotNull() & differs(F.col(f"{s}_elo"), F.col(f"pre_{s}"))).alias(f"{s}_mismatches") for s in ("home", "away")]
    return joined.agg(*bad, F.count_if(F.col("home_elo").isNotNull()).alias("known_home"), F.count_if(F.col("away_elo").isNotNull()).alias("known_away"))


def brute_force_state(appearances: DataFrame, valuations: DataFrame, players: DataFrame, index: DataFrame, sampled: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``club_id, d`` and the eleven metrics of sampled club days, from all rows before each, by range joins: nothing of the fast path is used.

    ``sampled``: club_id, d; a few hundred rows. ``appearances`` has ``uefa``. Rows of other clubs and players are left out
    where they are read, so what is shuffled and joined grows with the sample and not with the tables.
    """
    at = ["club_id", "at"]
    of = lambda rows, some, key: rows.join(F.broadcast(some.select(key).distinct()), key, "left_semi")
    mine = checkpointed(of(appearances, sampled, "club_id"))
    past = mine.join(F.broadcast(sampled.select("club_id", F.col("d").alias("at"))), "club_id").where("d < at")
    games = past.groupBy(*at, "game_id").agg(F.min("d").alias("d"))
    games = games.withColumn("back", F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("d"), F.desc("game_id"))))
    last = games.where("back = 1").select(*at, F.col("d").alias("t"), F.col("game_id").alias("last_game")).where(F.datediff("at", "t") <= params.player_gap_days)
    recent = past.join(games.where(F.col("back") <= params.player_matches).select(*at, "game_id"), [*at, "game_id"])
    minutes = recent.groupBy(*at, "player_id").agg(F.sum("minutes").alias("minutes"))
    ranked = minutes.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("minutes"), "player_id"))).where(F.col("rank") <= params.xi_size + params.bench_size)
    # read several times below; some twenty rows of each club day
    ranked = checkpointed(ranked.select(*at, "player_id", (F.col("rank") <= params.xi_size).alias("xi")).join(last, at))
    one = [*at, "player_id"]
    seen = ranked.join(of(valuations, ranked, "player_id"), "player_id").where("d <= t").groupBy(*one, "t").agg(F.max(F.struct("d", "value_eur")).alias("v"))
    values = seen.where(F.datediff("t", "v.d") <= params.valuation_max_age).select(*one, F.col("v.value_eur").alias("value"))
    own = of(appearances, ranked, "player_id").select("player_id", F.col("d").alias("day"), F.col("minutes").alias("m"), (F.col("goals") + F.col("assists")).alias("ga"), "uefa")
    ago = F.datediff("t", "day")
    did = ranked.join(own, "player_id").where("day <= t").groupBy(*one).agg(
        F.sum(F.when(ago < params.production_days, F.col("m"))).alias("m"), F.sum(F.when(ago < params.production_days, F.col("ga"))).alias("ga"), F.count_if((ago < params.uefa_experience_days) & F.col("uefa").cast("boolean")).alias("games")
    )
    here = mine.select("club_id", F.col("game_id").alias("last_game"), "player_id", F.col("minutes").alias("now"))
    full = ranked.join(values, one, "left").join(did, one, "left").join(here, ["club_id", "last_game", "player_id"], "left").join(of(players, ranked, "player_id"), "player_id", "left")
    first = lambda c: F.when(F.col("xi"), c)
    lines = {"att": "Attack", "mid": "Midfield", "def": "Defender", "gk": "Goalkeeper"}
    sums = full.groupBy(*at, "t").agg(
        F.sum(first(F.col("value"))).alias("total"), F.count(first(F.col("value"))).alias("n"), F.max(first(F.col("value"))).alias("most"), F.sum(F.when(~F.col("xi"), F.col("value"))).alias("bench"), F.count(F.when(~F.col("xi"), F.col("value"))).alias("n_bench"),
        *[F.sum(first(F.when(F.col("pos") == p, F.col("value")))).alias(n) for n, p in lines.items()], F.sum(first(F.col("m"))).alias("m"), F.sum(first(F.col("ga"))).alias("ga"),
        F.avg(first(F.datediff("t", "born") / 365.25)).alias("xi_age"), F.avg(first(F.coalesce("games", F.lit(0)))).alias("xi_uefa_apps"), F.sum(first(F.when(F.col("now") >= params.continuity_minutes, F.col("value")))).alias("kept"),
    )
    both = sums.join(index, month_start("t") == F.col("month"), "left")
    enough = F.col("n") >= params.xi_min_valued
    over_index = lambda c: F.when(enough, log10_or_null(c) - F.col("idx"))
    return both.select(
        "club_id", F.col("at").alias("d"), over_index("total").alias("xi_value"), over_index("most").alias("xi_star"), F.when(F.col("n_bench") >= params.bench_min_valued, log10_or_null("bench") - F.col("idx")).alias("bench_value"),
        *[over_index(n).alias(f"{n}_value") for n in lines], F.when(F.col("m") >= params.production_min_minutes, 90.0 * F.col("ga") / F.col("m")).alias("xi_ga90"), "xi_age", "xi_uefa_apps",
        F.when(enough & (F.col("total") > 0), F.coalesce("kept", F.lit(0)) / F.col("total")).alias("xi_last_match_share"),
    )


def frame_contract(df: DataFrame, columns: list[str] = FEATURES) -> None:
    """Names, order and types of a frame of features, and no infinite value."""
    found = [c for c in df.columns if c in columns]
    if found != columns:
        raise SchemaMismatch(f"columns: {[c for c in columns if c not in found] or found}")
    wrong = [c for c, t in df.dtypes if c in columns and t != "double"]
    if wrong:
        raise SchemaMismatch(f"not double: {wrong}")
    infinite = df.agg(*[F.count_if(F.abs(c) == float("inf")).alias(c) for c in columns]).first()
    if any(infinite):
        raise SchemaMismatch(f"infinite: {[c for c, n in zip(columns, infinite) if n]}")


def verify(mismatches: DataFrame) -> None:
    bad = mismatches.where("mismatches > 0").limit(20).collect()
    if bad:
        raise AssertionError("; ".join(f"{r['feature']}: {r['mismatches']} of {r['n']}" for r in bad))
