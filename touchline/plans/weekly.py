"""The periodic run: live performance, reasons to retrain, the gate before promotion, the report."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.functions import scalar
from touchline.operators import metrics
from touchline.params import DEFAULT, Params
from touchline.session import exists
from touchline.sources import releases, sinks


def live_performance(scored: DataFrame, since: date, least_uefa: int = 30) -> DataFrame:
    """``n, log_loss, n_market, model_on_market, market_log_loss, gap, uefa_log_loss`` of matches after ``since``.

    ``scored``: d, y, is_uefa, p0, p1, p2 and the odds. The gap is measured on rows with odds.
    """
    market = scalar.market_probabilities("odds_home", "odds_draw", "odds_away")
    rows = scored.where(F.col("d") > F.lit(since)).withColumn("_m", market)
    model = metrics.log_loss("y", ["p0", "p1", "p2"])
    book = metrics.log_loss("y", [F.col("_m.home"), F.col("_m.draw"), F.col("_m.away")])
    known = F.col("_m").isNotNull()
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(model).alias("log_loss"), F.count_if(known).alias("n_market"), F.avg(F.when(known, model)).alias("model_on_market"), F.avg(F.when(known, book)).alias("market_log_loss"),
        F.count_if("is_uefa").alias("n_uefa"), F.avg(F.when(F.col("is_uefa"), model)).alias("_u"),
    )
    return out.withColumn("gap", F.col("model_on_market") - F.col("market_log_loss")).withColumn("uefa_log_loss", F.when(F.col("n_uefa") >= least_uefa, F.col("_u"))).drop("_u")


def live_rows(matches: DataFrame, predicted: DataFrame, since: date) -> DataFrame:
    """Matches to measure a model on: played after ``since``, of a first division or international, with a rating.

    ``predicted``: match_id, the three probabilities and ``elo_missing``. The result fits ``live_performance``.
    """
    played = matches.where((F.col("d") > F.lit(since)) & ((F.col("tier") == 1) | F.col("is_uefa").cast("boolean")))
    known = predicted.where(~F.col("elo_missing")).select("match_id", *[F.col(c).alias(f"p{k}") for k, c in enumerate(DEFAULT.class_labels)])
    return played.withColumn("y", scalar.class_index(scalar.result("home_goals", "away_goals"))).where("y is not null").join(known, "match_id")


def market_reference(df: DataFrame, least: int = 100) -> DataFrame:
    """Margin-free market probabilities of the rows that have them; no row where there are fewer than ``least``."""
    rows = df.withColumn("m", scalar.market_probabilities("odds_home", "odds_draw", "odds_away")).where("m is not null")
    enough = rows.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(F.broadcast(enough), how="cross").drop("_n")


def retrain_reasons(trained: date, today: date, test_from: date | None, live: dict | None, reference_gap: float | None, params: Params = DEFAULT) -> list[str]:
    """Why to retrain: the model's age, a season to test on that is no longer the model's, or a gap to the market that has grown on enough matches."""
    found = []
    if (today - trained).days >= params.retrain_age_days:
        found.append(f"trained {(today - trained).days} days ago")
    if test_from is not None and test_from != default_test_from(today):
        found.append(f"tested from {test_from}, now {default_test_from(today)}")
    if live and reference_gap is not None and live.get("gap") is not None and live.get("n_market", 0) >= params.retrain_min_matches and live["gap"] > reference_gap + params.retrain_gap_worse:
        found.append(f"gap to the market {live['gap']:.4f}, was {reference_gap:.4f}")
    return found


def gate(candidate: dict, production: dict | None, params: Params = DEFAULT) -> list[str]:
    """Why a candidate may not be promoted: no better than class frequencies, or clearly worse than production."""
    wrong = []
    if not candidate["log_loss"] < candidate["baseline_log_loss"] - params.gate_baseline_margin:
        wrong.append("no better than class frequencies")
    if production and production.get("cv_objective") is not None and candidate["cv_objective"] > production["cv_objective"] + params.gate_slack:
        wrong.append("worse than the model in production")
    if not candidate.get("predicts", True):
        wrong.append("a trial prediction failed")
    return wrong


def default_test_from(today: date) -> date:
    """The first day of the last season that has ended."""
    start = today.year if today.month >= 7 else today.year - 1
    return date(start - 1, 7, 1)


def production_metrics(spark: SparkSession, path: str) -> dict:
    """The metrics document of the model in production; empty where there is none."""
    if not exists(spark, path):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def released_metrics(spark: SparkSession, root: str, name: str = "metrics.json") -> dict:
    """The metrics document of the release in use (``sources.releases``); empty where there is none."""
    place = releases.current(spark, root)
    return production_metrics(spark, f"{place}/{name}") if place else {}


def data_end(about: dict) -> date:
    """The day of the last match that a model was fitted on; older documents tell it by the range of the part it was fitted on."""
    if about.get("data_end"):
        return date.fromisoformat(str(about["data_end"])[:10])
    part = "test" if about.get("refit_all") else "development"
    return date.fromisoformat(str(about["data_range"][part]["to"])[:10])


def promote(staging: str, production: str, archive: str, stamp: str, names: list[str]) -> tuple[list[str], list[str]]:
    """Archives the files in production under ``stamp``, then puts the staged ones in their place: names archived, names promoted."""
    old = sinks.archive(production, names, f"{archive}/{stamp}")
    return old, sinks.archive(staging, names, production)


def report_text(report: dict, params: Params = DEFAULT) -> str:
    """The periodic run as Markdown, a section for each part of it; those without anything to tell say so.

    ``report``: started, status and, where there, data (dict), last_match_by_source, trained_at, data_end, live (a row of
    ``live_performance`` as a dict, with since and until), reasons, result, checks (name and whether passed), export,
    warnings, error.
    """
    bullets = lambda rows: [f"- {r}" for r in rows]
    sections = {
        "Data": bullets([*(f"{k}: {v}" for k, v in (report.get("data") or {}).items()), f"last match by source: {report.get('last_match_by_source', '-')}"]),
        "Model": bullets([f"trained at: {report.get('trained_at', '-')}", f"last match of its data: {report.get('data_end', '-')}"]),
        "Live performance": bullets(_live_lines(report.get("live") or {}, params)),
        "Retraining": bullets([f"reasons: {', '.join(report.get('reasons') or []) or 'none'}", f"result: {report.get('result', 'not done')}"])
        + [f"  - [{'x' if ok else ' '}] {name}" for name, ok in report.get("checks") or []],
        "Forecast table": bullets([report.get("export", "-")]),
    }
    if report.get("warnings"):
        sections["Warnings"] = bullets(report["warnings"])
    if report.get("error"):
        sections["Error"] = ["```text", str(report["error"]), "```"]
    head = f"# Weekly report, {report['started']}\n\n**Status:** {report['status']}\n"
    return head + "".join(f"\n## {title}\n\n" + "\n".join(lines) + "\n" for title, lines in sections.items())


def _live_lines(live: dict, params: Params) -> list[str]:
    if not live.get("n"):
        return ["no match played since the model was trained"]
    found = [f"{live.get('since', '-')} to {live.get('until', '-')}: {live['n']} matches, log loss {live['log_loss']:.4f}"]
    if live.get("uefa_log_loss") is not None:
        found.append(f"international: {live['n_uefa']} matches, log loss {live['uefa_log_loss']:.4f}")
    if live.get("gap") is not None:
        found.append(f"against closing odds: {live['n_market']} matches, model {live['model_on_market']:.4f}, market {live['market_log_loss']:.4f}, gap {live['gap']:+.4f}")
    if live["n"] < params.retrain_min_matches:
        found.append(f"fewer than {params.retrain_min_matches} matches: still noisy")
    return found


def history_rows(report: dict) -> tuple[dict, dict | None]:
    """What a run adds to the log of runs, and to that of live performance (None before the first match)."""
    live = report.get("live") or {}
    run = {
        "started": report["started"], "status": report["status"], "live_n": int(live.get("n") or 0), "live_log_loss": live.get("log_loss"), "live_gap": live.get("gap"),
        "result": report.get("result", "not done"), "warnings": " | ".join(report.get("warnings") or []),
    }
    return run, {"run": report["started"], **live} if live.get("n") else None


def training_rows(features: DataFrame, start: date = DEFAULT.elo_burn_in_end) -> DataFrame:
    """First-tier and international matches from ``start`` on that have a rating difference, with their class."""
    kept = features.where((F.col("d") >= F.lit(start)) & ((F.col("tier") == 1) | (F.col("is_uefa") == 1)) & F.col("elo_diff").isNotNull())
    return kept.withColumn("target", scalar.class_index(scalar.result("home_goals", "away_goals")))
