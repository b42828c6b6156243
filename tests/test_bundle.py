"""Fitted models on disk, single predictions, and the feature store against independent code."""

import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.catalog import features
from touchline.operators import checks, models, rating
from touchline.params import FEATURES, PLAYER_METRICS, Params, contract, definition
from touchline.plans import bundle, weekly
from touchline.plans.store import Store
from touchline.sources import sinks

COLUMNS = ["elo_diff", "is_knockout", "is_uefa", "home_xi_value", "away_xi_value", "xi_value_diff"]
ENSEMBLE = {"weights": {"classifier": 0.45, "logistic": 0.25, "poisson": 0.3}, "rho": -0.03, "temperature": 0.92, "max_goals": 10}
RATING = {"k": 10.0, "uefa_mult": 3.0, "market_k": 10.0, "market_weight": 0.5}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(4)
    out = []
    for k in range(400):
        x = float(rnd.normal(0, 100))
        home, away = int(rnd.poisson(1.5 * np.exp(x / 400))), int(rnd.poisson(1.2 * np.exp(-x / 400)))
        v = float(rnd.normal())
        out.append((k, date(2020, 1, 1) + timedelta(days=2 * k), x, float(k % 10 == 0 and k % 3 == 0), float(k % 3 == 0), v if k % 7 else None, 0.5, v - 0.5 if k % 7 else None, home, away, 0 if home > away else 1 if home == away else 2))
    return spark.createDataFrame(out, "match_id long, d date, " + ", ".join(f"{c} double" for c in COLUMNS) + ", home_goals int, away_goals int, target int").withColumn("competition", F.when(F.col("is_uefa") == 1, F.when(F.col("match_id") % 2 == 0, "CL").otherwise("CLQ")).otherwise("L1")).persist()


@pytest.fixture(scope="module")
def fitted(rows):
    parts = {"classifier": models.Boosted(COLUMNS, trees=2, depth=2, step=0.3, least=5.0), "logistic": models.Logistic(COLUMNS), "poisson": models.BoostedGoals(COLUMNS, trees=2, depth=2, step=0.3, least=5.0, rho=-0.03)}
    return bundle.fit(rows, parts, date(2021, 7, 1), ENSEMBLE, RATING, refit_all=True)


def test_bundle_comes_back_as_it_was(spark, rows, fitted, tmp_path):
    made, measured = fitted
    assert {r["model"] for r in measured.collect()} == {"classifier", "logistic", "poisson", "ensemble", "class_frequencies"}
    assert {r["subset"] for r in measured.collect()} == {"all", "domestic", "uefa", "uefa_main", "knockout"}
    path = str(tmp_path / "model")
    made.save(path)
    back = bundle.load(spark, path)
    assert back.about["warnings"] == [] and back.about["data_end"] == str(date(2020, 1, 1) + timedelta(days=798)) and back.about["refit_all"]
    one, two = ({r["match_id"]: r for r in b.predict(rows).collect()} for b in (made, back))
    assert all(one[k][c] == pytest.approx(two[k][c]) for k in one for c in ("home_win", "draw", "away_win"))
    assert all(sum(r[c] for c in ("home_win", "draw", "away_win")) == pytest.approx(1) for r in one.values())


@pytest.mark.parametrize("change,message", [({"hash": "0"}, "hash"), ({"classes": ["draw", "home_win", "away_win"]}, "classes"), ({"params": {}}, "params"), ({"features": []}, "features")])
def test_bundle_that_does_not_keep_the_contract(spark, fitted, tmp_path, change, message):
    path = str(tmp_path / "model")
    fitted[0].save(path)
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if "hash" in change:
        m["hash"] = "0"
    else:
        m["contract"] |= change
        m["hash"] = bundle.contract_hash(m["contract"])
    spark.createDataFrame([(json.dumps(m),)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(checks.SchemaMismatch, match=message):
        bundle.load(spark, path)


def test_other_versions_are_told(spark, fitted, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    fitted[0].save(path)
    now = bundle.versions()
    monkeypatch.setattr(bundle, "versions", lambda: now | {"numpy": "0"})
    assert bundle.load(spark, path).about["warnings"] == [f"numpy: fitted with {now['numpy']}, here 0"]


class FixedStore(Store):
    def compute(self, fixtures):
        values = {c: F.lit(1.5) for c in FEATURES if c not in fixtures.columns} | {"elo_diff": F.when(F.col("home_key") == "tm:1", 30.0)}
        return fixtures.withColumns(values).withColumn("home_elo", F.when(F.col("home_key") == "tm:1", 1500.0)).withColumn("away_elo", F.lit(1400.0))


def test_predictor(spark, fitted):
    clubs = spark.createDataFrame([("tm:1", "Alpha", "1"), ("tm:2", "Beta", "1"), ("tm:3", "Gamma", None)], "key string, display string, country string")
    p = bundle.Predictor(fitted[0], FixedStore({}, RATING), clubs.select("key", F.col("display").alias("alias")), clubs)
    got = p.predict("Alpha", "tm:2", date(2026, 9, 1))
    assert sum(got.values()) == pytest.approx(1) and list(got) == ["home_win", "draw", "away_win"]
    assert p.features_for("Alpha", "Beta", date(2026, 9, 1)).first()["is_uefa"] == 0.0
    assert p.features_for("Alpha", "Gamma", date(2026, 9, 1)).first()["is_uefa"] == 1.0
    row = p.features_for("Alpha", "Beta", date(2026, 9, 1), overrides={"home_xi_value": 4.0}).first()
    assert (row["home_xi_value"], row["xi_value_diff"]) == (4.0, 2.5)
    row = p.features_for("Alpha", "Beta", date(2026, 9, 1), overrides={"home_xi_value": 4.0, "xi_value_diff": 9.0}).first()
    assert row["xi_value_diff"] == 9.0
    with pytest.raises(ValueError, match="may not be set"):
        p.features_for("Alpha", "Beta", date(2026, 9, 1), overrides={"elo_diff": 1.0})
    with pytest.raises(checks.SchemaMismatch):
        p.features_for("Alpha", "Beta", date(2026, 9, 1), overrides={"home_form": 1.0})
    with pytest.raises(checks.UnknownTeam, match=r"Alphq: unresolved, candidates \['Alpha \(tm:1\)'"):
        p.resolve_teams(["Beta", "Alphq"])
    with pytest.raises(ValueError, match="no rating"):
        p.predict("Beta", "Alpha", date(2026, 9, 1))
    with pytest.raises(checks.SchemaMismatch, match="ratings"):
        bundle.Predictor(fitted[0], FixedStore({}, RATING | {"k": 1.0}), clubs, clubs)


def test_definitions_and_page(spark, tmp_path):
    value = contract(FEATURES, RATING, ENSEMBLE)
    assert len(value["features"]) == 41 and all(f["definition"] for f in value["features"]) and "{" not in "".join(f["definition"] for f in value["features"])
    assert definition("home_form").startswith("home team: mean points of the last 5")
    sinks.contract_page(str(tmp_path / "page.md"), value)
    assert "mean points of the last 5" in (tmp_path / "page.md").read_text() and sinks.read_contract(spark, str(tmp_path / "page.md")) == json.loads(json.dumps(value))


def test_promotion_and_metrics_of_production(spark, tmp_path):
    staged, live, old = tmp_path / "staged", tmp_path / "live", tmp_path / "old"
    for d in (staged, live):
        d.mkdir()
    (live / "metrics.json").write_text('{"v": 1}')
    (staged / "metrics.json").write_text('{"v": 2}')
    (staged / "extra.csv").write_text("x")
    assert weekly.production_metrics(spark, str(tmp_path / "none.json")) == {} and weekly.production_metrics(spark, str(live / "metrics.json")) == {"v": 1}
    assert weekly.promote(str(staged), str(live), str(old), "2026-09-01", ["metrics.json", "extra.csv", "absent"]) == (["metrics.json"], ["metrics.json", "extra.csv"])
    assert weekly.production_metrics(spark, str(live / "metrics.json")) == {"v": 2} and (old / "2026-09-01" / "metrics.json").read_text() == '{"v": 1}'
    assert weekly.data_end({"data_end": "2026-01-02"}) == date(2026, 1, 2)
    assert weekly.data_end({"refit_all": True, "data_range": {"test": {"to": "2026-03-04"}, "development": {"to": "2025-01-01"}}}) == date(2026, 3, 4)


def test_early_stopping_and_searches(rows):
    stopped = models.Boosted(["elo_diff"], trees=6, depth=2, step=0.5, patience=2).fit(rows.where("d < '2021-07-01'"), date(2021, 7, 1), date(2021, 1, 1))
    assert all(0 <= n <= 6 for n in stopped.settings["rounds"])
    assert len(models.grid_points(models.BOOSTED_GRID)) == 108 and models.BOOSTED_BASELINE in models.grid_points(models.BOOSTED_GRID)
    assert len(models.grid_points(models.LOGISTIC_GRID)) == 6
    spans = [{"fold": 1, "stop_from": date(2020, 10, 1), "val_start": date(2021, 1, 1), "val_end": date(2021, 7, 1)}]
    best, log = models.search_logistic(rows, spans, ["elo_diff"])
    assert len(log) == 6 and best in models.grid_points(models.LOGISTIC_GRID)
    chosen, tried = models.search_boosted(rows, spans, ["elo_diff"], n=2, trees=2, step=0.5)
    assert len(tried) == 2 and chosen["n_estimators"] >= 1 and {"penalty", "least", "depth"} <= chosen.keys()
    chosen, tried = models.search_goals(rows, spans, ["elo_diff"], trees=2, step=0.5, least=5.0)
    assert {t["depth"] for t in tried} == {3, 4} and chosen["depth"] in (3, 4)


# -- ratings by plain code ------------------------------------------------------------


def ratings_by_hand(rows, k, mult, weight, p, burn_in):
    """Each match's ratings before it, from dictionaries; written apart from the engine."""
    played, kept, table = {}, {}, {}
    cut = (p.elo_burn_in_end - date(1970, 1, 1)).days
    days = sorted({r["day"] for r in rows})

    def one_pass(which, note):
        now, homes = {}, {}
        for day in which:
            games = sorted((r for r in rows if r["day"] == day), key=lambda r: (r["home_key"], r["match_id"]))
            delta = {}
            for g in games:
                for side in ("home", "away"):
                    team, land = g[f"{side}_key"], g[f"{side}_country"]
                    if team in now:
                        continue
                    same = sorted(now[t] for t in now if homes[t] == land)
                    if team in kept:
                        now[team] = kept[team]
                    elif len(same) < p.elo_newcomer_pool:
                        now[team] = p.elo_base
                    else:
                        at = (len(same) - 1) * p.elo_newcomer_percentile / 100
                        low = same[int(at)]
                        now[team] = low + (at - int(at)) * (same[min(int(at) + 1, len(same) - 1)] - low)
                    homes[team] = land
                note(g["match_id"], now[g["home_key"]], now[g["away_key"]])
            start = dict(now)
            for g in games:
                gap = start[g["home_key"]] - start[g["away_key"]] + p.elo_home_advantage * (1 - g["neutral"])
                e = 1 / (1 + 10 ** (-gap / 400))
                plain = g["goal_mult"] * (g["score"] - e)
                step = plain if g["market"] is None or not weight else weight * (g["market"] - e) + (1 - weight) * plain
                step *= k * (mult if g["is_uefa"] else 1)
                for team, sign in ((g["home_key"], 1), (g["away_key"], -1)):
                    fast = p.elo_provisional_mult if played.get(team, 0) < p.elo_provisional_matches else 1
                    delta[team] = delta.get(team, 0) + sign * fast * step
            for team, x in delta.items():
                now[team] += x
                played[team] = played.get(team, 0) + 1
        return now

    if burn_in:
        for _ in range(p.elo_burn_in_passes):
            kept = one_pass([d for d in days if d < cut], lambda *x: None)
    one_pass(days, lambda m, h, a: table.__setitem__(m, (h, a)))
    return table


def test_ratings_against_plain_code(spark, small):
    m = features._clean(spark, small)
    rows = rating.engine_rows(m, features._countries(spark, small))
    plain = [r.asDict() for r in rows.collect()]
    cells = [(0, 10.0, 3.0, 0.0), (1, 20.0, 1.0, 0.5)]
    grid = spark.createDataFrame(cells, rating.GRID)
    for p, burn in ((features.FULL, True), (Params(elo_newcomer_pool=2), False)):
        got = {(r["cfg"], r["match_id"]): (r["pre_home"], r["pre_away"]) for r in rating.run(rows, grid, p, burn).collect()}
        for cfg, k, mult, weight in cells:
            want = ratings_by_hand(plain, k, mult, weight, p, burn)
            assert len(want) == len(plain)
            for i, pair in want.items():
                assert got[cfg, i] == pytest.approx(pair, abs=1e-6)


def test_objective_of_the_grid_against_plain_code(spark, small):
    m = features._clean(spark, small)
    got = {(r["k"], r["uefa_mult"]): r for r in features.elo_grid_objective(spark, small).collect()}
    assert len(got) == 25
    plain = [r.asDict() for r in rating.engine_rows(m).collect()]
    about = {r["match_id"]: r for r in m.select("match_id", "d", "tier", "is_uefa").collect()}
    for k, mult in ((5.0, 1.0), (20.0, 6.0)):
        before = ratings_by_hand(plain, k, mult, 0.0, features.FULL, True)
        errors = {True: [], False: []}
        for r in plain:
            i = about[r["match_id"]]
            if date(1997, 1, 1) <= i["d"] < date(2001, 1, 1) and (i["tier"] == 1 or i["is_uefa"]):
                h, a = before[r["match_id"]]
                e = 1 / (1 + 10 ** (-(h - a + 55.0 * (1 - r["neutral"])) / 400))
                errors[bool(i["is_uefa"])].append((e - r["score"]) ** 2)
        want = (np.mean(errors[False]), np.mean(errors[True]))
        assert (got[k, mult]["mse_domestic"], got[k, mult]["mse_uefa"]) == pytest.approx(want, abs=1e-7)
    best = features.elo_grid_argmin(spark, small).first()
    assert best["objective"] == min(r["objective"] for r in got.values())


def test_assembled_features_against_independent_code(spark, small):
    """Ratings, form, goals and shots of the assembled frame against other ways to the same; line-ups row by row."""
    m = features._clean(spark, small)
    s = features._store(spark, small, m)
    frame = s.compute(features._fixtures(m)).persist()
    assert frame.count() == m.count() and [c for c in frame.columns if c in FEATURES] == FEATURES
    checks.frame_contract(frame)
    checks.verify(checks.form_leakage(m, frame, gap_days=features.GAP).unionByName(checks.shots_leakage(m, frame, gap_days=features.GAP)))
    plain = [r.asDict() for r in rating.engine_rows(m).collect()]
    market = {r["match_id"]: r for r in plain}
    own, book = ratings_by_hand(plain, 10.0, 3.0, 0.0, features.FULL_FEATURES, True), ratings_by_hand(plain, 10.0, 3.0, 0.5, features.FULL_FEATURES, True)
    rows = frame.collect()
    known = 0
    for r in rows:
        bonus = 55.0 * (1 - market[r["match_id"]]["neutral"])
        for feature, table in (("elo_diff", own), ("mkt_elo_diff", book)):
            if r[feature] is not None:
                h, a = table[r["match_id"]]
                known += 1
                assert r[feature] == pytest.approx(h - a + bonus, abs=1e-6)
    assert known > len(rows) / 2
    apps, vals = features._apps(spark, small), features.A.valuations(spark, small)
    index = features.snapshot.value_index(apps, vals, features._reference(spark, small), features.FULL_FEATURES)
    sides = m.select("match_id", F.col("home_key").alias("club_id"), "d").limit(200)
    slow = checks.brute_force_state(apps, vals, features.A.players(spark, small), index, sides.select("club_id", "d").distinct(), features.FULL_FEATURES)
    both = sides.join(slow, ["club_id", "d"], "left").join(frame.select("match_id", *[F.col(f"home_{x}").alias(f"f_{x}") for x in PLAYER_METRICS]), "match_id")
    bad = both.agg(*[F.count_if(checks.differs(F.col(f"f_{x}"), F.col(x))).alias(x) for x in PLAYER_METRICS]).first().asDict()
    assert not any(bad.values()), bad
    assert all((r["home_xi_value"] is None or r["away_xi_value"] is None) == (r["xi_value_diff"] is None) and (r["home_rest_days"] is None or 0 < r["home_rest_days"] <= 30) for r in rows)
