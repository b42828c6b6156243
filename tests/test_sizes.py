"""Queries on tables larger than the smallest ones."""

import duckdb
import pytest

from touchline import catalog

@pytest.fixture(scope="module")
def tables(small, tmp_path_factory):
    """Orders of sf0.01 and six times its customers, that is over 1 500."""
    d, one = tmp_path_factory.mktemp("tables"), small.replace("0.001", "0.01")
    duckdb.sql(f"COPY (SELECT c_custkey + r.range*1500 AS c_custkey FROM '{one}/customer.parquet', range(6) r) TO '{d}/customer.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{one}/orders.parquet') TO '{d}/orders.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["match_unpivot", "same_day_conflict_anti", "asof_many", "rolling_form", "cooccurrence_map", "elo_plain"])
def test_matches_are_those_of_the_sql(spark, tables, name):
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{tables}/orders.parquet'")
    df = catalog.queries()[name](spark, tables)
    columns = sorted(df.columns)
    want = c.sql(catalog.oracle_sql()[name]).select(*[f'"{x}"' for x in columns]).fetchall()
    assert want and sorted(map(str, df.select(*columns).collect())) == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(columns, r)) + ")" for r in want)


def _exchanges(df) -> list[str]:
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as out:
        df.explain()
    return [line for line in out.getvalue().splitlines() if "Exchange hashpartitioning" in line]


def test_last_games_are_ranked_with_one_shuffle(spark, small):
    assert len(_exchanges(catalog.queries()["last5_minutes_rank"](spark, small))) == 1


def test_sums_and_values_of_players_are_found_with_one_shuffle_of_each_table(spark, small):
    # appearances by club and by player, what the line-ups ask
    assert len(_exchanges(catalog.queries()["trailing_range_sum"](spark, small))) == 3


def test_medians_by_counted_bins(spark):
    import random

    from pyspark.sql import functions as F

    from touchline.operators import snapshot

    rnd = random.Random(5)
    rows = [(k % 7, rnd.choice([None, rnd.uniform(-2, 2), 1.5])) for k in range(400)] + [(8, 0.25), (9, None), (10, 1.0), (10, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect() if r["m"] is not None}
    got = {r["k"]: r["median"] for r in snapshot.medians(df, "k", "v", 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_newcomers_look_through_their_pool_once_a_day():
    import numpy as np

    from touchline.operators.rating import _Newcomers

    rnd = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        for percentile in (0, 10, 25, 50, 97.5, 100):
            pool = np.round(rnd.normal(1500, 90, (n, 3)), 0)
            today = _Newcomers(pool.copy(), percentile)
            for _ in range(60):
                want = np.percentile(pool, percentile, axis=0)
                assert np.allclose(today.enter(), want, rtol=0, atol=1e-9)
                pool = np.vstack([pool, want])


def test_a_day_of_many_newcomers(monkeypatch):
    import numpy as np

    from touchline.operators import rating
    from touchline.params import Params

    looked = []
    whole = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *k, **more: looked.append(len(a)) or whole(a, *k, **more))
    engine = rating.Engine(np.array([[10.0, 3.0, 0.0]] * 2), Params())
    for day in range(2):
        names = np.array([f"{day}-{k}" for k in range(400)], object)
        none = np.array([None] * 200, object)
        engine.day({"home_key": names[:200], "away_key": names[200:], "home_country": none, "away_country": none, "score": np.ones(200), "goal_mult": np.ones(200), "is_uefa": np.zeros(200, bool), "neutral": np.zeros(200), "market": np.full(200, np.nan)})
    assert len(looked) == 2


def test_clubs_of_one_form_are_one_candidate(spark):
    from touchline.operators import identity

    names = spark.createDataFrame([("1", "Ajax"), ("1", "Gent"), ("2", "Gent")], "country string, name string")
    pool = spark.createDataFrame([(f"tm:{k}", "Ajax", "1") for k in range(40)] + [("tm:90", "KV Gent", None), ("tm:91", "Gent", "2")], "key string, display string, country string")
    assert identity._candidates(names, identity._clubs(names, pool, None)).where("name = 'Ajax'").count() == 1
    got = {(r["country"], r["name"]): (r["key"], r["method"]) for r in identity.tiered_match(names, pool).collect()}
    assert got == {("1", "Ajax"): (None, "ambiguous_normalized"), ("1", "Gent"): ("tm:90", "normalized"), ("2", "Gent"): (None, "ambiguous_normalized")}
    taken = spark.createDataFrame([("2", "tm:90")] + [("1", f"tm:{k}") for k in range(1, 40)], "country string, key string")
    got = {(r["country"], r["name"]): r["key"] for r in identity.tiered_match(names, pool, taken=taken).collect()}
    assert got == {("1", "Ajax"): "tm:0", ("1", "Gent"): "tm:90", ("2", "Gent"): "tm:91"}


def test_pairs_of_teams_are_not_shuffled(spark, small):
    for name in ("fixture_cross_stages", "export_nested_json"):
        assert len(_exchanges(catalog.queries()[name](spark, small))) == 1


def test_documents_by_home_have_the_entries_of_the_whole(spark):
    import json

    from pyspark.sql import functions as F

    from touchline.plans import export

    mapping = spark.createDataFrame([(c, f"t{k}", k) for c in "xy" for k in range(4)], "competition string, name string, key int")
    f = export.fixtures(mapping, "2026-09-01", parts=3)
    assert sorted(f.drop("d").collect()) == sorted(export.fixtures(mapping, "2026-09-01").drop("d").collect()) and f.count() == 72
    p = f.withColumns({"home_win": F.col("home_key") / 10, "draw": F.lit(0.3), "away_win": F.col("away_key") / 10, "lambda_home": F.lit(1.0), "lambda_away": F.lit(2.0), "elo_missing": F.col("home_key") == 2})
    whole = {r["competition"]: json.loads(r["document"]) for r in export.nested(p).collect()}
    parts = export.nested(p, whole=False).collect()
    assert len(parts) == 6 and all(json.loads(r["document"]) == {r["home"]: whole[r["competition"]][r["home"]]} for r in parts)


def test_a_store_deals_appearances_once_by_player_and_once_by_club(spark, small):
    from touchline.catalog import features

    built = features._store(spark, small, features._clean_in_proportion(spark, small))
    # what is grouped by player and something else stays where its player is
    assert not [x for x in _exchanges(built.tables["players"]) if "player_id" in x and "ENSURE_REQUIREMENTS" in x]


def test_days_of_the_burn_in_are_not_held():
    import tracemalloc
    from datetime import date

    import numpy as np

    from touchline.operators import rating
    from touchline.params import Params

    n, many = 300, 2000
    none = np.array([None] * many, object)

    def days():
        for day in range(n):
            keys = np.array([f"{k}" for k in range(many)], object)
            yield {"match_id": np.arange(many), "day": np.full(many, day), "home_key": keys, "away_key": np.roll(keys, 1), "home_country": none, "away_country": none, "score": np.ones(many), "goal_mult": np.ones(many), "is_uefa": np.zeros(many, bool), "neutral": np.zeros(many), "market": np.full(many, np.nan)}

    params = Params(elo_burn_in_end=date(1970, 9, 1), elo_burn_in_passes=1)
    tracemalloc.start()
    try:
        seen = sum(len(day["day"]) for day, _ in rating._fold(rating.Engine(np.array([[10.0, 3.0, 0.0]]), params), days(), params, True))
        assert seen == n * many and tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_days_of_teams_are_dealt_before_they_are_made_distinct(spark):
    from touchline.operators import rating

    rated = spark.createDataFrame([(0, 1, 1, "a", "b", 1.0, 1.0, 2.0, 0.0), (0, 2, 1, "a", "c", 1.0, 1.0, 2.0, 0.5)], rating.RATED)
    plan = rating.history(rated)._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("HashAggregate") < plan.find("Exchange") and rating.history(rated).count() == 3


def test_shared_hessian_is_that_of_the_mean_probabilities():
    import numpy as np

    from touchline.operators import batched

    rnd = np.random.default_rng(4)
    x, y, b = rnd.normal(size=(50, 4)), rnd.integers(0, 3, 50), rnd.normal(size=(1, 3, 4))
    v = batched._sums(x, y, b)
    p = batched._probabilities(x, b)[:, 0]
    want = np.array([[x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]) for j in range(3)] for i in range(3)]).transpose(0, 2, 1, 3)
    assert np.allclose(batched._hessian(v[2 + 12 :].reshape(3, 4, 4)), want) and np.allclose(v[2:14].reshape(3, 4), (p - np.eye(3)[y]).T @ x)


def test_rows_that_are_fitted_are_written_once(spark, small, monkeypatch):
    from touchline.catalog import forecasts
    from touchline.operators import models

    class Seen(Exception):
        pass

    def seen(df, *_, **__):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(models, "out_of_fold", seen)
    monkeypatch.setattr(models.Logistic, "fit", lambda self, df, *_: seen(df))
    for name in ("forward_selection_folds", "ml_logreg"):
        with pytest.raises(Seen) as plan:
            catalog.queries()[name](spark, small)
        assert "Scan ExistingRDD" in str(plan.value) and "Join" not in str(plan.value)


def test_cells_of_scores_are_made_in_generated_code_from_dealt_matches(spark, small):
    from touchline.operators import scores

    for name in ("consistent_matrix", "poisson_score_matrix"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "Filter (" not in plan and "REPARTITION_BY_NUM" in plan
    rows = [(1, 1.3, 0.9, 0.5, 0.3, 0.2), (2, 40.0, 0.2, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.1, 0.1, 0.8), (4, 6.0, 7.0, 0.2, 0.5, 0.3)]
    df = spark.createDataFrame(rows, "match_id int, lh double, la double, a0 double, a1 double, a2 double")
    for rho in (-0.03, 0.3):
        m = scores.matrix("lh", "la", rho)
        for final, whole in ((None, m), (["a0", "a1", "a2"], scores.consistent(m, ["a0", "a1", "a2"]))):
            want = {(r["match_id"], r["i"], r["j"]): r["p"] for r in scores.cells(df.select("match_id", whole.alias("m")), "m", "match_id").collect()}
            got = {(r["match_id"], r["i"], r["j"]): r["p"] for r in scores.score_cells(df, "lh", "la", rho, "match_id", final=final).collect()}
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 1e-9 * max(1.0, want[x]) for x in want)


def test_clubs_of_one_spelling_are_suggested_by_their_first_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from touchline.operators import identity

    pool = spark.createDataFrame([(f"tm:{k:03}", "Ajax", None if k % 2 else "1") for k in range(300)] + [("tm:x", "Ajex", "1"), ("tm:y", "Gent", None)], "key string, display string, country string")
    asked = spark.createDataFrame([("Ajxa", "1"), ("Gint", "2")], "query string, country string")
    compared, plain = [], identity.similarity

    def similar(a, b):
        compared.append(1)
        return plain(a, b)

    monkeypatch.setattr(identity, "similarity", similar)
    plans = []
    whole = identity.checkpointed
    monkeypatch.setattr(identity, "checkpointed", lambda df: plans.append(whole(df)) or plans[-1])
    got = {r["query"]: r["suggestions"] for r in identity.suggestions(asked.select("query"), pool.drop("country")).collect()}
    assert got["Ajxa"] == [f"Ajax (tm:{k:03})" for k in range(5)] and max(p.count() for p in plans) <= 24
    plans.clear()
    got = {r["query"]: r["suggestions"] for r in identity.suggestions(asked, pool).collect()}
    assert got["Ajxa"] == [f"Ajax (tm:{k:03})" for k in range(5)] and got["Gint"][0] == "Gent (tm:y)" and max(p.count() for p in plans) <= 24
    asked = spark.createDataFrame([("Ajax",), ("Gent",)], "query string")
    found = {r["query"]: (r["key"], r["method"]) for r in identity.resolve(asked, pool.select("key", F.col("display").alias("alias")), pool.select("key", "display")).collect()}
    assert found == {"Ajax": (None, "ambiguous"), "Gent": ("tm:y", "exact")}


def test_cooccurrence_counts_before_names_meet_clubs(spark):
    from touchline.operators import identity

    # 40 equal matches of one name and club on one day meet 1600 times, the others once or twice
    one = [("1", 1, 1, 0, "a", "b", 7, 8)] * 40 + [("1", 2, 0, 0, "a", "c", 7, 9), ("1", 3, 0, 0, "c", "a", 9, 7), ("2", 1, 1, 0, "a", None, None, 8)] * 2
    left = spark.createDataFrame([x[:6] for x in one], "country string, d int, home_goals int, away_goals int, home_team string, away_team string")
    right = spark.createDataFrame([x[:4] + x[6:] for x in one], "country string, d int, home_goals int, away_goals int, home_id long, away_id long")
    want = [("1", "a", 7, 1608), ("1", "b", 8, 1600), ("1", "c", 9, 8), ("2", None, 8, 4)]
    for parts in (None, 3):
        found = identity.cooccurrence(left, right, parts=parts)
        assert sorted(map(tuple, found.where("club_id is not null").collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.find("inline") < plan.rfind("REPARTITION_BY_NUM") and "name_n" in plan


def test_home_teams_meet_an_away_team_together(spark):
    from touchline.plans import export

    mapping = spark.createDataFrame([(c, f"t{k:03}", k) for c in "xy" for k in range(150)], "competition string, name string, key int")
    f = export.fixtures(mapping, "2026-09-01", parts=2).select("competition", "home", "away", "stage")
    parts = f.rdd.mapPartitions(lambda rows: [[tuple(r) for r in rows]]).collect()
    rows = [r for own in parts for r in own]
    assert len(rows) == len(set(rows)) == 2 * 3 * 150 * 149
    # the away team changes once for each block of home teams, and not with each row
    assert sum(a[2] != b[2] for own in parts for a, b in zip(own, own[1:])) < len(rows) / 100


def test_documents_are_spelled_once_for_each_two_values(spark):
    import json

    from pyspark.sql import functions as F

    from touchline.plans import export

    names = ['a"b', "c\\d", "[e]", "é", *[f"t{k:02}" for k in range(60)]]
    rows = [(c, n, None if k % 17 == 3 else 0.5 + k % 3, None if k % 13 == 5 else 0.25 * (k % 4)) for c in "xy" for k, n in enumerate(names)] + [("z", "alone", 1.0, 1.0)]
    teams = spark.createDataFrame(rows, "competition string, name string, home double, away double")
    asked = []

    def predict(df):
        asked.append(df)
        return df.withColumns({"lambda_home": F.col("home"), "lambda_away": F.col("away"), "home_win": F.col("home") / 7, "draw": F.col("away") / 9, "away_win": F.lit(0.1)})

    got = {(r["competition"], r["home"]): r["document"] for r in export.documents(teams, predict, 3).collect()}
    # two competitions, at most 3 by 4 values of at most 2 blocks of home teams
    assert asked[0].count() <= 2 * 3 * 4 * 2
    home, away = teams.select("competition", F.col("name").alias("home"), F.col("home").alias("h")), teams.select("competition", F.col("name").alias("away"), F.col("away").alias("a"))
    pairs = home.join(away, "competition").where("home != away and h is not null and a is not null").withColumn("name", F.col("home"))
    p = export.staged(predict(pairs.select("competition", "name", F.col("away").alias("other"), F.col("h").alias("home"), F.col("a").alias("away"))), "2026-09-01")
    p = p.select("competition", F.col("name").alias("home"), F.col("other").alias("away"), "stage", "home_win", "draw", "away_win", "lambda_home", "lambda_away", F.lit(False).alias("elo_missing"))
    want = {(r["competition"], r["home"]): json.loads(r["document"]) for r in export.nested(p, whole=False).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == want and len(want) == 2 * 60
    assert all(list(json.loads(v)[k[1]]) == sorted(json.loads(v)[k[1]]) for k, v in got.items())
    with pytest.raises(Exception, match="a name twice in z"):
        export.documents(teams.unionByName(teams.where("name = 'alone'")), predict, 3).collect()


def test_rows_outside_the_sample_are_left_out_before_they_are_shuffled(spark, small):
    from pyspark.sql import functions as F

    from touchline.catalog import features
    from touchline.operators import checks, snapshot

    a, v = features._apps(spark, small), features.A.valuations(spark, small)
    index = snapshot.value_index(a, v, features._reference(spark, small), features.PARAMS).localCheckpoint()
    sampled = a.select("club_id", F.date_add("d", 9).alias("d")).distinct().orderBy("club_id", "d").limit(20).localCheckpoint()
    slow = checks.brute_force_state(a, v, features.A.players(spark, small), index, sampled, features.PARAMS)
    plan = slow._jdf.queryExecution().executedPlan().toString()
    scans = [k for k in range(len(plan)) if plan.startswith("FileScan", k)]
    assert len(scans) == plan.count("LeftSemi") == 3
    assert all(plan.rfind("LeftSemi", 0, k) > plan.rfind("Exchange hashpartitioning", 0, k) for k in scans)
    assert slow.count() == 20
