"""Edge cases of the operators on rows made by hand."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.functions import names, scalar
from touchline.operators import checks, dedupe, identity, metrics, models, player, rating, rolling, scores, snapshot
from touchline.operators.asof import Lookup, as_of
from touchline.params import FEATURE_GROUPS, FEATURES, Params, contract, contract_hash
from touchline.plans import export, store, weekly

D = date(2020, 1, 1)


def on(n):
    return D + timedelta(days=n)


def look(spark, build, probe, strict=True, gap=None, bucket=None):
    b = spark.createDataFrame([("k", on(d), v) for d, v in build], "key string, day date, v string")
    p = spark.createDataFrame([("k", on(probe))], "key string, at date")
    return as_of(p, "key", "at", [Lookup(b, "key", "day", {"v": "v"}, strict, gap)], bucket).first()["v"]


@pytest.mark.parametrize("bucket", [None, 7])
def test_as_of_equal_day_and_staleness(spark, bucket):
    assert look(spark, [(10, "a"), (20, "b")], 20, True, bucket=bucket) == "a"
    assert look(spark, [(10, "a"), (20, "b")], 20, False, bucket=bucket) == "b"
    assert look(spark, [(0, "a")], 30, gap=30, bucket=bucket) == "a"
    assert look(spark, [(0, "a")], 31, gap=30, bucket=bucket) is None
    assert look(spark, [(1, "old"), (5, None)], 9, bucket=bucket) is None


def matches(spark, rows):
    """rows: day, home, away, home goals, away goals."""
    full = [(k, on(d), h, a, hg, ag, 10.0, 8.0, 5.0, 4.0, 2.0, 3.0, 4.0, False, 1, 0) for k, (d, h, a, hg, ag) in enumerate(rows)]
    ddl = "match_id long, d date, home_key string, away_key string, home_goals int, away_goals int, home_shots double, away_shots double, home_sot double, away_sot double, odds_home double, odds_draw double, odds_away double, is_uefa boolean, tier int, neutral int"
    return spark.createDataFrame(full, ddl)


def form(spark, days, gap=200):
    log = rolling.team_log(matches(spark, [(d, "A", f"x{k}", 1, 0) for k, d in enumerate(days)]), gap_days=gap)
    return [(r["segment"], r["form_after"]) for r in log.where("team = 'A'").orderBy("day").collect()]


def test_least_rows_and_segments(spark):
    assert [f for _, f in form(spark, [0, 1, 2])] == [None, None, 3.0]
    assert [s for s, _ in form(spark, [0, 10, 211, 212, 213])] == [1, 1, 2, 2, 2]
    assert [s for s, _ in form(spark, [0, 200])] == [1, 1]
    assert form(spark, [0, 10, 211, 212, 213])[-1][1] == 3.0


def test_same_day_conflict(spark):
    m = matches(spark, [(0, "A", "B", 1, 0), (0, "C", "A", 1, 0), (0, "D", "E", 0, 0)])
    assert [r["home_key"] for r in dedupe.without_same_day_conflicts(m).collect()] == ["D"]


def test_odds_priority(spark):
    df = spark.createDataFrame([(1.0, 3.0, 4.0, 2.0, 3.0, 4.0), (1.0, 3.0, 4.0, None, 3.0, 4.0)], "a double, b double, c double, x double, y double, z double")
    got = [r[0] for r in df.select(scalar.first_valid_odds({"one": ("a", "b", "c"), "two": ("x", "y", "z")})).collect()]
    assert got[0]["type"] == "two" and got[0]["home"] == 2.0 and got[1] is None


def test_fixed_orders(spark):
    from touchline.params import DEFAULT, FEATURE_GROUPS, FEATURES
    from touchline.sources import conform, leagues

    assert leagues.ODDS_PREFIXES == ("PSC", "AvgC", "B365C", "Avg", "BbAv", "B365", "PS")
    # each prefix gives way to all before it
    for k, best in enumerate(leagues.ODDS_PREFIXES):
        names = [f"{p}{x}" for p in leagues.ODDS_PREFIXES for x in "HDA"]
        values = [None if j // 3 < k else 2.0 + j for j in range(len(names))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"`{n}` double" for n in names))
        assert df.select(conform._odds(df).alias("o")).first()["o"]["type"] == best
    assert DEFAULT.reference_countries == ("ENG", "ESP", "GER", "ITA", "FRA", "NED", "POR", "BEL", "TUR", "GRE", "SCO", "RUS", "UKR", "DEN")
    assert list(FEATURE_GROUPS) == ["base", "market", "shots", "form", "squad_value", "xi_value", "lines", "production", "goals_form", "rest", "experience", "continuity"]
    assert len(FEATURES) == 41 and FEATURES[:8] == ["elo_diff", "home_form", "away_form", "home_squad_value", "away_squad_value", "is_knockout", "is_uefa", "home_xi_value"]
    assert FEATURES[-7:] == ["mkt_elo_diff", "home_sot_share", "away_sot_share", "home_shot_share", "away_shot_share", "home_rest_days", "away_rest_days"]
    assert sorted(FEATURES) == sorted(f for g in FEATURE_GROUPS.values() for f in g)
    assert len(leagues.COVERED) == 21 and leagues.tier("E1") == 2 and leagues.tier("E0") == 1


def test_round_class(spark):
    rows = [("CLQ", "Third Round", 2018, D), ("ELQ", "Final", 2018, D), ("ECLQ", None, 2018, D), ("EL", "Third Round", 2018, D), ("CL", "Qualifying Round", 2018, D), ("CL", " Group A", 2018, D), ("CL", "final", 2018, D)]
    rows += [(None, "Final ", 2018, D), ("CL", "Quarter-Finals", 2019, date(2020, 8, 1)), ("CL", "Quarter-Finals 1st leg", 2019, date(2020, 8, 1))]
    df = spark.createDataFrame(rows, "k string, r string, s int, d date").select(scalar.round_class("k", "r", "s", "d").alias("c"))
    assert [tuple(r["c"]) for r in df.collect()] == [(0, 0), (0, 0), (0, 0), (1, 0), (1, 0), (0, 0), (1, 1), (1, 1), (1, 1), (1, 0)]


def grid(spark, *rows):
    return spark.createDataFrame(list(rows), rating.GRID)


def rate(spark, rows, params=Params(), burn_in=False, countries=None):
    return rating.run(rating.engine_rows(matches(spark, rows), countries), grid(spark, (0, 10.0, 3.0, 0.0)), params, burn_in).orderBy("match_id").collect()


def test_rating_conserved_and_same_day(spark):
    plain = Params(elo_provisional_mult=1.0)
    rows = rate(spark, [(0, "A", "B", 1, 0), (0, "C", "D", 0, 0), (1, "A", "C", 0, 1)], plain)
    assert abs(rows[0]["post_home"] + rows[0]["post_away"] - 3000) < 1e-9
    assert rows[0]["pre_home"] == rows[1]["pre_home"] == 1500
    assert rows[2]["pre_home"] == rows[0]["post_home"] and rows[2]["pre_away"] == rows[1]["post_home"]


def test_newcomer_takes_a_percentile_of_enough_peers(spark):
    first = [(k, f"T{2 * k}", f"T{2 * k + 1}", 3, 0) for k in range(3)]
    few = rate(spark, [*first[:2], (9, "N", "T0", 0, 0)])[-1]
    enough = rate(spark, [*first, (9, "N", "T0", 0, 0)])[-1]
    assert few["pre_home"] == 1500
    assert enough["pre_home"] < 1500


def test_provisional_matches_are_spent_in_the_burn_in(spark):
    rows = [(k, "A", "B", 1, 0) for k in range(12)]
    once = rate(spark, rows, Params(elo_burn_in_end=on(100), elo_burn_in_passes=0), True)
    again = rate(spark, rows, Params(elo_burn_in_end=on(100), elo_burn_in_passes=1), True)
    assert once[0]["post_home"] - once[0]["pre_home"] > 1.9 * (once[11]["post_home"] - once[11]["pre_home"])
    assert again[0]["pre_home"] > 1500 and again[0]["post_home"] - again[0]["pre_home"] < 10


def test_rest_days(spark):
    m = matches(spark, [(0, "A", "B", 0, 0), (3, "A", "C", 0, 0), (93, "A", "D", 0, 0)])
    probes = m.select("match_id", "d", F.col("home_key").alias("team"))
    found = as_of(probes, "team", "d", [Lookup(rolling.last_matches(m), "team", "day", {"last": "day"})])
    assert [r[0] for r in found.orderBy("d").select(scalar.capped(F.datediff("d", "last"), 30)).collect()] == [None, 3, 30]


def squad(spark, n, minutes=None, value=10.0, unvalued=0, pos="Attack"):
    apps = spark.createDataFrame([(1, 7, p, D, (minutes or {}).get(p, 90), 0, 0, False) for p in range(n)], "game_id long, club_id long, player_id long, d date, minutes long, goals int, assists int, uefa boolean")
    vals = spark.createDataFrame([(p, on(-10), value) for p in range(unvalued, n)], "player_id long, d date, value_eur double")
    people = spark.createDataFrame([(p, pos, date(1995, 1, 1)) for p in range(n)], "player_id long, pos string, born date")
    index = spark.createDataFrame([(date(2020, 1, 1), 0.0)], "month date, idx double")
    return apps, vals, people, index


def test_line_up_gates(spark):
    apps, vals, people, index = squad(spark, 11, unvalued=4)
    row = player.player_state(apps, vals, people, index).first()
    assert row["xi_value"] is None and row["xi_ga90"] == 0.0
    apps, vals, people, index = squad(spark, 11, unvalued=3)
    row = player.player_state(apps, vals, people, index).first()
    assert abs(row["xi_value"] - 1.90309) < 1e-4 and row["gk_value"] is None and row["att_value"] is not None


def test_last_match_share_and_ties(spark):
    played = {p: 90 if p < 4 else 20 for p in range(8)}
    row = player.player_state(*squad(spark, 8, played)).first()
    assert row["xi_last_match_share"] == 0.5
    apps, *_ = squad(spark, 12)
    ranked = player.ranked_minutes(apps, player.club_games(apps))
    assert [r["player_id"] for r in ranked.where("rank < 11").orderBy("rank").collect()] == list(range(11))


def test_squad_gate_and_top(spark):
    for n, expected in ((10, []), (11, [110.0]), (20, [160.0])):
        apps, vals, *_ = squad(spark, n)
        total = snapshot.squad_totals(apps, vals).where("snapshot = date'2020-02-01'")
        assert [r["total"] for r in total.collect()] == expected


def test_names(spark):
    df = spark.createDataFrame([("Man Utd",), ("Manchester United FC",), ("FC Østerås",), ("  ",), (None,)], "n string")
    assert [r[0] for r in df.select(names.normalise("n")).collect()] == ["manchesterunited", "manchesterunited", "osteras", "", None]


def pool(spark, *names_):
    return spark.createDataFrame([(f"tm:{k}", n, "X") for k, n in enumerate(names_)], "key string, display string, country string")


def test_tiers_need_one_hit(spark):
    asked = spark.createDataFrame([("X", "Man Utd"), ("X", "Bar"), ("X", "Lokomotiv Sofya"), ("X", "Qqqq")], "country string, name string")
    got = {r["name"]: (r["key"], r["method"]) for r in identity.tiered_match(asked, pool(spark, "Manchester United FC", "Barcelona", "Barnsley", "Lokomotiv Sofia")).collect()}
    assert got["Man Utd"] == ("tm:0", "normalized")
    assert got["Bar"] == (None, "ambiguous_prefix")
    assert got["Lokomotiv Sofya"] == ("tm:3", "fuzzy")
    assert got["Qqqq"] == (None, "unresolved")


def test_dominance(spark):
    def co(n1, n2):
        left = spark.createDataFrame([("X", on(k), 1, 0, "N", f"o{k}") for k in range(n1 + n2)], "country string, d date, home_goals int, away_goals int, home_team string, away_team string")
        right = spark.createDataFrame([("X", on(k), 1, 0, 1 if k < n1 else 2, 100 + k) for k in range(n1 + n2)], "country string, d date, home_goals int, away_goals int, home_id long, away_id long")
        return [r["club_id"] for r in identity.cooccurrence(left, right).where("name = 'N'").collect()]

    assert co(3, 1) == [1] and co(3, 2) == [] and co(2, 0) == []


def test_matching_pieces_lose_no_pair(spark):
    """Names met by pieces of spelling give what all pairs give."""
    import difflib
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
    left, right = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    right += [x[: k % len(x)] + "b" + x[k % len(x) + 1 :] for k, x in enumerate(left) if len(x) > 5]
    names_ = spark.createDataFrame([("1", x) for x in left], "country string, name string")
    clubs = spark.createDataFrame([(f"tm:{k}", x, "1") for k, x in enumerate(right)], "key string, display string, country string")
    close = {(r["name"], r["key"]) for r in identity._pairs(names_, clubs, None, close=True).collect()}
    met = {(r["name"], r["key"]) for r in identity._pairs(names_, clubs, None).collect()}
    for x in left:
        for k, y in enumerate(right):
            short = min(len(x), len(y))
            if x == y or (short >= 3 and (x.startswith(y) or y.startswith(x))) or (short >= 5 and (x in y or y in x)):
                assert (x, f"tm:{k}") in met
            if difflib.SequenceMatcher(None, y, x).ratio() >= 0.88:
                assert (x, f"tm:{k}") in close, (x, y)


def test_taken_clubs_names_and_mapping(spark):
    clubs = spark.createDataFrame([("tm:1", "Alpha", "1"), ("tm:2", "Alphaville", None), ("tm:3", "Gamma", "2"), ("tm:4", "Delta City", None)], "key string, display string, country string")
    names_ = spark.createDataFrame([("1", "Alpha X"), ("1", "Alphavill"), ("1", "Alpha"), ("2", "Alphaville"), ("2", "Nowhere")], "country string, name string")
    co = spark.createDataFrame([("1", "Alpha X", 1, 9)], "country string, name string, club_id long, n long")
    aliases = spark.createDataFrame([("Alphaville", "tm:2", "2", 1), ("The Deltas", "delta city", None, 2)], "alias string, target string, country string, row long")
    keys = identity.team_keys(names_, co, aliases, clubs, ())
    got = {(r["country"], r["name"]): (r["key"], r["method"]) for r in keys.collect()}
    # another country's claim leaves a club to this one; its own claim takes the club out before the tiers
    assert got["1", "Alpha X"] == ("tm:1", "cooccurrence") and got["2", "Alphaville"] == ("tm:2", "alias")
    assert got["1", "Alpha"] == ("tm:2", "name_prefix") and got["1", "Alphavill"] == ("fd:1:alphavill", "conflict_lost")
    assert got["2", "Nowhere"] == ("fd:2:nowhere", "unresolved")
    seen = spark.createDataFrame([(1, "FC Alpha")], "club_id long, name string")
    listed = {r["key"]: r["names"] for r in identity.known_names(keys, seen, clubs, aliases).collect()}
    assert listed["tm:1"] == ["Alpha", "Alpha X", "FC Alpha"] and "The Deltas" in listed["tm:4"] and listed["fd:2:nowhere"] == ["Nowhere"]
    full = {r["key"]: (r["display"], r["country"]) for r in identity.filled(keys, clubs).collect()}
    assert full["tm:2"][0] == "Alphaville" and full["tm:2"][1] in ("1", "2") and full["fd:2:nowhere"] == ("Nowhere", "2") and full["tm:4"] == ("Delta City", None)

    wanted = spark.createDataFrame([("CL", "Gamma", "2"), ("CL", "Gamma", "1"), ("CL", "Delta City", "9"), ("CL", "By hand", "1")], "competition string, name string, country string")
    alias_rows = clubs.select("key", F.col("display").alias("alias"))
    manual = spark.createDataFrame([("CL", "By hand", "tm:1", None)], "competition string, name string, key string, method string")
    m = {(r["name"], r["country"]): r for r in identity.country_mapping(wanted, alias_rows, clubs, manual).collect()}
    assert (m["Gamma", "2"]["key"], m["Gamma", "2"]["method"]) == ("tm:3", "auto_exact") and m["Delta City", "9"]["key"] == "tm:4"
    assert m["Gamma", "1"]["key"] is None and all("tm:3" not in x for x in m["Gamma", "1"]["suggestions"])
    assert (m["By hand", "1"]["key"], m["By hand", "1"]["method"]) == ("tm:1", "manual")
    mapping = spark.createDataFrame([(r["competition"], r["name"], r["country"], r["key"], r["method"]) for r in m.values()], "competition string, name string, country string, key string, method string")
    assert identity.checked_mapping(mapping, clubs) is mapping
    with pytest.raises(ValueError, match="no such key: CL: By hand"):
        identity.checked_mapping(mapping, clubs.where("key <> 'tm:1'"))
    with pytest.raises(ValueError, match="several names"):
        identity.checked_mapping(mapping.unionByName(mapping.where("key = 'tm:3'")), clubs)


def test_resolution_steps_and_suggestions(spark):
    shown = pool(spark, "Real Alpha", "Beta SK").drop("country")
    aliases = shown.select("key", F.col("display").alias("alias")).unionByName(spark.createDataFrame([("tm:1", "The Betas")], "key string, alias string"))
    asked = spark.createDataFrame([("tm:0",), ("the betas",), ("Beta",), ("zzz",)], "query string")
    got = {r["query"]: r for r in identity.resolve(asked, aliases, shown).collect()}
    assert [got[q]["method"] for q in ("tm:0", "the betas", "Beta", "zzz")] == ["key", "exact", "normalized", "unresolved"]
    assert len(got["zzz"]["suggestions"]) == 2 and got["Beta"]["suggestions"] is None


def test_score_matrix(spark):
    df = spark.createDataFrame([(1.3, 1.1)], "h double, a double").select(scores.matrix("h", "a", -0.03).alias("m"))
    row = df.select(F.aggregate("m", F.lit(0.0), lambda s, x: s + x).alias("sum"), scores.regions("m").alias("r")).first()
    assert abs(row["sum"] - 1) < 1e-12
    assert abs(row["r"]["home"] - 0.407088) < 1e-5 and abs(row["r"]["draw"] - 0.282672) < 1e-5
    final = [F.lit(0.2), F.lit(0.5), F.lit(0.3)]
    after = df.select(scores.regions(scores.consistent("m", final)).alias("r")).first()["r"]
    assert [round(x, 9) for x in after] == [0.2, 0.5, 0.3]


def test_temperature(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2)], "a double, b double, c double")
    same = df.select(*[p.alias(f"p{k}") for k, p in enumerate(scalar.temperature(["a", "b", "c"], 1.0))]).first()
    sharp = df.select(*[p.alias(f"p{k}") for k, p in enumerate(scalar.temperature(["a", "b", "c"], 0.5))]).first()
    assert [round(x, 9) for x in same] == [0.5, 0.3, 0.2] and sharp[0] > 0.5 > 0.2 > sharp[2]


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0, p, 1 - p, 0.0) for p in (0.0, 0.1, 0.999, 1.0)], "y int, a double, b double, c double")
    got = {r["bin"]: r["count"] for r in metrics.calibration(df, "y", ["a", "b", "c"]).where("target = 'home_win'").collect()}
    assert got == {0: 1, 1: 1, 9: 2}


def test_fixtures_and_export(spark):
    mapping = spark.createDataFrame([("L", f"t{k}", f"k{k}") for k in range(4)], "competition string, name string, key string")
    f = export.fixtures(mapping, D)
    assert f.count() == 3 * 4 * 3 and f.where("home = away").count() == 0
    p = f.withColumns({"home_win": F.lit(0.5000005), "draw": F.lit(0.3), "away_win": F.lit(0.2), "lambda_home": F.lit(1.5), "lambda_away": F.lit(1.25), "elo_missing": F.col("home") == "t3"})
    docs = export.nested(p)
    one = docs.select(export.entry("document", "t0", "t1", "final").alias("e"), export.entry("document", "t3", "t1", "final").alias("none")).first()
    assert one["e"]["p"] == [0.5, 0.3, 0.2] and one["none"] is None
    with pytest.raises(checks.UnknownTeam):
        export.require_teams(mapping.withColumn("key", F.lit(None).cast("string")))


def test_override(spark):
    with pytest.raises(ValueError):
        scalar.override("elo_diff", {"elo_diff": 1.0})
    assert spark.range(1).withColumn("home_form", F.lit(1.0)).select(scalar.override("home_form", {"home_form": 2.0})).first()[0] == 2.0


def test_batch_prediction_without_rating(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None)], "match_id int, elo_diff double")
    parts = {n: (lambda d, n=n: d.withColumns({f"{n}_{k}": F.lit(1 / 3) for k in range(3)})) for n in ("classifier", "logistic", "poisson")}
    got = {r["match_id"]: r for r in export.predict(df, parts).collect()}
    assert abs(got[1]["draw"] - 1 / 3) < 1e-9 and got[2]["draw"] is None and got[2]["elo_missing"]


def test_folds_selection_and_search():
    spans = models.folds(date(2025, 7, 1))
    assert [s["val_start"].year for s in spans] == [2021, 2022, 2023, 2024] and spans[0]["stop_from"] == date(2020, 7, 1)
    value = {"base": 0.97, "base lines": 0.965, "base lines shots": 0.9645, "base shots": 0.966}
    groups = {"base": ["base"], "lines": ["lines"], "shots": ["shots"], "rest": ["rest"]}
    score = lambda columns: value.get(" ".join(columns), 0.9644)
    assert models.forward_selection(groups, score, least=3e-4)[0] == ["base", "rest"]
    best, log = models.random_search({"depth": [3, 4, 5]}, lambda p: (p["depth"], [147, 198, 224, 258]), n=3)
    assert best == {"depth": 3, "n_estimators": 232} and len(log) == 3


def test_weekly_rules():
    live = {"gap": 0.05, "n_market": 400}
    season = date(2025, 7, 1)
    assert weekly.retrain_reasons(date(2026, 9, 1), date(2026, 9, 10), season, live, 0.02)
    assert not weekly.retrain_reasons(date(2026, 9, 1), date(2026, 9, 10), season, {"gap": 0.05, "n_market": 299}, 0.02)
    assert weekly.retrain_reasons(date(2026, 8, 1), date(2026, 9, 10), season, None, None)
    assert weekly.retrain_reasons(date(2027, 7, 1), date(2027, 7, 10), season, None, None) and not weekly.retrain_reasons(date(2027, 6, 20), date(2027, 6, 30), season, None, None)
    assert not weekly.gate({"log_loss": 1.0, "baseline_log_loss": 1.0301, "cv_objective": 0.9099}, {"cv_objective": 0.9}) and weekly.gate({"log_loss": 1.0, "baseline_log_loss": 1.0299, "cv_objective": 0.9}, None)
    assert weekly.gate({"log_loss": 0.9, "baseline_log_loss": 1.0, "cv_objective": 0.9101}, {"cv_objective": 0.9})
    assert weekly.gate({"log_loss": 1.07, "baseline_log_loss": 1.0713, "cv_objective": 0.9}, None)
    assert not weekly.gate({"log_loss": 0.99, "baseline_log_loss": 1.0713, "cv_objective": 0.9}, {"cv_objective": 0.9})
    assert weekly.default_test_from(date(2026, 9, 1)) == date(2025, 7, 1)


def test_features_and_contract():
    assert len(FEATURES) == 41 == len(set(FEATURES)) and len(FEATURE_GROUPS) == 12
    c = contract(FEATURES[:3], {"k": 10}, {})
    assert contract_hash(c) == contract_hash(contract(FEATURES[:3], {"k": 10}, {})) != contract_hash(contract(FEATURES[:2], {"k": 10}, {}))
    with pytest.raises(ValueError):
        contract(["no_such"], {}, {})


def test_store_round_trip_and_no_future(spark, tmp_path):
    m = matches(spark, [(k * 7, "A" if k % 2 else "B", "C" if k % 3 else "D", k % 3, 1) for k in range(30)])
    apps, vals, people, _ = squad(spark, 12)
    early = Params(elo_burn_in_end=on(50))
    build = lambda rows: store.build(rows, apps, vals, people, F.lit("A"), F.lit(True), params=early)
    fixtures = m.select("match_id", "d", "home_key", "away_key", F.lit(0.0).alias("is_uefa"))
    s = store.load_or_build(spark, str(tmp_path / "store"), {"files": 1}, lambda: build(m), early)
    got = {r["match_id"]: r.asDict() for r in s.compute(fixtures).collect()}
    checks.frame_contract(s.compute(fixtures).select(*FEATURES))
    cut = on(100)
    changed = m.withColumn("home_goals", F.when(F.col("d") >= F.lit(cut), 9).otherwise(F.col("home_goals")))
    other = {r["match_id"]: r.asDict() for r in build(changed).compute(fixtures).collect()}
    assert all(got[k] == other[k] for k in got if got[k]["d"] <= cut) and any(got[k] != other[k] for k in got)
    assert store.load(spark, str(tmp_path / "store"), {"files": 2}, early) is None


def test_input_order_does_not_matter(spark):
    m = matches(spark, [(k % 9, f"T{k % 5}", f"U{k % 7}", k % 4, k % 3) for k in range(60)])
    log = lambda df: sorted(map(str, rolling.team_log(df).collect()))
    assert log(m) == log(m.repartition(7).orderBy(F.desc("match_id")))


def test_ties_of_a_day_by_number(spark):
    builds = spark.createDataFrame([("a", on(1), -5, "low"), ("a", on(1), 3, "high"), ("a", on(1), -10**9, "least")], "k string, d date, t long, v string")
    probes = spark.createDataFrame([("a", on(2))], "k string, d date")
    assert as_of(probes, "k", "d", [Lookup(builds, "k", "d", {"v": "v"}, tie=("t",))]).first()["v"] == "high"
    assert as_of(probes, "k", "d", [Lookup(builds, "k", "d", {"v": "v"}, tie=("t",))], bucket_days=1).first()["v"] == "high"


def test_not_in_and_club_countries(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, x string")
    assert [r["n"] for r in df.where(scalar.not_in("x", ["a"])).orderBy("n").collect()] == [2, 3]
    clubs = spark.createDataFrame([(1, "ENG"), (2, None)], "club_id long, country string")
    played = spark.createDataFrame([(2, "GER", on(5)), (2, "ITA", on(2)), (3, "FRA", on(1)), (1, "ESP", on(0))], "club_id long, country string, d date")
    assert {r["club_id"]: r["country"] for r in identity.club_countries(clubs, played).collect()} == {1: "ENG", 2: "ITA", 3: "FRA"}
