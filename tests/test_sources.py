"""Readers, conformers and sinks on small files."""

import json
import os
import time
import urllib.error
from datetime import date

import pytest
from pyspark.sql import functions as F

from touchline.sources import conform, readers, sinks


def test_http_retry():
    calls, naps = [], []

    class Body:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"ok"

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return Body()

    assert readers.http_get("u", opener=opener, sleep=naps.append) == b"ok" and naps == [2.0, 4.0]

    def gone(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "gone", {}, None)

    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        readers.http_get("u", opener=gone, sleep=naps.append)
    assert len(calls) == 1


def test_download_goes_on(tmp_path):
    def get(url):
        if url == "bad":
            raise OSError("down")
        return b"x"

    failed = readers.download({"a.csv": "good", "b.csv": "bad"}, str(tmp_path), get=get)
    assert list(failed) == ["b.csv"] and (tmp_path / "a.csv").read_bytes() == b"x"
    assert not readers.needs_download(str(tmp_path / "a.csv"), 1) and readers.needs_download(str(tmp_path / "a.csv"), 2) and not readers.needs_download(str(tmp_path / "a.csv"), None)


HEADER = "Date,HomeTeam,AwayTeam,FTHG,FTAG,Referee,HS,AS,HST,AST,B365H,B365D,B365A,AvgH,AvgD,AvgA\n"


def test_league_conforming(spark, tmp_path):
    path = tmp_path / "1920_E0.csv"
    path.write_bytes(b"\xef\xbb\xbf" + (HEADER + "10/08/2019, Alpha ,Beta,2,1,R. Ef,10,x,5,4,1.5,4,6,1.0,4,6\n11/08/19,Beta,Alpha,0,0,,1,2,3,4,2,3,4,2.1,3.1,4.1\nbad,Beta,Alpha,1,1,,,,,,,,,,,\n").encode())
    rows = conform.league(readers.csv(spark, str(path)), "E0", "ENG", 1).orderBy("date").collect()
    assert [r["date"] for r in rows] == [date(2019, 8, 10), date(2019, 8, 11)]
    assert rows[0]["home_team"] == "Alpha" and rows[0]["result"] == "H" and rows[0]["away_shots"] is None and rows[0]["season_start"] == 2019
    assert rows[0]["odds_type"] == "B365" and rows[1]["odds_type"] == "Avg" and rows[0]["home_fouls"] is None


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("HomeTeam,Goals\nÖrebro,1\n".encode())
    (tmp_path / "b.csv").write_bytes("HomeTeam,Goals\nÖrebro,2\n".encode("latin-1"))
    df = readers.csv_any_encoding(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["HomeTeam"], r["Goals"]) for r in df.collect()) == [("Örebro", "1"), ("Örebro", "2")]


def test_platform_games(spark):
    games = spark.createDataFrame(
        [("GB1", "3. Matchday", "2019", "2019-08-10", "1", "2", "2", "1", "A", "B", None), ("CL", "Final", "2019", "2020-08-23", "1", "3", "0", "1", "A", "C", None), ("MX1", "1", "2019", "2019-08-10", "8", "9", "0", "1", "M", "N", None)],
        "competition_id string, round string, season string, date string, home_club_id string, away_club_id string, home_club_goals string, away_club_goals string, home_club_name string, away_club_name string, referee string",
    )
    competitions = spark.createDataFrame([("GB1", "England", "domestic_league"), ("MX1", "Mexico", "domestic_league")], "competition_id string, country_name string, type string")
    got = {r["competition"]: r for r in conform.platform_games(games, competitions, {"England": "ENG"}).collect()}
    assert set(got) == {"league:GB1", "uefa:CL"}
    assert got["uefa:CL"]["neutral"] == 1 and got["uefa:CL"]["country"] is None and got["league:GB1"]["country"] == "ENG"


def test_aliases_pots_and_embedded_json(spark, tmp_path):
    (tmp_path / "aliases.csv").write_text("# comment\nalias,target,country\nUtd,tm:1,\n,tm:2,ENG\n")
    assert [(r["alias"], r["country"]) for r in readers.aliases(spark, str(tmp_path / "aliases.csv")).collect()] == [("Utd", None)]
    (tmp_path / "teams.json").write_text(json.dumps({"1": [{"name": "A", "country": "X"}], "2": [{"name": "B", "country": "Y"}, {"name": "C", "country": "Z"}]}))
    assert readers.pots(spark, str(tmp_path / "teams.json")).count() == 3
    page = str(tmp_path / "contract.md")
    sinks.contract_page(page, {"columns": ["a", "b"], "k": 1})
    assert sinks.read_contract(spark, page) == {"columns": ["a", "b"], "k": 1}


def test_signature_status_and_required(spark, tmp_path):
    (tmp_path / "x.csv").write_text("abc")
    row = readers.signature(spark, [str(tmp_path / "x.csv")]).first()
    assert (row["name"], row["size"]) == ("x.csv", 3) and readers.status(spark, {"raw": str(tmp_path)}) == {"raw": 1}
    with pytest.raises(FileNotFoundError):
        readers.required(spark, "none", lambda: spark.read.parquet(str(tmp_path / "none")))
    assert readers.injuries(spark).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("v", F.col("id") * 2)
    sinks.report(df, str(tmp_path / "report"))
    assert readers.csv(spark, str(tmp_path / "report")).count() == 3
    sinks.append(df, str(tmp_path / "log"))
    sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    sinks.publish(df, str(tmp_path / "out"), "v1")
    sinks.publish(df.limit(1), str(tmp_path / "out"), "v2")
    assert sinks.latest(spark, str(tmp_path / "out")).count() == 1
    sinks.replace(str(tmp_path / "d.json"), "{}")
    assert sinks.archive(str(tmp_path), ["d.json", "none"], str(tmp_path / "old")) == ["d.json"]


def test_run_lock(tmp_path):
    lock = str(tmp_path / "lock")
    with sinks.run_lock(lock):
        with pytest.raises(sinks.Busy):
            with sinks.run_lock(lock):
                pass
        os.utime(lock, (time.time() - 7 * 3600,) * 2)
        with sinks.run_lock(lock):
            pass


def test_streaming_form_equals_batch(spark, small, tmp_path):
    from touchline.operators import dedupe, rolling
    from touchline.sources import adapters
    from touchline.streaming.form import stream_form

    m = dedupe.without_same_day_conflicts(adapters.matches(spark, small)).where("home_key < 20")
    sides = rolling.both_sides(m).select("team", "day", "match_id", "points").orderBy("day")
    sides.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_form(spark.readStream.schema(sides.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("streamed_form").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["team"], r["match_id"]): r["form_after"] for r in spark.table("streamed_form").collect()}
    log = rolling.segments(rolling.both_sides(m), 200).withColumn("form_after", rolling.rolling_mean("points", 5, 3))
    expected = {(str(r["team"]), r["match_id"]): r["form_after"] for r in log.collect()}
    assert got == expected


def test_season_files_and_refresh(tmp_path):
    from datetime import date

    files, always = readers.season_files("http://x", 2014, date(2016, 3, 1))
    assert files["1415_E0.csv"] == "http://x/mmz4281/1415/E0.csv" and files["extra_AUT.csv"] == "http://x/new/AUT.csv"
    assert len(files) == 2 * 17 + 10 and "1516_E0.csv" in always and "1415_E0.csv" not in always and "extra_AUT.csv" in always
    (tmp_path / "a").write_text("12345")
    (tmp_path / "b").write_text("1")

    def size(url):
        if url == "down":
            raise OSError("no network")
        return 5

    asked = []
    get = lambda url: asked.append(url) or b"54321"
    assert readers.refresh({"a": "A", "b": "B", "c": "C"}, str(tmp_path), size, get) == {"a": "kept", "b": "fetched", "c": "fetched"} and asked == ["B", "C"]
    assert readers.refresh({"a": "down"}, str(tmp_path), size, get) == {"a": "offline"}
    with pytest.raises(ConnectionError):
        readers.refresh({"d": "down"}, str(tmp_path), size, get)


def test_league_files_by_name(spark, tmp_path):
    rows = "Date,HomeTeam,AwayTeam,FTHG,FTAG,PSCH,PSCD,PSCA,AvgCH,AvgCD,AvgCA\n01/09/2014,A,B,2,1,2.0,3.0,4.0,2.1,3.1,4.1\n"
    (tmp_path / "1415_E1.csv").write_text(rows)
    (tmp_path / "x1415_E1.csv").write_bytes(rows.replace("A,B", "\u00c4,B").encode("latin-1"))
    (tmp_path / "extra_AUT.csv").write_text("Date,Home,Away,HG,AG\n02/09/2014,C,D,0,0\n")
    with pytest.warns(UserWarning, match="no league"):
        found, unknown = conform.league_files(spark, [str(tmp_path / n) for n in ("1415_E1.csv", "x1415_E1.csv", "extra_AUT.csv")])
    got = {r["home_team"]: r for r in found.collect()}
    assert set(got) == {"A", "C"} and len(unknown) == 1
    assert (got["A"]["tier"], got["A"]["country"], got["A"]["odds_type"], got["C"]["country"]) == (2, "ENG", "PSC", "AUT")
    # files of one header are one scan; another header, or another encoding, is one more
    for name, text in (("1516_E1.csv", rows.replace("2014", "2015").replace("A,B", "E,F")), ("1516_D1.csv", rows.replace("A,B", "G,H").replace("AvgCH", "B365H"))):
        (tmp_path / name).write_text(text)
    (tmp_path / "1617_F1.csv").write_bytes(rows.replace("A,B", "\u00c4,B").encode("latin-1"))
    named = [str(tmp_path / f"{n}.csv") for n in ("1415_E1", "1516_E1", "1516_D1", "1617_F1", "extra_AUT")]
    found, unknown = conform.league_files(spark, named)
    kept = {r["home_team"]: (r["competition"], r["country"], r["tier"]) for r in found.collect()}
    assert not unknown and kept == {"A": ("league:E1", "ENG", 2), "E": ("league:E1", "ENG", 2), "G": ("league:D1", conform.MAIN_LEAGUES["D1"], 1), "\u00c4": ("league:F1", conform.MAIN_LEAGUES["F1"], 1), "C": ("league:AUT", "AUT", 1)}
    heads = readers.file_heads(spark, named)
    assert len(heads) == 5 and heads[named[0]] == heads[named[1]] != heads[named[2]] and heads[named[3]][1] == "ISO-8859-1"
    # an empty file adds nothing, alone or beside others
    (tmp_path / "1718_E0.csv").write_text("")
    empty = str(tmp_path / "1718_E0.csv")
    assert conform.league_files(spark, [empty]) == (None, []) and conform.league_files(spark, [empty, named[0]])[0].count() == 1
    # a file is told by its whole path, not by the end of its name
    both = readers.csv_any_encoding(spark, [str(tmp_path / "1415_E1.csv"), str(tmp_path / "x1415_E1.csv")])
    assert {r["HomeTeam"] for r in both.collect()} == {"A", "\u00c4"}


def test_live_rows(spark):
    from datetime import date

    from touchline.plans import weekly

    m = spark.createDataFrame([(1, date(2026, 1, 2), 1, False, 1, 0), (2, date(2026, 1, 2), 2, False, 1, 0), (3, date(2026, 1, 2), 2, True, 0, 0), (4, date(2026, 1, 1), 1, False, 1, 0), (5, date(2026, 1, 3), 1, False, 0, 2)], "match_id long, d date, tier int, is_uefa boolean, home_goals int, away_goals int")
    p = spark.createDataFrame([(k, 0.5, 0.3, 0.2, k == 5) for k in range(1, 6)], "match_id long, home_win double, draw double, away_win double, elo_missing boolean")
    assert sorted((r["match_id"], r["y"], r["p0"]) for r in weekly.live_rows(m, p, date(2026, 1, 1)).collect()) == [(1, 0, 0.5), (3, 1, 0.5)]


def test_report_sections_and_history():
    from touchline.plans import weekly

    bare = {"started": "2026-01-05", "status": "done"}
    text = weekly.report_text(bare)
    assert [x for x in text.splitlines() if x.startswith("## ")] == ["## Data", "## Model", "## Live performance", "## Retraining", "## Forecast table"]
    assert "- no match played" in text and "- reasons: none" in text and weekly.history_rows(bare)[1] is None
    live = {"since": "2025-12-01", "until": "2026-01-04", "n": 40, "log_loss": 1.01, "n_market": 30, "model_on_market": 1.0, "market_log_loss": 0.99, "gap": 0.01, "n_uefa": 31, "uefa_log_loss": 0.98}
    full = bare | {"data": {"games": "fetched"}, "live": live, "reasons": ["old"], "result": "promoted", "checks": [("baseline", True), ("slack", False)], "warnings": ["a", "b"], "error": "boom"}
    text = weekly.report_text(full)
    assert "- games: fetched" in text and "gap +0.0100" in text and "still noisy" in text and "31 matches, log loss 0.9800" in text
    assert "  - [x] baseline\n  - [ ] slack" in text and text.endswith("## Error\n\n```text\nboom\n```\n")
    run, row = weekly.history_rows(full)
    assert run["warnings"] == "a | b" and run["live_gap"] == 0.01 and row["run"] == "2026-01-05" and row["n"] == 40
