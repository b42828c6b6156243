"""Readers of the raw files: text first, every cast explicit, absent columns as typed NULLs."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import date
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from touchline.schemas import struct
from touchline.sources.leagues import EXTRA_LEAGUES, MAIN_LEAGUES

BOM = "﻿"


def http_get(url: str, retries: int = 3, backoff: float = 2.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes:
    """The body of a URL. A client error (4xx) is raised at once; other errors are tried again after a growing pause."""
    for attempt in range(1, retries + 1):
        try:
            with opener(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 or attempt == retries:
                raise
        except OSError:
            if attempt == retries:
                raise
        sleep(backoff * attempt)
    raise AssertionError("unreachable")


def download(files: dict[str, str], folder: str, always: set[str] = frozenset(), get: Callable[[str], bytes] = http_get) -> dict[str, str]:
    """Fetches each file (name to URL) that is missing or in ``always``; returns the failures by name, and goes on after one."""
    failed = {}
    for name, url in files.items():
        path = Path(folder, name)
        if path.exists() and name not in always:
            continue
        try:
            body = get(url)
        except Exception as e:  # a missing source becomes a warning of the run
            failed[name] = str(e)
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        temporary = path.with_suffix(path.suffix + ".part")
        temporary.write_bytes(body)
        temporary.replace(path)
    return failed


def season_files(base: str, first_season: int, today: date) -> tuple[dict[str, str], set[str]]:
    """Names and URLs of all league files from a season on, and the names that are fetched each time: the running season's and those of all seasons."""
    current = today.year - (today.month < 7)
    files, always = {}, set()
    for start in range(first_season, current + 1):
        code = f"{start % 100:02d}{(start + 1) % 100:02d}"
        for league in MAIN_LEAGUES:
            files[f"{code}_{league}.csv"] = f"{base}/mmz4281/{code}/{league}.csv"
            if start == current:
                always.add(f"{code}_{league}.csv")
    for league in EXTRA_LEAGUES:
        files[f"extra_{league}.csv"] = f"{base}/new/{league}.csv"
        always.add(f"extra_{league}.csv")
    return files, always


def http_size(url: str, opener: Callable = urllib.request.urlopen) -> int | None:
    """The length that a server tells for a URL without sending the body; None where it tells none."""
    with opener(urllib.request.Request(url, method="HEAD")) as answer:
        told = answer.headers.get("Content-Length")
        return int(told) if told is not None else None


def refresh(files: dict[str, str], folder: str, size: Callable[[str], int | None] = http_size, get: Callable[[str], bytes] = http_get, force: bool = False) -> dict[str, str]:
    """Fetches each file whose length differs from the server's. Where the server can't be reached a file that is there is used.

    Returns what was done by name: 'kept', 'fetched' or 'offline'; no server and no file is an error.
    """
    done = {}
    for name, url in files.items():
        path = Path(folder, name)
        try:
            remote = size(url)
        except OSError as e:
            if not path.exists():
                raise ConnectionError(f"{url} can't be reached and {path} is not there") from e
            done[name] = "offline"
            continue
        if not force and remote is not None and not needs_download(str(path), remote):
            done[name] = "kept"
            continue
        failed = download({name: url}, folder, {name}, get)
        if failed:
            raise ConnectionError(f"{url}: {failed[name]}")
        done[name] = "fetched"
    return done


def needs_download(path: str, remote_size: int | None) -> bool:
    """False where the file is there and as long as the remote one, or the remote one can't be asked."""
    here = Path(path)
    return not here.exists() or remote_size is not None and here.stat().st_size != remote_size


def csv(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", comment: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV as strings (or by ``schema``); rows that do not fit are left out, a byte-order mark is taken off."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if comment:
        reader = reader.option("comment", comment)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def _place(path: str) -> str:
    """A path without its scheme."""
    return "/" + re.sub(r"^[a-z][a-z0-9+.-]*:", "", unquote(str(path))).lstrip("/")


def file_heads(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, str]]:
    """First line and encoding (UTF-8, else Latin-1) of each file, by one job; the driver gets a row for each file."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.substring_index("value", "\n", 1).alias("head"), F.is_valid_utf8("value").alias("good"))
    found = {_place(r["path"]): (r["head"].strip(), "utf-8" if r["good"] else "ISO-8859-1") for r in rows.collect()}
    return {p: found[_place(p)] for p in paths if _place(p) in found}


def csv_any_encoding(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files in UTF-8, and those that are not as Latin-1."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), (~F.is_valid_utf8("value")).alias("bad"))
    wrong = {_place(r["path"]) for r in lines.where("bad").select("path").distinct().collect()}  # at most as many as files
    clean = [p for p in paths if _place(p) not in wrong]
    rest = [p for p in paths if p not in clean]
    parts = [csv(spark, p, e) for p, e in ((clean, "utf-8"), (rest, "ISO-8859-1")) if p]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def with_columns(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, cast so that what does not fit is NULL; absent ones are NULL."""
    fields = struct(ddl).fields
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def by_file_name(df: DataFrame, pattern: str) -> DataFrame:
    """Adds the groups of a pattern over the file's name as columns g1, g2, ..; rows of files that do not fit go."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    groups = re.compile(pattern).groups
    out = df.withColumns({f"g{k}": F.regexp_extract(name, pattern, k) for k in range(1, groups + 1)})
    return out.where(F.col("_metadata.file_path").rlike(pattern + "$") if groups else F.lit(True))


def compressed_table(spark: SparkSession, path: str, ddl: str, partitions: int | None = None) -> DataFrame:
    """Wanted columns of a gzipped CSV. One file is one task to read, so rows are dealt out after it."""
    df = with_columns(csv(spark, path), ddl)
    return df.repartition(partitions) if partitions else df


def required(spark: SparkSession, path: str, read: Callable[[], DataFrame]) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        raise FileNotFoundError(f"required table is missing: {path}") from e


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """``alias, target, country, row``: comment lines and rows without alias or target are left out."""
    df = csv(spark, path, comment="#")
    df = with_columns(df, "alias STRING, target STRING, country STRING")
    return df.na.drop(subset=["alias", "target"]).withColumn("row", F.monotonically_increasing_id())


def pots(spark: SparkSession, path: str) -> DataFrame:
    """``pot, name, country`` out of a JSON document of lists by pot."""
    df = spark.read.option("multiLine", True).schema("value STRING").text(path, wholetext=True)
    parsed = df.select(F.from_json("value", "map<string,array<struct<name:string,country:string>>>").alias("m"))
    return parsed.select(F.explode("m").alias("pot", "teams")).select("pot", F.inline("teams"))


def embedded_json(text, start: str, end: str, ddl: str):
    """A JSON value between two markers of a text."""
    return F.from_json(F.regexp_extract(text, f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1), ddl)


def signature(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``name, size, modified`` of each file."""
    meta = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return meta.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def status(spark: SparkSession, folders: dict[str, str]) -> dict[str, int]:
    """How many files each folder has."""
    return {name: sum(1 for p in Path(folder).glob("*") if p.is_file()) for name, folder in folders.items()}


def injuries(spark: SparkSession) -> DataFrame:
    """No source has them yet: an empty table of the agreed schema."""
    return spark.createDataFrame([], "player_id LONG, club_id LONG, from_date DATE, until_date DATE, reason STRING")
