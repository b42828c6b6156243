"""Sinks: single-file reports, append-only logs, atomically replaced documents, versions and their promotion."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def report(df: DataFrame, path: str) -> None:
    """A small result as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    """One more batch of a run log; Parquet keeps the schema, so no header is written twice."""
    df.write.mode("append").parquet(path)


def replace(path: str, text: str) -> None:
    """A document written beside and moved into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    temporary.write_text(text, encoding="utf-8")
    os.replace(temporary, target)


def manifest(path: str, value: dict) -> None:
    replace(path, json.dumps(value, sort_keys=True, ensure_ascii=False, default=str))


def contract_page(path: str, value: dict, title: str = "Feature contract") -> None:
    """The contract for readers, with the machine's copy between markers."""
    told = {f["name"]: f["definition"] for f in value.get("features", [])}
    rows = "\n".join(f"| {k + 1} | {c} | {told.get(c, '')} |" for k, c in enumerate(value["columns"]))
    body = json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)
    replace(path, f"# {title}\n\n| place | column | definition |\n| --- | --- | --- |\n{rows}\n\n<!-- contract:begin -->\n{body}\n<!-- contract:end -->\n")


def read_contract(spark: SparkSession, path: str) -> dict:
    """The machine's copy out of the page."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)<!-- contract:begin -->\s*(.*?)\s*<!-- contract:end -->", 1)).first()[0]
    return json.loads(text)


def publish(df: DataFrame, folder: str, version: str) -> str:
    """Writes a version and then points ``latest`` at it; readers see the old version or the new one."""
    path = f"{folder}/{version}"
    df.write.mode("overwrite").parquet(path)
    replace(f"{folder}/latest", version)
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{Path(folder, 'latest').read_text().strip()}")


def archive(folder: str, names: list[str], to: str) -> list[str]:
    """Copies the files that are there; the names of those copied."""
    import shutil

    Path(to).mkdir(parents=True, exist_ok=True)
    found = [n for n in names if Path(folder, n).exists()]
    for n in found:
        shutil.copy2(Path(folder, n), Path(to, n))
    return found


class Busy(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def run_lock(path: str, hours: float = 6.0) -> Iterator[None]:
    """One run at a time; a lock older than ``hours`` is left over from a dead run and is taken."""
    lock = Path(path)
    lock.parent.mkdir(parents=True, exist_ok=True)
    if lock.exists() and time.time() - lock.stat().st_mtime > hours * 3600:
        lock.unlink(missing_ok=True)
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        raise Busy(f"{path} is held") from None
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)
