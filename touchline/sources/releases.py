"""Releases of a folder on any file system that Spark reads: versions beside each other, and a pointer to the one in use.

A version is copied whole before the pointer names it, and the pointer is swapped
by one rename, so a run that dies in between leaves the release before it in use.
Old versions stay, as the archive. Readers ask for ``current`` and read that folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder or a file, between file systems too; what is in the target's place is replaced."""
    a, b = _path(spark, source), _path(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    _system(spark, b).delete(b, True)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(_system(spark, a), a, _system(spark, b), b, False, True, conf):
        raise OSError(f"{source} could not be copied to {target}")


def publish(spark: SparkSession, staged: str, root: str, version: str) -> str:
    """Makes the staged folder the release in use; its place. A version that was left half copied is copied anew; the one in use is an error."""
    if not version or "/" in version or version == POINTER:
        raise ValueError(f"no name of a version: {version!r}")
    place = f"{root.rstrip('/')}/{version}"
    if current(spark, root) == place:
        raise FileExistsError(f"{version} is in use")
    copy_tree(spark, staged, place)
    point(spark, root, version)
    return place


def point(spark: SparkSession, root: str, version: str) -> None:
    """Swaps the pointer by one rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = _path(spark, root, f".{POINTER}.{version}"), _path(spark, root, POINTER)
    out = _system(spark, new).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(spark, old).makeQualified(old).toUri(), conf)
    qualified = _system(spark, old)
    context.rename(qualified.makeQualified(new), qualified.makeQualified(old), how)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the release in use, or None where there is none."""
    pointer = _path(spark, root, POINTER)
    if not _system(spark, pointer).exists(pointer):
        return None
    return f"{root.rstrip('/')}/{spark.read.text(pointer.toString(), wholetext=True).first()[0].strip()}"


def versions(spark: SparkSession, root: str) -> list[str]:
    """All versions that are there, by name, half copied ones included."""
    at = _path(spark, root)
    system = _system(spark, at)
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()) if system.exists(at) else []
