"""Tables that readers see whole or not at all: data are written aside, and one rename makes them the current version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published first."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, data folder) of the published versions, oldest first."""
    p, system = _at(spark, f"{path}/_commits")
    if not system.exists(p):
        return []
    out = []
    for status in system.listStatus(p):
        name = status.getPath().getName()
        if name.isdigit():
            stream = system.open(status.getPath())
            try:
                out.append((int(name), json.loads(bytes(stream.readAllBytes()))["folder"]))
            finally:
                stream.close()
    return sorted(out)


def commit(spark: SparkSession, path: str, folder: str, number: int) -> None:
    """Name folder as version number. The rename fails if the version is there, so that of two writers one has to try again."""
    aside, system = _at(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    stream = system.create(aside)
    stream.write(json.dumps({"folder": folder}).encode())
    stream.close()
    to, _ = _at(spark, f"{path}/_commits/{number:012d}")
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, to, spark.sparkContext._gateway.new_array(rename, 0))
    except Exception as e:
        system.delete(aside, False)
        if system.exists(to):
            raise Conflict(f"version {number} of {path} is there already") from e
        raise


def publish(df: DataFrame, path: str, after: int | None = None) -> int:
    """Write df as the next version of path and return its number. after: the version that df was made from; if a later one is there, Conflict is raised.

    Up to the last rename readers have the version before; what a writer that dies leaves behind is never read."""
    spark = df.sparkSession
    if after is None:
        after = max((n for n, _ in versions(spark, path)), default=0)
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    commit(spark, path, folder, after + 1)
    return after + 1


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The current version, or that of a number; None if nothing is published."""
    found = [v for v in versions(spark, path) if version in (None, v[0])]
    return spark.read.parquet(f"{path}/{found[-1][1]}") if found else None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the data of all but the newest versions, and folders that no version names; returns how many. No writer may be at work, nor a reader of an older version."""
    known = versions(spark, path)
    kept = {folder for _, folder in known[-keep:]}
    p, system = _at(spark, path)
    gone = [s.getPath() for s in system.listStatus(p) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in kept]
    for number, _ in known[:-keep]:
        system.delete(_at(spark, f"{path}/_commits/{number:012d}")[0], False)
    for folder in gone:
        system.delete(folder, True)
    return len(gone)


def replace_folder(df: DataFrame, path: str, fmt: str) -> None:
    """Put df in the place of a plain folder: written aside, then two renames. Between them readable() finds the old rows."""
    spark = df.sparkSession
    wanted, system = _at(spark, path)
    fresh, _ = _at(spark, f"{path}.new-{uuid.uuid4().hex}")
    old, _ = _at(spark, f"{path}.old")
    df.write.format(fmt).save(fresh.toString())
    if system.exists(wanted):
        if system.exists(old):
            system.delete(old, True)
        _move(system, wanted, old)
    _move(system, fresh, wanted)
    if system.exists(old):
        system.delete(old, True)


def _move(system, a, b) -> None:
    if not system.rename(a, b):
        raise OSError(f"{a} could not be renamed to {b}")


def readable(spark: SparkSession, path: str) -> str | None:
    """Where the rows of a folder put by replace_folder are: path, or the rows before, if a writer died between its renames."""
    return next((p for p in (path, f"{path}.old") if exists(spark, p)), None)
