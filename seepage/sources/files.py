"""Files as Spark names them, opened by tasks through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs as afs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def opened(uri: str):
    """(file system, path) of a URI."""
    return afs.FileSystem.from_uri(uri)


def listed(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """(URI, size) of a file, or of the files of a folder that end with suffix, in order of their names; hidden files are left out."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == afs.FileType.File:
        return [(uri, info.size)]
    if info.type != afs.FileType.Directory:
        raise FileNotFoundError(uri)
    found = [i for i in system.get_file_info(afs.FileSelector(path)) if i.type == afs.FileType.File and i.base_name.endswith(suffix) and i.base_name[0] not in "._"]
    return [(f"{uri.rstrip('/')}/{i.base_name}", i.size) for i in sorted(found, key=lambda i: i.base_name)]
