"""Tables that are replaced together: versioned folders and one pointer file.

A publication writes all its tables into a folder of a new version; nothing that readers
see changes meanwhile. The pointer file is then put in place of the old one, which is the
commit: until then readers get all the old tables, from then on all the new ones. Folders
of versions that no pointer names hold no more than a killed job left there or what
earlier readers may still use; `drop_old` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
VERSIONS = "_versions"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def _read_json(spark: SparkSession, path: str) -> dict | None:
    if not path_exists(spark, path):
        return None
    # Spark's readers skip files whose names begin with an underscore.
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a file that takes its place in one step, over an old one if there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, place = _path(spark, f"{path}-{uuid.uuid4().hex}"), _path(spark, path)
    out = _files(spark, path).create(aside, False)
    out.write(json.dumps(value).encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, place, over)


def publish(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], root: str, links: Mapping[str, str] | None = None) -> str:
    """Replace the tables below `root`, all at once; returns the version.

    `tables` has for each name its rows and the columns of its folders. `links` makes
    other paths stand for a table of this root; they follow its versions.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (df, folders) in tables.items():
        df.write.partitionBy(*folders).parquet(f"{root}/{VERSIONS}/{version}/{name}")
    for path, name in (links or {}).items():
        link = {"root": root, "name": name}
        if _read_json(spark, f"{path}/{POINTER}") != link:
            _put_json(spark, f"{path}/{POINTER}", link)
    _put_json(spark, f"{root}/{POINTER}", {"version": version, "names": list(tables)})
    return version


def table_path(spark: SparkSession, path: str, name: str | None = None) -> str:
    """Where the rows of a published table lie now; any other path stands for itself.

    Without a name it is the path's own table: the one it is linked to, or the first one
    of a root.
    """
    found = _read_json(spark, f"{path}/{POINTER}")
    if found is None:
        return path if name is None else f"{path}/{name}"
    if "root" in found:
        return table_path(spark, found["root"], found["name"])
    return f"{path}/{VERSIONS}/{found['version']}/{name or found['names'][0]}"


def drop_old(spark: SparkSession, root: str) -> int:
    """Delete all versions but the current one; returns how many. No reader may still use them."""
    current = _read_json(spark, f"{root}/{POINTER}")
    files, where = _files(spark, root), _path(spark, f"{root}/{VERSIONS}")
    if current is None or not files.exists(where):
        return 0
    old = [s.getPath() for s in files.listStatus(where) if s.getPath().getName() != current["version"]]
    for path in old:
        files.delete(path, True)
    return len(old)
