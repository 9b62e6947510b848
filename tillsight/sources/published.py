"""Versions of a set of tables, replaced as a whole.

A version's tables are written into a folder of their own; a manifest, one small file that names the folder and its
tables, is created last.  Readers take the newest manifest and stay with its folder, so a write that is killed leaves the version before
as it was, and one that ends meanwhile does not change what they read.  ``clean`` deletes old manifests, then the folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_lean


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there; hidden files left out."""
    fs, at = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n[0] not in "._")


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if it is there."""
    fs, at = _folder(spark, path)
    stream = fs.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()


@dataclass(frozen=True)
class Version:
    """One published version; what it reads never changes."""

    spark: SparkSession
    base: str
    number: int
    folder: str
    tables: tuple[str, ...]

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"{name}: this version has {', '.join(self.tables)}")
        return self.spark.read.parquet(f"{self.base}/data/{self.folder}/{name}")


def versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n) for n in list_names(spark, f"{base}/manifests") if n.isdigit())


def pinned(spark: SparkSession, base: str, number: int) -> Version:
    row = spark.read.text(f"{base}/manifests/{number:012d}", wholetext=True).first()
    named = json.loads(row["value"])
    return Version(spark, base, number, named["folder"], tuple(named["tables"]))


def read_all(spark: SparkSession, base: str, name: str, number_col: str) -> DataFrame | None:
    """A table's rows of all versions, with the number of each; the manifests are read in one job."""
    known = versions(spark, base)
    if not known:
        return None
    rows = spark.read.text([f"{base}/manifests/{n:012d}" for n in known], wholetext=True).collect()  # a line a version
    folders = [m["folder"] for m in (json.loads(r["value"]) for r in rows) if name in m["tables"]]
    table = spark.read.parquet(*[f"{base}/data/{f}/{name}" for f in folders])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d{12})-", 1).cast("bigint")
    return table.select("*", number.alias(number_col))


def current(spark: SparkSession, base: str) -> Version | None:
    """The last version whose manifest is there."""
    known = versions(spark, base)
    return pinned(spark, base, known[-1]) if known else None


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None,
            number: int | None = None) -> Version:
    """Writes the tables and then the manifest.  ``number``: the version, for writers that may try again (a batch of
    a stream); a version that is there already is left as it is and returned."""
    known = versions(spark, base)
    if number is None:
        number = known[-1] + 1 if known else 0
    elif number in known:
        return pinned(spark, base, number)
    folder = f"{number:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        by = (partition_by or {}).get(name, [])
        write_lean(df, f"{base}/data/{folder}/{name}", by)
    _create(spark, f"{base}/manifests/{number:012d}", json.dumps({"folder": folder, "tables": list(tables)}))
    return Version(spark, base, number, folder, tuple(tables))


def clean(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Deletes all but the last ``keep`` versions, and folders of writes that never ended (below the last version's number).
    Returns the folders that went."""
    known = versions(spark, base)
    if not known:
        return []
    for number in known[:-keep]:
        delete_path(spark, f"{base}/manifests/{number:012d}")
    named = {pinned(spark, base, n).folder for n in known[-keep:]}
    gone = [f for f in list_names(spark, f"{base}/data") if f not in named and int(f.split("-")[0]) <= known[-1]]
    for folder in gone:
        delete_path(spark, f"{base}/data/{folder}")
    return gone
