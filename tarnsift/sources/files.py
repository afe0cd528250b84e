"""Delimited and typed tables: readers, writers and a catalogue of versioned names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators by format.
SEPARATORS = {"tsv": "\t", "csv": ",", "csv_strict": ",", "ssv": ";", "psv": "|"}


def format_of(path: str) -> str:
    """Format of a path, without .gz and .bgz."""
    kind = re.sub(r"\.(gz|bgz|zst)$", "", path).rpartition(".")[2]
    if kind not in SEPARATORS and kind != "parquet":
        raise NotImplementedError(f"no reader for {path}")
    return kind


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, kind: str | None = None, *, header: bool = True, comment: str | None = None) -> DataFrame:
    """Typed scan; a row that doesn't fit the schema fails the query."""
    kind = kind or format_of(path)
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path)
    options = {"sep": SEPARATORS[kind], "header": header, "mode": "FAILFAST", "enforceSchema": True}
    if comment:
        options["comment"] = comment
    return spark.read.options(**options).schema(schema).csv(path)


def read_lines(spark: SparkSession, path: str, grep: str | None = None) -> DataFrame:
    lines = spark.read.text(path)
    return lines.filter(F.col("value").rlike(grep)) if grep else lines


def convert(df: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """(name, header, type) triples to renamed, cast columns; what can't be cast is null."""
    return df.select(*[F.col(f"`{h}`").try_cast(t).alias(n) for n, h, t in columns])


def write_records(df: DataFrame, path: str, kind: str = "tsv", mode: str = "error") -> None:
    if kind == "parquet":
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    else:
        df.write.mode(mode).options(sep=SEPARATORS[kind], header=True).csv(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Laid out by keys, so that scans with a key's value open its folders alone."""
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)


@dataclass(frozen=True)
class VersionedName:
    """class.flavor.vN.role.format"""

    file_class: str
    flavor: str
    version: int
    role: str
    format: str

    @staticmethod
    def parse(name: str) -> "VersionedName":
        m = re.fullmatch(r"([^.]+)\.(.+)\.v(\d+)\.([^.]+)\.([^.]+)", name)
        if not m:
            raise ValueError(f"not a versioned name: {name}")
        return VersionedName(m[1], m[2], int(m[3]), m[4], m[5])

    @staticmethod
    def choose(names: list[str], **fields) -> "VersionedName":
        """The latest version among names whose fields are as given."""
        found = []
        for x in names:
            try:
                v = VersionedName.parse(x)
            except ValueError:
                continue
            if all(getattr(v, k) == f for k, f in fields.items()):
                found.append(v)
        if not found:
            raise LookupError(f"no version with {fields}")
        return max(found, key=lambda v: v.version)


def matching_paths(spark: SparkSession, folder: str, pattern: str = "*", *, deep: bool = False) -> DataFrame:
    """(path, length, modified) of the files of a folder whose names match a glob; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))
