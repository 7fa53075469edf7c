"""Blocks from files: newline-delimited JSON, batch or stream, and a cache of finalized blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.errors import SinkError
from chainloom.plans.ranges import Range
from chainloom.sources.schemas import block_type

#: Blocks per folder of the tables that are partitioned by block.
BUCKET = 10_000


def read_blocks(spark: SparkSession, path: str, family: str, fields: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Blocks of newline-delimited JSON under an explicit schema; a line that breaks it fails the job."""
    return spark.read.schema(block_type(family, fields)).option("mode", "FAILFAST").json(path)


def stream_blocks(spark: SparkSession, path: str, family: str, fields: Mapping[str, Sequence[str]] | None = None, files_per_batch: int = 16) -> DataFrame:
    """The same as a stream of files as they arrive."""
    return spark.readStream.schema(block_type(family, fields)).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(path)


def finalized_only(blocks: DataFrame, floor: int, number: str = "header.number") -> DataFrame:
    return blocks.filter(F.col(number) <= floor)


def check_ascending(blocks: DataFrame, number: str = "number", parent: str = "parentHash", own: str = "hash") -> DataFrame:
    """Blocks whose parent hash is not the hash of the block before them: gaps are allowed, breaks are returned. A
    self-join on consecutive numbers, so no window over all."""
    before = blocks.select((F.col(number) + 1).alias("_n"), F.col(own).alias("_h")).distinct()
    return blocks.join(before, blocks[number] == F.col("_n")).filter(F.col(parent) != F.col("_h")).select(*blocks.columns)


def query_key(query: Mapping, positional: Sequence[str] = ("fromBlock", "toBlock", "parentBlockHash")) -> str:
    """The name of a query in the cache: its canonical JSON without where it starts and ends, by SHA-256."""
    import hashlib

    text = json.dumps({k: v for k, v in query.items() if k not in positional}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def add_to_cache(blocks: DataFrame, path: str, key: str, covered: Range, floor: int) -> Range | None:
    """Append the finalized part of a covered range to the cache, a folder by query, first and last block; returns what
    was added. Data are written before the folder has its name's row in a read, so a repeat overwrites the same folder."""
    part = covered.intersect(Range(0, floor))
    if part is None:
        return None
    target = f"{path}/query={key}/first={part.start}/last={part.end}"
    finalized_only(blocks, part.end).write.mode("overwrite").parquet(target)
    return part


def cached_chain(spark: SparkSession, folders: DataFrame, start: int) -> DataFrame:
    """Of cached folders (first, last), those that follow one another without a gap from start."""
    ordered = Window.orderBy("first")
    rows = folders.filter(F.col("last") >= start).withColumn("follows", (F.col("first") <= F.coalesce(F.lag("last").over(ordered) + 1, F.lit(start))).cast("int"))
    return rows.withColumn("unbroken", F.min("follows").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).filter("unbroken = 1").select("first", "last")


def replayed(spark: SparkSession, path: str, key: str, start: int, number: str = "header.number") -> tuple[DataFrame | None, int]:
    """(blocks, cut): what the cache of a query holds without a gap from start on, each block once where folders overlap,
    and the block that follows it, where a live source takes over; no blocks and start itself where the cache has none.

    Folders are told by their names, which the driver lists; only those of the chain are read, each from where the one
    before it ended."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/query={key}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/query={key}/first=*/last=*/_SUCCESS")) if files.exists(root) else []
    folders = sorted(tuple(int(x.partition("=")[2]) for x in f.getPath().getParent().toString().split("/")[-2:]) for f in found)
    parts, cut = [], start
    for first, last in folders:
        if first > cut:
            break  # a gap: what lies behind it comes live
        if last >= cut:
            parts.append(spark.read.parquet(f"{path}/query={key}/first={first}/last={last}").filter(F.col(number).between(cut, last)))
            cut = last + 1
    return (reduce(DataFrame.unionByName, parts) if parts else None), cut


_SQL_PARTS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.S)


def split_statements(text: str) -> list[str]:
    """The statements of a script: parted at semicolons outside of quotes and comments; those without words are left out."""
    parts: list[list[str]] = [[]]
    for found in _SQL_PARTS.finditer(text):
        if found[0] == ";":
            parts.append([])
        elif not found[0].startswith(("--", "/*")):
            parts[-1].append(found[0])
        else:
            parts[-1].append(" ")
    return [x for x in ("".join(p).strip() for p in parts) if x]


def sql_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, text) of the .sql files of a folder that Spark can read, in the order of their names."""
    rows = spark.read.option("pathGlobFilter", "*.sql").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return sorted((r["name"], r["value"]) for r in rows.collect())  # scripts, a handful


def run_migrations(spark: SparkSession, statements: Sequence[tuple[str, str]]) -> list[str]:
    """Run named SQL scripts (see sql_files) in the order of their names; returns the names. Two of one name are refused
    before any is run."""
    names = sorted(name for name, _ in statements)
    if len(set(names)) != len(names):
        raise SinkError("two migrations share a name")
    for _, text in sorted(statements):
        for statement in split_statements(text):
            spark.sql(statement)
    return names
