"""Line dedup: lines that many documents hold stay in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import BLANKS, NO_ID, id_or_none, in_slices, materialize

_HALF = 1 << 63


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without blanks at its ends and with A-Z lower-cased, or None if that is under min_chars code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _keys(min_chars: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, high, low = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                keys = {line_key(line, min_chars) for line in text.encode("utf-8", "surrogatepass").split(b"\n")}
                keys.discard(None)
                for key in keys:
                    digest = xxhash.xxh3_128_intdigest(key)
                    ids.append(doc)
                    high.append((digest >> 64) - _HALF)
                    low.append((digest & (2**64 - 1)) - _HALF)
            yield pa.record_batch([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(ids, pa.int64())], names=["high", "low", "id"])

    return of


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(every document's distinct line keys, the keys in at least min_docs documents with n_docs and their keeper).

    A key is a 128-bit digest in columns high and low; counting combines before its shuffle, so that a line which
    a third of all documents hold is one row per task. Rows count first; where rows repeat an id, what they count too
    often is taken off again.
    """
    texts, schema = docs.select(id_or_none().alias("id"), "text"), "high long, low long, id long"
    keyed = texts.mapInArrow(in_slices(_keys(min_chars)), schema)
    counted = keyed.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    again = materialize(texts.groupBy("id").count().filter("count > 1").select("id"))
    twice = texts.join(again, "id", "left_semi").mapInArrow(in_slices(_keys(min_chars)), schema).groupBy("high", "low", "id").agg((F.count("*") - 1).alias("extra"))
    twice = twice.filter("extra > 0").groupBy("high", "low").agg(F.sum("extra").alias("extra"))
    counted = counted.join(twice, ["high", "low"], "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("extra", F.lit(0))).drop("extra")
    return keyed, materialize(counted.filter(F.col("n_docs") >= min_docs))


def _rebuild(min_chars: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines_of, dropped_of = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                stay = lines
                if lost:
                    lost, stay = set(lost), []
                    for line in lines:
                        key = line_key(line, min_chars)
                        if key is None or (xxhash.xxh3_128_intdigest(key) >> 64) - _HALF not in lost:
                            stay.append(line)
                kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                lines_of.append(len(lines))
                dropped_of.append(len(lines) - len(stay))
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.string()), pa.array(lines_of, pa.int64()), pa.array(dropped_of, pa.int64())], names=["row", "kept_text", "n_lines", "n_dropped"])

    return of


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), kept_text, n_lines, n_dropped.

    Lines are split at \\n and compared stripped of blanks and with A-Z lower-cased. A key of min_chars code points
    or more that min_docs documents or more hold loses all its lines except in the largest doc_id holding it.
    Null or empty text: one empty line, kept. Rows that repeat a doc_id count as one document, and those of the
    largest doc_id all keep the line; a null doc_id counts as the smallest. Repeated lines within the keeper stay. Extra columns
    pass through in row. No documents: no rows.
    """
    keyed, repeated = repeated_lines(docs, min_chars, min_docs)
    lost = keyed.join(repeated, ["high", "low"]).filter(F.col("id") < F.col("keeper"))
    per_doc = lost.groupBy("id").agg(F.collect_set("high").alias("lost"))
    rows = docs.select(F.struct("*").alias("row"), "text", id_or_none().alias("id")).join(per_doc, "id", "left")
    schema = f"row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long"
    return rows.select("row", "text", "lost").mapInArrow(in_slices(_rebuild(min_chars)), schema)


__all__ = ["NO_ID", "dedup_lines", "line_key", "repeated_lines"]
