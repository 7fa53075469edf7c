"""Substring dedup: content-defined chunks of words, cut by a gear rolling hash and compared by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.llm.common import Batches, id_or_none, in_slices, materialize, real_id, release

#: Words that an anchor depends on: 64 bits, shifted by 8 a word.
ANCHOR_WORDS = 8


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and its 64-bit hash; words are what blanks part."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    hashes = (xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
    return starts, ends, np.fromiter(hashes, np.uint64, len(starts))


def anchors_of(hashes: np.ndarray, least_words: int) -> np.ndarray:
    """For each run of least_words words, the smallest gear hash in it: h = 256 h + word in 64 bits, so that it depends
    on the last ANCHOR_WORDS words. Equal runs have equal anchors, whatever stands around them."""
    if len(hashes) < least_words:
        return np.empty(0, np.int64)
    h = hashes.copy()
    for width in (1, 2, 4):
        h[width:] += h[:-width] << np.uint64(8 * width)
    width = least_words - ANCHOR_WORDS + 1
    return np.lib.stride_tricks.sliding_window_view(h[ANCHOR_WORDS - 1 :], width).min(axis=1).view(np.int64)


def chunks_of(hashes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first run, last run) of each chunk: the runs that follow one another with one anchor, told by the word
    they start at. A chunk's words are those of its runs, so chunks overlap and their number is about one for 22 words."""
    anchors = anchors_of(hashes, least_words)
    if not len(anchors):
        return anchors, np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    return anchors[starts], starts, np.append(starts[1:], len(anchors)) - 1


_CHUNK = "anchor long, digest long, id long, key long, word int, last int, start int, end int"
_RUN = "anchor long, digest long, id long, key long, word int, start int, end int"


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _chunks(least_words: int):
    """(id, key, text) to the chunks of each text with the digest of their words."""

    def of(batches: Batches) -> Batches:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(8)]
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, ends, hashes = words_of(_bytes(text))
                anchors, first, last = chunks_of(hashes, least_words)
                view = memoryview(hashes.tobytes())
                digests = [xxhash.xxh3_64_intdigest(view[8 * a : 8 * (b + least_words)]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                found = (anchors, np.array(digests, np.uint64).view(np.int64), np.full(len(first), doc, np.int64), np.full(len(first), key, np.int64), *(x.astype(np.int32) for x in (first, last, starts[first], ends[last + least_words - 1])))
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
            if columns[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=_names(_CHUNK))

    return of


def _runs(least_words: int):
    """(id, key, text, anchors) to the runs whose anchor is one of these, with the digest of their words."""

    def of(batches: Batches) -> Batches:
        for batch in batches:
            for doc, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, ends, hashes = words_of(_bytes(text))
                anchors = anchors_of(hashes, least_words)
                at = np.flatnonzero(np.isin(anchors, np.array(wanted, np.int64)))
                view = memoryview(hashes.tobytes())
                digests = np.array([xxhash.xxh3_64_intdigest(view[8 * k : 8 * (k + least_words)]) for k in at.tolist()], np.uint64).view(np.int64)
                columns = (anchors[at], digests, np.full(len(at), doc, np.int64), np.full(len(at), key, np.int64), *(x.astype(np.int32) for x in (at, starts[at], ends[at + least_words - 1])))
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=_names(_RUN))

    return of


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def repeated_spans(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Passages that repeat across documents, one row per passage and text that holds it: doc_id, text_hash (Spark's
    xxhash64 of the text, to tell texts of one doc_id apart), start, end (bytes of the UTF-8 text, end exclusive), words,
    first_doc_id (the smallest doc_id that holds its first least_words words), keeps (whether that is this one).

    Words are what blanks part. A run of least_words words (8 at least) repeats if documents of at least two ids hold
    it; every such run is found, and what such runs cover is a passage, exact to the word at both ends, periodic texts
    included. Runs that this document keeps and runs that it doesn't are passages of their own, which may overlap.
    Null and empty texts have no runs. Rows that repeat a doc_id are one document, whose texts have passages each; rows
    without a doc_id are one document, the smallest, returned as null. Texts of any length are read whole; texts
    without blanks are one word and have no passages. No documents: no rows.

    Each text is cut into content-defined chunks: runs whose smallest gear hash is the same. Where all chunks of an
    anchor have one digest, the chunk repeats as a whole and no run of it is looked at. Only for anchors whose chunks
    differ, that is, near the ends of passages, single runs are compared by digest. Counts combine before their shuffle,
    so that what many documents hold is a row per task; what repeats is joined back, which Spark splits where an anchor
    or a digest is frequent.
    """
    if least_words < ANCHOR_WORDS:
        raise ValueError(f"least_words is {ANCHOR_WORDS} at least")
    texts = docs.select(id_or_none().alias("id"), F.xxhash64("text").alias("key"), "text")
    chunks = materialize(texts.mapInArrow(in_slices(_chunks(least_words)), _CHUNK))
    ends = [f("id").alias(name) for f, name in ((F.min, "first"), (F.max, "last_id"))]
    known = chunks.groupBy("anchor").agg(*ends, F.min("digest").alias("a"), F.max("digest").alias("b"))
    known = known.filter("first < last_id").select("anchor", "first", (F.col("a") == F.col("b")).alias("even"))
    shared = materialize(chunks.join(materialize(known), "anchor").drop("digest"))
    release(chunks)
    wanted = shared.filter("not even").groupBy("id", "key").agg(F.collect_set("anchor").alias("anchors"))
    runs = materialize(texts.dropDuplicates(["id", "key"]).join(wanted, ["id", "key"]).mapInArrow(in_slices(_runs(least_words)), _RUN))
    repeated = runs.groupBy("anchor", "digest").agg(*ends).filter("first < last_id").drop("last_id")
    place = ("id", "key", "word", "last", "start", "end", "first")
    found = runs.join(materialize(repeated), ["anchor", "digest"]).withColumn("last", F.col("word")).select(*place)
    found = found.unionByName(shared.filter("even").select(*place)).withColumn("keeps", F.col("id") == F.col("first"))

    order = Window.partitionBy("id", "key", "keeps").orderBy("word")
    fresh = F.coalesce((F.col("word") > F.lag("last").over(order) + least_words).cast("int"), F.lit(1))
    passages = found.withColumn("fresh", fresh).withColumn("passage", F.sum("fresh").over(order)).groupBy("id", "key", "keeps", "passage")
    passages = passages.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("word") + least_words).alias("words"), F.min_by("first", "word").alias("first"))
    return passages.select(real_id("id").alias("doc_id"), F.col("key").alias("text_hash"), "start", "end", "words", real_id("first").alias("first_doc_id"), "keeps")


def _without(batches: Batches) -> Batches:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, at, kept = _bytes(text), 0, []
            for span in sorted(spans or [], key=lambda s: s["start"]):
                kept.append(data[at : span["start"]])
                at = max(at, span["end"])
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["row", "kept_text"])


def drop_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns) and kept_text, without the passages of spans that
    another document keeps; a character that a cut would split goes with it."""
    mine = ["id", "key"]
    lost = spans.filter(~F.col("keeps")).groupBy(id_or_none().alias("id"), F.col("text_hash").alias("key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), "text", id_or_none().alias("id"), F.xxhash64("text").alias("key")).join(lost, mine, "left").select("row", "text", "spans")
    return rows.mapInArrow(in_slices(_without), f"row {rows.schema['row'].dataType.simpleString()}, kept_text string")
