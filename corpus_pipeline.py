"""A corpus pipeline of five stages over documents: toxic documents go, repeated lines go, one of each group of near
copies stays, sources are mixed by weight, and the rest is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from chainloom.llm.common import id_or_none, materialize, release
from chainloom.llm.queries import learned_lexicon, word_tokenizer

#: A document of this score or more is rejected.
TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, learned from the labels that may be used, scores as toxic."""
    return toxicity.score_toxicity(docs, learned_lexicon(spark, sf_dir, docs)).filter(F.col("score") < TOXIC_FROM).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the lines that stay as text and their length as n_chars."""
    found = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, and of equal rows one. Groups are of texts: of two
    texts under one doc_id each stays or goes by its own group. Rows without words or without a doc_id stay."""
    groups = ngram_join.ngram_groups(docs.select("doc_id", "text")).filter("`group` is not null and doc_id is not null")
    groups = groups.groupBy("group", F.col("doc_id").alias("id"), "digest").agg(F.count("*").alias("many"))
    first = groups.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("first"))
    found = materialize(groups.join(first, "group").select("id", "digest", "many", (F.struct("id", "digest") == F.col("first")).alias("stays")))
    key = ["id", "digest"]
    rows = docs.select(F.struct("*").alias("row"), id_or_none().alias("id"), ngram_join.text_digest().alias("digest"))
    once = rows.join(found.filter("not stays or many > 1").select(*key), key, "left_anti")
    twice = rows.join(found.filter("stays and many > 1").select(*key), key, "left_semi").dropDuplicates(key)
    return once.unionByName(twice).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled by the raked weights."""
    return mixing.mix(docs).filter("sampled").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it lies in which sequence."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learning a lexicon, near-copy groups and packing are not for SQL; tests hold run() against a brute-force version of all
#: stages but the scores of toxicity, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is deleted once it is through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            release(before)
    return docs
