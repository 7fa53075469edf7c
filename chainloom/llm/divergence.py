"""Source divergence audit: which sources of a language use its words otherwise than one another, and by which words."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.llm.common import materialize, release

#: A term: letters A-Z and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = TERM.replace("^", "")
#: What every count is raised by, and what shares are counted in.
ADDED, UNIT = 2, 1_000_000_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), exact: products go through decimals."""
    wide = "decimal(38,0)"
    above = (count + ADDED).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return _div(above.cast(wide), (total + ADDED * terms).cast(wide)) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term by group, and in how many documents (rows)."""
    ascii_only = F.octet_length("text") == F.char_length("text")
    plain = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    found = docs.select("lang", "source", F.array_remove(F.split(plain, _BETWEEN), "").alias("terms"))
    # all terms of a text, and behind them each once more, for the number of documents
    rows = found.select("lang", "source", F.size("terms").alias("many"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    first = F.col("at") < F.col("many")
    rows = rows.select("lang", "source", "term", first.cast("int").alias("n"), (~first).cast("int").alias("d"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def _frames(groups: DataFrame, wide: DataFrame) -> DataFrame:
    """One row per lang: its sources in order, the kept occurrences of each, of all, and the number of kept terms."""
    totals = wide.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("terms"))
    rows = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("by"))
    rows = rows.join(kept, "lang", "left").select("lang", F.col("by.source").alias("sources"), F.col("by.n").alias("totals"), F.coalesce("terms", F.lit(0)).alias("terms"))
    return rows.withColumn("total", F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b))


def _vectors(wide: DataFrame, frames: DataFrame) -> DataFrame:
    """Each kept term as arrays indexed by the sources of its lang: counts, and the shares p."""
    found = wide.join(frames, "lang").withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.element_at("held", s), F.lit(0))))
    return found.withColumn("p", F.zip_with("counts", "totals", lambda n, total: share(n, total, F.col("terms"))))


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """(lang, i, j, value, touched): contributions of the terms that i or j holds, for places i < j of sources."""
    p, counts = F.col("p"), F.col("counts")
    at = lambda a, k: F.get(a, k)

    def of(i: Column) -> Column:
        rest = F.sequence(i + 1, F.size(p) - 1)
        rest = F.filter(rest, lambda j: (at(counts, i) > 0) | (at(counts, j) > 0))
        return F.transform(rest, lambda j: F.struct(i.alias("i"), j.alias("j"), divergence(at(p, i), at(p, j)).alias("f")))

    some = vectors.filter(F.size("sources") > 1)
    rows = some.select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - 2), of))).alias("x"))
    return rows.groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("value"), F.count("*").alias("touched"))


def source_divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of docs(lang, source, text); other columns are not read.

    Terms are runs of letters, A-Z lower-cased; a lang keeps those in least_docs of its rows. Each source of a lang, and
    the lang itself, gives a kept term the share p of its occurrences, raised by 2 so that none is zero. Part 'pair' has
    for each other source the chi-square-like divergence summed over all kept terms; part 'term' the first top_terms
    terms that a source uses more than its lang does. Ranks from 1 by value, largest first, ties by item in UTF-8 order.

    Nulls in any of the three columns are ''. Rows that repeat count as documents each. A source without kept terms has
    its pairs; a lang that keeps none has pairs of value 0; a lang of one source has no pairs. No rows: no rows.

    Two shuffles of counts that are added up before each; a term is then one row with an array over the sources of its
    lang. Its contributions to pairs are emitted by higher-order functions and added up before their shuffle: for pairs
    that neither source holds they are the same for every such term, and are added once. A lang's sources number S; a
    term's row is S wide and the result has S^2 rows, so S is what must stay moderate, not rows or terms. Per source
    the first terms are cut down before the shuffle as well.
    """
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(clean)
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held"))
    wide = materialize(wide.filter(F.col("docs") >= least_docs).select("lang", "term", "held"))
    frames = materialize(_frames(clean.select("lang", "source").distinct(), wide))
    vectors = _vectors(wide, frames)

    sums = _pair_sums(vectors)
    places = frames.select("*", F.posexplode("sources").alias("i", "a")).select("*", F.posexplode("sources").alias("j", "b")).filter("i < j")
    none = lambda k: share(F.lit(0).cast("long"), F.get("totals", F.col(k)), F.col("terms"))
    rest = F.when(F.col("terms") == 0, 0).otherwise((F.col("terms") - F.coalesce("touched", F.lit(0))) * divergence(none("i"), none("j")))
    pairs = places.join(sums, ["lang", "i", "j"], "left").select("lang", "a", "b", (F.coalesce("value", F.lit(0)) + rest).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", sides.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b), F.col("total"), F.col("terms"))
    own = vectors.select("lang", "term", q.alias("q"), F.explode(F.arrays_zip("sources", "counts", "p")).alias("x"))
    own = own.filter("x.counts > 0 and x.p > q").select("lang", F.col("x.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("x.p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    out = materialize(ranked(pairs).unionByName(ranked(own).filter(F.col("rank") <= top_terms)))
    release(wide)
    release(frames)
    return out
