"""Mixing sources to target weights: bounded iterative proportional fitting over cells, then sampling."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.llm.common import materialize, release

MARGINS = ("source", "lang", "topic")
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
#: Sweeps over the margins in one job; the share of all tokens by which a margin may be off without a warning.
SWEEPS_A_JOB, CONTRADICTION = 5, 1e-3


def token_weight(text: Column | str = "text") -> Column:
    """Words of a text, 1 at least."""
    text = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))).cast("long")


def topic_of(text: Column | str = "text") -> Column:
    """A coarse topic by form: table, noise, note (under 400 characters), book (over 20,000) or prose."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    noise = text.contains("%%%") | text.contains("&&&") | text.contains("$$$") | text.contains("***") | text.contains("###")
    return (
        F.when(text.contains(" | "), "table").when(noise, "noise").when(F.length(text) < 400, "note").when(F.length(text) > 20_000, "book").otherwise("prose")
    )


def wanted(cells: DataFrame, margin: str, budget: float, flatten: float = 0.7, given: Mapping[str, float] | None = None) -> DataFrame:
    """(margin, to_margin): the tokens that each value shall have in the sample, budget of all tokens in all.

    Shares are as given, or else proportional to the value's tokens to the power flatten; values without a given share
    keep their own. No value can give more tokens than it has: those that fall short give all, and the others share what
    is left in proportion. Values stand in the order in which they run out, so one pass over them settles who does. One
    row per value goes through a window over all.
    """
    values = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("have"))
    own = F.col("have") / F.sum("have").over(Window.partitionBy(F.lit(0)))
    if given:
        share = F.coalesce(F.create_map(*(F.lit(x) for pair in given.items() for x in pair))[F.col(margin)].cast("double"), own)
    else:
        share = F.pow("have", F.lit(flatten))
    order = Window.partitionBy(F.lit(0)).orderBy("lasts", margin)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    rate = (budget * F.sum("have").over(everything) - F.coalesce(F.sum("have").over(before), F.lit(0.0))) / F.sum("share").over(after)
    values = values.withColumn("share", F.greatest(share, F.lit(1e-12))).withColumn("lasts", F.col("have") / F.col("share")).withColumn("rate", rate)
    fits = F.min(F.when(F.col("rate") <= F.col("lasts"), F.col("lasts"))).over(everything)
    settled = F.coalesce(F.max(F.when(F.col("lasts") == fits, F.col("rate"))).over(everything), F.col("lasts"))
    return values.select(margin, F.least("have", settled * F.col("share")).alias(f"to_{margin}"))


def sweep(cells: DataFrame, margins: Sequence[str] = MARGINS) -> DataFrame:
    """One step for each margin: the expected tokens of a value's cells scaled to what it shall have, no cell beyond its
    own tokens."""
    for m in margins:
        cells = cells.withColumn("expected", F.least(F.col("tokens"), F.col("expected") * F.col(f"to_{m}") / F.sum("expected").over(Window.partitionBy(m))))
    return cells


def rake(cells: DataFrame, budget: float, margins: Sequence[str] = MARGINS, flatten: float = 0.7, targets: Mapping[str, Mapping[str, float]] | None = None, tolerance: float = 1e-12, most_sweeps: int = 60) -> DataFrame:
    """cells(margins..., tokens) with to_margin for each margin (see wanted), expected tokens and probability.

    Raking and capping at probability 1 are one fit: sweeps go on until every margin is met within tolerance of all
    tokens, most_sweeps at most. What is off by more than CONTRADICTION of all tokens then, as where margins contradict one
    another, is told by a warning, and by residuals() value by value. The cells, one for
    each combination of values, fit one task, which needs no shuffle.
    """
    tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("tokens", F.col("tokens").cast("double")).withColumn("expected", budget * F.col("tokens"))
    for m in margins:
        out = out.join(wanted(cells, m, budget, flatten, (targets or {}).get(m)), m)
    out = materialize(out)
    off = 0.0
    for _ in range(0, most_sweeps, SWEEPS_A_JOB):
        before, out = out, out.coalesce(1)
        for _ in range(SWEEPS_A_JOB):
            out = sweep(out, margins)
        gaps = (F.abs(F.sum("expected").over(Window.partitionBy(m)) - F.col(f"to_{m}")) for m in margins)
        out = materialize(out.withColumn("off", F.greatest(*gaps, F.lit(0.0))))
        release(before)
        off = out.agg(F.max("off")).first()[0] or 0.0
        out = out.drop("off")
        if off <= tolerance * tokens:
            break
    if off > CONTRADICTION * tokens:
        warnings.warn(f"after {most_sweeps} sweeps some value is {off:.0f} of {tokens} tokens off its target", stacklevel=2)
    return out.withColumn("probability", F.least(F.lit(1.0), F.col("expected") / F.col("tokens")))


def residuals(cells: DataFrame, margin: str) -> DataFrame:
    """(margin, expected, wanted, off) of a raked table: how far each value is from what it shall have, in tokens."""
    found = cells.groupBy(margin).agg(F.sum("expected").alias("expected"), F.first(f"to_{margin}").alias("wanted"))
    return found.withColumn("off", F.col("expected") - F.col("wanted"))


def draw(doc_id: Column | str = "doc_id", salt: str = "mix", text: Column | str = "text") -> Column:
    """A number from 0 to 1 that depends on the id alone; where that is null, on the text."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), text), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{salt}"))), 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, topic: Column | None = None, flatten: float = 0.7, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = 0.6, salt: str = "mix") -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), topic, tokens, probability, sampled.

    Tokens are summed over all documents by source, language and topic (the topic given, else a column topic, else
    topic_of) and raked to the targets (see rake); a document is sampled if its draw is below its cell's probability, so
    rows that repeat a doc_id are sampled together; rows without one draw by their text. Null source, lang or topic count as empty, as does a null text, and an
    empty text weighs one token. No documents: no rows. DataFrame operations only; the sums combine before their shuffle.
    """
    topic = topic if topic is not None else F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of()
    cell = [F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), topic.alias("topic")]
    rows = docs.select(F.struct("*").alias("row"), *cell, token_weight().alias("tokens"), draw(salt=salt).alias("draw"))
    sums = materialize(docs.select(*cell, token_weight().alias("tokens")).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    cells = rake(sums, budget, flatten=flatten, targets=targets).select(*MARGINS, "probability")
    joined = rows.join(cells, list(MARGINS))
    return joined.select("row", "topic", "tokens", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))
