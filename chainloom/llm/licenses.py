"""License scans: canonical digests of whole texts and of their lines, looked up among known licences."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import id_or_none, real_id

# Short licences and notices as published, and spellings that count as equal.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
#: Titles that stand above a text that has none of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
}
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorise", "authorize"), ("non commercial", "noncommercial"))
COPYRIGHT = r"(?m)^[^\n\p{L}\p{N}(©]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORDS = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column | str = "text") -> Column:
    """Lower case, without copyright lines, one space for all that is no letter, digit or line end, and one spelling."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT, ""), NOT_WORDS, " ")
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN, and the entire texts and standard headers of license_texts.json, as they are and under the usual titles."""
    shipped = json.loads((Path(__file__).parent / "license_texts.json").read_text("utf-8"))
    texts = [(x["license_id"], x["text"]) for x in shipped]
    return (*KNOWN, *texts, *((name, f"{title}\n\n{text}") for name, text in texts for title in TITLES.get(name, ())))


def known_licenses(spark: SparkSession, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(license_id, digest) of the canonical texts, by default of known_texts()."""
    texts = known_texts() if texts is None else texts
    lines = spark.createDataFrame(list(texts), "license_id string, text string").withColumn("lines", _lines(canonical()))
    return lines.select("license_id", F.sha2(F.array_join("lines", " "), 256).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, license_id of the whole text or null, notices: the known licences that lines of
    it are, sorted and joined by commas, empty if none.

    Texts are compared by the SHA-256 of their canonical form, so case, punctuation, copyright lines and equivalent
    spellings make no difference, and a text of any length costs one digest for each line and one for all. Empty and
    null texts match nothing. Of several licences with one text the first by name counts. Each row has the findings
    of its own text, also where rows repeat a doc_id or have none; extra columns are not read. The digests are hash-joined with the known ones, which Spark
    broadcasts only if they are small. No documents: no rows. DataFrame operations only.
    """
    row = [id_or_none().alias("id"), F.xxhash64("text").alias("key")]  # tells texts of one id apart
    lines = docs.select(*row, _lines(canonical()).alias("lines")).filter(F.size("lines") > 0)
    whole = F.struct(F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.lit(True).alias("whole"))
    each = F.transform(F.array_distinct("lines"), lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.lit(False).alias("whole")))
    units = lines.select("id", "key", F.explode(F.concat(F.array(whole), each)).alias("unit")).select("id", "key", "unit.*")
    one = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    found = units.join(one, "digest").groupBy("id", "key").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    )
    out = docs.select(*row).join(found, ["id", "key"], "left")
    return out.select(real_id("id").alias("doc_id"), "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
