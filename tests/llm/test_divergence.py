"""Source divergence against a plain recomputation."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chainloom.llm import divergence, queries
from tests.oracle import assert_same, connect


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = re.findall(divergence.TERM, text.translate(lower))
        counts[lang, source].update(found)
        documents[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in documents[lang].items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS rank")
    return sorted(tuple(r) for r in divergence.source_divergence(df, **kw).collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "Éa", "éa", "x1y", "don't", "\U0001f600q", "zz", "y"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for _ in range(150):
        lang = rng.choice(["en", "en", "de", None, "", "x"])
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None, "\U0001f600", "￿"])
        rows.append((lang, source, rng.choice([None, "", "12 !"] + [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(6)])))
    rows += rows[:20]  # rows that repeat count each
    for least, top in ((5, 3), (1, 10), (10**6, 10)):
        assert found(spark, rows, least_docs=least, top_terms=top) == brute(rows, least, top)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
    assert found(spark, [("en", "a", None), ("en", "b", "")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    long = [("en", s, f"{s}x " * 300_000) for s in ("p", "q")] * 5
    assert found(spark, long, least_docs=1) == brute(long, 1, 10)
    ties = [("en", s, w) for s, w in (("a", "m n"), ("b", "o"), ("c", "o"))]
    assert found(spark, ties, least_docs=1) == brute(ties, 1, 10)


def test_large_counts_stay_exact(spark):
    rows = spark.sql("SELECT 4000000000000L AS n, 7L AS terms")
    got = rows.select(divergence.share(F.col("n"), F.lit(900_000_000_000_000_000), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (4 * 10**12 + 2) // (900_000_000_000_000_000 + 14)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(queries.op13_divergence(spark, sf), connect(sf), queries.oracle_sql()["op13_divergence"])
