"""Line dedup, shingle joins, chunks and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import chunk_dedup, embedding_dedup, line_dedup, ngram_join, queries, vptree
from chainloom.llm.components import components


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got for p in links for n in p if p[0] != p[1])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(docs, least=20, many=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(d)
    drop = {k: max(h) for k, h in holders.items() if len(k) >= least and len(h) >= many}
    return {d: "\n".join(x for x in (t or "").split("\n") if drop.get(key(x), d) == d) for d, t in docs}


LINE = "A line that many documents hold"


def test_lines(spark):
    docs = [(1, f"{LINE}\nown one"), (2, f"  {LINE.upper()}\t\nshort\nshort"), (3, f"x\n{LINE}\n{LINE}"), (4, "short"), (5, None), (6, ""), (7, "é" * 20), (8, "É" * 20), (9, "é" * 20), (10, "é" * 20), (11, "é" * 19), (12, "z" * 200_000)]
    df = spark.createDataFrame([(d, t, d, "v") for d, t in docs], "doc_id long, text string, n_lines int, kept_text string")
    got = line_dedup.dedup_lines(df)
    assert {r["row"]["doc_id"]: r["kept_text"] for r in got.collect()} == brute_lines(docs)
    assert {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in got.collect()}[3] == (3, 0)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_odd_ids(spark):
    df = spark.createDataFrame([(None, LINE), (3, LINE), (3, LINE), (1, LINE)], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"] or 0, r["kept_text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, ""), (1, ""), (3, LINE), (3, LINE)]


def test_rows_of_one_id_count_once(spark):
    df = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE), (4, f"{LINE}s"), (5, f"{LINE}s"), (5, f"{LINE}s"), (6, f"{LINE}s")], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"], r["kept_text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, LINE), (1, LINE), (2, LINE), (4, ""), (5, ""), (5, ""), (6, f"{LINE}s")]


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def brute_groups(docs, n=5):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, union(links, ids)


@pytest.mark.parametrize("seed", [0, 1])
def test_ngrams(spark, seed):
    rng = random.Random(seed)
    passage, docs = words(rng, 40), []
    for base in range(12):
        text = words(rng, rng.choice([3, 8, 30, 120]))
        if base % 2:
            text = text + passage
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            docs.append((len(docs) * 3, " ".join(copy)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE "), (905, "wörd " * 30_000)]
    rng.shuffle(docs)
    got = ngram_join.ngram_groups(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("class", F.lit("c"))).collect()
    sizes, groups = brute_groups(docs)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == groups


def test_ngrams_of_odd_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (2, text.upper()), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(df).collect())
    assert [g[:2] for g in got] == [(-1, 4), (2, 4), (5, 4), (5, 4), (7, 0)]
    assert [g[2] for g in got] == [None, 2, 2, 2, 7]
    assert ngram_join.ngram_groups(df.limit(0)).count() == 0


def test_ngrams_of_an_id_with_two_texts(spark):
    base = [f"w{k}" for k in range(40)]
    near, other = base[:39] + ["x"], [f"v{k}" for k in range(40)]
    rows = [(4, " ".join(other)), (4, " ".join(base)), (9, " ".join(near)), (11, " ".join(other[1:]))]
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(4, 36, 4), (4, 36, 4), (9, 36, 4), (11, 35, 4)]


def test_chunks():
    """Chunks are the runs with one anchor: the least of the hashes h = 256 h + word in a run, of eight words each."""
    rng = random.Random(0)
    for size in (0, 7, 49, 50, 51, 400):
        hashes = np.array([rng.choice([5, 7 << 40, rng.getrandbits(64)]) for _ in range(size)], np.uint64)
        rolled = [sum(int(hashes[k - j]) << (8 * j) for j in range(8)) % 2**64 for k in range(7, size)]
        anchors = [min(rolled[k : k + 43]) for k in range(size - 49)]
        got = [(int(a) % 2**64, k) for a, first, last in zip(*chunk_dedup.chunks_of(hashes, 50), strict=True) for k in range(first, last + 1)]
        assert got == [(a, k) for k, a in enumerate(anchors)]


def test_repeated_passages(spark):
    rng = random.Random(3)
    passage = " ".join(words(rng, 60))
    docs = [(k, " ".join(words(rng, 80))) for k in range(8)]
    docs[2] = (2, docs[2][1] + " " + passage)
    docs[5] = (5, "new start " + passage.replace(" ", "  \n", 5) + " " + docs[5][1])
    docs += [(20, None), (21, ""), (22, passage[:40]), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit(0)).withColumn("row", F.lit(1))
    spans = chunk_dedup.repeated_spans(df)
    got = {r["doc_id"]: r for r in spans.collect()}
    assert set(got) == {2, 5} and got[2]["keeps"] and not got[5]["keeps"] and got[5]["first_doc_id"] == 2
    assert docs[2][1].encode()[got[2]["start"] : got[2]["end"]].decode() in passage + " "
    kept = {r["row"]["doc_id"]: r["kept_text"] for r in chunk_dedup.drop_repeats(df, spans).collect()}
    assert kept[2] == docs[2][1] and len(kept[5].split()) < 110 and kept[5].startswith("new start")
    assert chunk_dedup.repeated_spans(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, passage), (1, passage)], "doc_id long, text string")
    assert chunk_dedup.repeated_spans(twice).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("n", F.lit(1)).withColumn("cell", F.lit("x"))


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(25, 16))
    x = np.concatenate([base, base[:9] + 0.03 * rng.normal(size=(9, 16)), base[:3] + 0.05 * rng.normal(size=(3, 16)), base[:2], 2 * base[:1]]).astype(np.float32).astype(float)
    labels = rng.integers(0, 3, 25)
    labels = np.concatenate([labels, labels[:9], labels[:3], labels[:2], labels[:1]])
    ids = rng.permutation(len(x)) * 2
    rows = [(int(i), int(y), v.tolist()) for i, y, v in zip(ids, labels, x, strict=True)]
    odd = [(901, 0, None), (903, 0, []), (905, 0, [0.0] * 16), (907, 0, [float("nan")] * 16), (909, None, x[0].tolist()), (911, 0, [None] * 16), (913, 0, [1.0, 2.0]), (None, 0, x[0].tolist())]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    groups = union([(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked), strict=True)], [int(i) for i in ids])
    got = embedding_dedup.near_duplicates(vectors(spark, rows + odd), cell_rows=4, block_rows=3).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {int(i): (int(n), groups[int(i)], groups[int(i)] == i) for i, n in zip(ids, linked.sum(axis=1), strict=True)} | {i: (0, i, True) for i, _, _ in odd}
    assert embedding_dedup.near_duplicates(vectors(spark, odd[:1])).count() == 1
    assert embedding_dedup.near_duplicates(vectors(spark, []).limit(0)).count() == 0
    copies = embedding_dedup.near_duplicates(vectors(spark, [(3, 1, [1.0, 2.0])] * 3 + [(2, 1, [2.0, 4.0])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in copies) == [(2, 3, 2)] + [(3, 3, 2)] * 3


def test_vectors_under_one_id(spark):
    """Each row has the links of its own vector, also where an id comes with several."""
    rows = [(5, 1, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (6, 1, [1.0, 0.01]), (7, 1, [0.01, 1.0])]
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]


def test_near_vector_query(spark, tmp_path):
    """The query over a table with planted copies, against all pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    x = np.concatenate([base, base[:150] + 0.1 * rng.normal(size=(150, 64)), base[:40]]).astype(np.float32)
    labels = np.concatenate([rng.integers(0, 4, 400)] * 2)[: len(x)]
    labels[400:550], labels[550:] = labels[:150], labels[:40]
    spark.createDataFrame([(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    groups = union([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)], range(len(x)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op1_embedding_dedup(spark, str(tmp_path)).collect()}
    assert linked.sum() > 300 and got == {k: (int(linked[k].sum()), groups[k], groups[k] == k) for k in range(len(x))}


def test_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x[50:90] = x[7]
    ids = rng.permutation(400)
    tree = vptree.Tree(ids, x, leaf=16)
    d, found, compared = tree.search(ids[:40], x[:40], 10)
    for q in range(40):
        every = np.sqrt(((x[q] - x) ** 2).sum(axis=1))
        every[q] = np.inf
        order = np.lexsort((ids, every))[:10]
        assert list(found[q]) == list(ids[order]) and list(d[q]) == list(every[order])
    assert compared < 40 * 400
    loose = vptree.Tree(ids, x, leaf=16).search(ids[:40], x[:40], 10, factor=1.5)
    assert loose[2] <= compared and np.mean([len(set(a) & set(b)) for a, b in zip(found, loose[1], strict=True)]) >= 9


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    x[100:140] = x[5]
    rows = [(k, 0, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, 0, None), (1100, 0, [0.0] * 8), (1200, 0, [1.0, 1.0]), (None, 0, x[0].tolist()), (1300, 0, [float("inf")] * 8)]
    got = {}
    for r in vptree.nearest(vectors(spark, rows + odd + rows[:1]), F.col("vec_id") % 100 == 0, shard_rows=90, query_rows=2, leaf=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        every = np.sqrt(((x[q] - x) ** 2).sum(axis=1))
        every[q] = np.inf
        order = np.lexsort((np.arange(300), every))[:10]
        assert [found[k + 1] for k in range(10)] == [(int(o), float(every[o])) for o in order]
    relaxed = vptree.nearest(vectors(spark, rows), F.col("vec_id") % 3 == 0, factor=1.3, shard_rows=40, query_rows=20, leaf=8).collect()
    hits = sum(r["vec_id"] in np.lexsort((np.arange(300), np.where(np.arange(300) == r["query_id"], np.inf, np.sqrt(((x[r["query_id"]] - x) ** 2).sum(axis=1)))))[:10] for r in relaxed)
    assert len(relaxed) == 1000 and hits >= 900
    few = vptree.nearest(vectors(spark, rows[:4]), F.col("vec_id") == 0)
    assert few.count() == 3
    assert vptree.nearest(vectors(spark, []).limit(0), F.col("vec_id") == 0).count() == 0


def brute_passages(docs, least=50):
    """By document: which words runs of least words cover that another document holds, and which of them a smaller one holds."""
    held, covered = {}, {}
    runs = {d: [tuple(t.split()[k : k + least]) for k in range(len(t.split()) - least + 1)] for d, t in docs}
    for d, rs in runs.items():
        for r in rs:
            held.setdefault(r, set()).add(d)
    for d, rs in runs.items():
        for k, r in enumerate(rs):
            if len(held[r]) > 1:
                covered.setdefault((d, min(held[r]) == d), set()).update(range(k, k + least))
    return covered


def test_passages_of_repeated_and_missing_ids(spark):
    """Texts under one doc_id, or under none, have their own passages and do not repeat each other."""
    rng = random.Random(5)
    passage, other = " ".join(words(rng, 60)), " ".join(words(rng, 55))
    rows = [(1, passage), (4, f"{passage} end"), (4, " ".join(words(rng, 200))), (4, f"x {other}"), (4, f"y {other}"), (None, f"{other} z"), (None, f"q {other}"), (None, "n " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = chunk_dedup.repeated_spans(df)
    got = sorted((r["doc_id"] or 0, r["words"], r["first_doc_id"] or 0, r["keeps"]) for r in spans.collect())
    assert got == [(0, 55, 0, True)] * 2 + [(1, 60, 1, True)] + [(4, 55, 0, False)] * 2 + [(4, 60, 1, False)]
    kept = sorted((r["row"]["doc_id"] or 0, r["kept_text"].strip()) for r in chunk_dedup.drop_repeats(df, spans).collect())
    assert kept == sorted((d or 0, {rows[1][1]: "end", rows[3][1]: "x", rows[4][1]: "y"}.get(t, t).strip()) for d, t in rows)


def test_every_passage_of_50_words_is_found(spark):
    rng, docs = random.Random(11), []
    for k in range(150):
        passage = " ".join(words(rng, rng.choice([49, 50, 51, 51, 55, 60])))
        if k % 10 == 0:
            passage = " ".join(rng.choice("ab") for _ in range(51))  # 101 bytes
        docs += [(2 * k + j, f"{' '.join(words(rng, rng.randrange(40)))} {passage} {' '.join(words(rng, rng.randrange(40)))}") for j in (0, 1)]
    docs += [(900, "again " * 70), (901, "other " + "again " * 60), (902, docs[7][1] + " " + docs[9][1]), (903, docs[9][1] + " x " + docs[0][1])]
    got = {}
    for r in chunk_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        data = dict(docs)[r["doc_id"]].encode()
        from_word = len(data[: r["start"]].split())
        assert r["words"] == len(data[r["start"] : r["end"]].split()) and r["keeps"] == (r["first_doc_id"] == r["doc_id"])
        got.setdefault((r["doc_id"], r["keeps"]), set()).update(range(from_word, from_word + r["words"]))
    assert got == brute_passages(docs)
