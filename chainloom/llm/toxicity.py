"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, calibrated on labelled rows."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import in_slices

# A general list of insults, phrases in which they are none, and look-alikes.
INSULTS = (
    "idiot", "moron", "scum", "loser", "pathetic", "worthless", "trash", "clown", "disgusting", "stupid",
    "imbecile", "cretin", "vermin", "dumbass", "retard", "bastard", "asshole", "bitch", "fuck", "shit",
)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "shitake")
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
}


#: The log of odds that weighs 1.
_UNIT = 3.0


class _Folds(dict):
    """Letters stay, look-alikes become Latin, marks and invisible characters go, all else is a space."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = LOOKALIKES.get(c, c if kind[0] == "L" else None if kind in ("Mn", "Me", "Cf") else " ")
        return self[code]


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Lower case, without accents, with look-alike letters and digits as Latin letters; words have one space before."""
    plain = unicodedata.normalize("NFKD", text.lower()).translate(_FOLDS)
    return " " + " ".join(plain.split())


@dataclass(frozen=True)
class Lexicon:
    """Weights of stems, matched where a word begins; exceptions, in which no stem counts; and the calibration."""

    weights: Mapping[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-6.0, 1.0, 2.0)
    found: Mapping[str, int] = field(default_factory=dict)


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self._curve, self._automaton = lexicon.curve, ahocorasick.Automaton()
        for stem, weight in lexicon.weights.items():
            self._automaton.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in lexicon.exceptions:
            self._automaton.add_word(" " + phrase, (len(phrase) + 1, 0.0))
        self._automaton.make_automaton()

    def measure(self, text: str) -> tuple[float, int]:
        """(sum of the weights of the hits outside exceptions, words)."""
        folded = fold(text)
        hits = [(end - size + 1, end, weight) for end, (size, weight) in self._automaton.iter(folded)]
        total, reach = 0.0, -1  # of the phrases that begin no later, the farthest end
        for start, order, end, weight in sorted((a, bool(w), b, w) for a, b, w in hits):
            if not order:
                reach = max(reach, end)
            elif end > reach:
                total += weight
        return total, folded.count(" ") if len(folded) > 1 else 0

    def score(self, text: str) -> float:
        return float(_curve(np.array([self.measure(text)]), self._curve)[0])


def _features(measured: np.ndarray) -> np.ndarray:
    total, words = measured[:, 0], np.maximum(measured[:, 1], 1)
    return np.column_stack([np.ones(len(measured)), np.log1p(total), np.log1p(100 * total / words)])


def _curve(measured: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(measured) @ np.array(curve), -30, 30)))


def _fit(measured: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small ridge against endless growth on separable rows."""
    x, b = _features(measured), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (toxic - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def _stems(text: str, shortest: int, longest: int) -> set[str]:
    words = set(fold(text).split())
    return {w[:n] for w in words for n in range(shortest, min(longest, len(w)) + 1)}


def _stems_of(shortest: int, longest: int, wanted: Mapping[str, int] | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_stems(t or "", shortest, longest) for t in batch.column(1).to_pylist()]
            if wanted is None:
                yield pa.record_batch([batch.column(0), pa.array([sorted(f) for f in found], pa.list_(pa.string()))], names=["toxic", "stems"])
            else:
                yield pa.record_batch([batch.column(0), pa.array([sorted(wanted[s] for s in f if s in wanted) for f in found], pa.list_(pa.int32()))], names=["toxic", "stems"])

    return of


def _measured(lexicon: Lexicon):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            both = [matcher.measure(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([float(a) for a, _ in both]), pa.array([int(b) for _, b in both], pa.int64())], names=["toxic", "total", "words"])

    return of


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000, stem_sizes: tuple[int, int] = (4, 8), support: int = 5, least_odds: float = 2.0) -> Lexicon:
    """A lexicon with weights and a calibration from labelled rows: docs(doc_id, text), labels(doc_id, toxic).

    The bounded sample is the sample_rows rows of labels with the smallest hash of doc_id; all else is bounded by it.
    From its toxic documents come the word beginnings that support of them or more have; a weight is the log of how much
    more often toxic documents have a stem than others, and stems whose weight is least_odds or more even after taking
    off two standard errors are taken, so that chance finds in few documents are not. A greedy cover
    takes the stem that adds most toxic documents, until none adds support of them; so words that only copies of one
    document share do not enter beside the stem that explains them. Insults of the fixed list that the sample does not
    contradict are added. No labels: the fixed list with a default calibration.
    """
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.join(F.broadcast(sample), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text").persist()  # sample_rows small rows
    try:
        many = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        n_toxic, n_clean = many.get(1, 0), many.get(0, 0)
        stems = texts.mapInArrow(in_slices(_stems_of(*stem_sizes, None)), "toxic int, stems array<string>")
        counts = stems.select("toxic", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
        weighed = counts.withColumn("weight", F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("fine") + 0.5) / (n_clean + 1)))
        sure = F.col("weight") - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("fine") + 0.5)) >= least_odds
        listed = F.col("stem").isin(list(INSULTS))
        found = weighed.filter(((F.col("bad") >= support) & sure) | listed).select("*", sure.alias("sure")).orderBy("stem").collect()
        weight = {s: float(np.log(0.5 / (n_toxic + 1)) - np.log(0.5 / (n_clean + 1))) for s in INSULTS} | {r["stem"]: r["weight"] for r in found}
        clean_with, sure_ones = {r["stem"]: r["fine"] for r in found}, {r["stem"] for r in found if r["sure"] and r["bad"] >= support}
        wanted = {s: k for k, s in enumerate(sorted(weight))}
        seen = texts.filter("toxic = 1").mapInArrow(in_slices(_stems_of(*stem_sizes, wanted)), "toxic int, stems array<int>")
        toxic_with: dict[int, set[int]] = defaultdict(set)
        for d, r in enumerate(seen.select("stems").toLocalIterator()):
            for s in r["stems"]:
                toxic_with[s].add(d)
        chosen = _cover({s: toxic_with[k] for s, k in wanted.items() if s in sure_ones}, weight, support)
        weights = {s: max(1.0, weight[s] / _UNIT) for s in INSULTS if not any(s.startswith(c) for c in chosen) and not clean_with.get(s)} | {s: weight[s] / _UNIT for s in chosen}
        lexicon = Lexicon(weights, found={s: len(toxic_with[wanted[s]]) for s in weights})
        measured = texts.mapInArrow(in_slices(_measured(lexicon)), "toxic int, total double, words long").toPandas()
    finally:
        texts.unpersist()
    if not n_toxic or not n_clean:
        return lexicon
    curve = _fit(measured[["total", "words"]].to_numpy(float), measured["toxic"].to_numpy(float))
    return Lexicon(weights, curve=curve, found=lexicon.found)


def _cover(docs_with: dict[str, set[int]], weight: Mapping[str, float], support: int) -> list[str]:
    """Stems by the toxic documents they add, each count checked again before it is taken; of equals the longest."""
    import heapq

    heap = [(-len(docs), -len(s), s) for s, docs in docs_with.items()]
    heapq.heapify(heap)
    covered: dict[int, int] = defaultdict(int)
    chosen: list[str] = []
    while heap:
        gain, size, stem = heapq.heappop(heap)
        now = -sum(covered[d] == 0 for d in docs_with[stem])
        if -now < support:
            continue
        if now > gain:
            heapq.heappush(heap, (now, size, stem))
            continue
        chosen.append(stem)
        for d in docs_with[stem]:
            covered[d] += 1
    return [s for s in chosen if not any(s != c and s.startswith(c) for c in chosen)]


def _scored(lexicon: Lexicon):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            measured = np.array([matcher.measure(t or "") for t in batch.column(1).to_pylist()], float).reshape(-1, 2)
            yield pa.record_batch([batch.column(0), pa.array(_curve(measured, lexicon.curve)), pa.array(measured[:, 0])], names=["row", "score", "weight"])

    return of


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), score from 0 to 1, weight (of the hits).

    Whole texts are matched in one pass each. Null and empty texts score as no hits do. Labels, lang, source and
    doc_id are no inputs. No shuffle; rows that repeat score alike. No documents: no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")
    return rows.mapInArrow(in_slices(_scored(lexicon)), f"row {rows.schema['row'].dataType.simpleString()}, score double, weight double")
