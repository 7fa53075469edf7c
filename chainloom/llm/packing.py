"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chainloom.llm.common import in_slices, materialize

#: (length, how many) of the pieces of a sequence, in order, and how many sequences look so.
Pattern = tuple[tuple[tuple[int, int], ...], int]

_MEMO_WORDS, _MEMO_CHARS = 300_000, 64
_CAPITALS = frozenset(chr(c) for c in range(0x41, 0xDF) if chr(c).isupper())
#: Pieces of one length are numbered in buckets of about so many; the buckets' counts are one row each.
BUCKET_ROWS = 1_000
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """A tokenizer that lower-cases and drops white space, asked once per distinct word.

    Words are told apart at spaces and line ends, without a full stop or comma behind a letter and with their first
    letter lower-cased, neither of which changes the ids. Two generations of the memo keep the words in use; the older
    one is dropped when the younger is full.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer, self._memo, self._older = Tokenizer.from_file(path), {}, {}
        self._stops = {c: self._ask([c])[0] for c in ".,"}

    def _ask(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            if word:
                if word[0] in _CAPITALS:
                    word = word[0].lower() + word[1:]
                if word[-1] in ".," and word[-2:-1].isalpha():
                    parts += (word[:-1], word[-1])
                else:
                    parts.append(word)
        memo, older = self._memo, self._older
        new = []
        for word in set(parts):
            if word not in memo and word not in self._stops:
                if word in older:
                    memo[word] = older[word]
                else:
                    new.append(word)
        asked = dict(zip(new, self._ask(new), strict=True)) if new else {}
        memo.update(asked)
        memo.update(self._stops)
        out = b"".join([memo[part] for part in parts])
        for word in new:
            if len(word) > _MEMO_CHARS:
                del memo[word]
        if len(memo) > _MEMO_WORDS:
            self._memo, self._older = {}, memo
        return out


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            at, piece, start, length, crc, data = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = tokenizer.ids(text or "") + end
                for p, s in enumerate(range(0, len(ids), step)):
                    cut = ids[s : s + step]
                    at.append(k)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        data.append(cut)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.record_batch(columns + [pa.array(data, pa.binary())] * with_ids, names=["row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return of


def reduce_by_dominance(counts: Mapping[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(sequences that some optimal packing has, what is left of the counts).

    For the largest pieces first, a set with the piece is fixed if it dominates every other set with it, that is, if
    the rest of any such set can be laid into places of the fixed one: the piece alone if nothing fits beside it; with
    a piece that fills the sequence exactly; with the largest that fits if no two others fit; with the largest that
    fits and the largest beside both if no three others fit and the latter is as large as the smaller of any two.
    """
    left, fixed, changed = {x: c for x, c in counts.items() if c}, [], True

    while changed:
        changed = False
        for size in sorted(left, reverse=True):
            while left.get(size):
                chosen = _dominant(size, left, capacity)
                if chosen is None:
                    break
                need = Counter(chosen)
                times = min(left[x] // n for x, n in need.items())
                if not times:
                    break
                for x, n in need.items():
                    left[x] -= n * times
                    if not left[x]:
                        del left[x]
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
    return fixed, left


def _dominant(size: int, left: Mapping[int, int], capacity: int) -> tuple[int, ...] | None:
    others = dict(left)
    others[size] -= 1
    order = sorted(x for x, c in others.items() if c)
    room = capacity - size

    def most(least_room: float, taken: int = 0) -> int:
        """The largest other piece that fits, when one of size taken is used."""
        k = bisect_left(order, int(least_room) + 1) - 1
        while k >= 0 and others[order[k]] - (order[k] == taken) <= 0:
            k -= 1
        return order[k] if k >= 0 else 0

    best = most(room)
    if not best:
        return (size,)
    if best == room:
        return (size, best)
    smallest = [x for x in order[:3] for _ in range(min(3, others[x]))][:3]
    if len(smallest) < 2 or sum(smallest[:2]) > room:
        return (size, best)
    if len(smallest) < 3 or sum(smallest) > room:
        third = most(room - best, best)
        if third and third >= most(room / 2):
            return (size, best, third)
    return None


def best_fit(counts: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts of lengths: equal pieces and equal sequences move together, so the work grows
    with the number of lengths and not of pieces."""
    open_: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if times:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append([pattern, times])

    for size in sorted(counts, reverse=True):
        c = counts[size]
        while c:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                room, pattern, times = capacity, (), -(-c // (capacity // size))
            else:
                room = rooms[k]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            each = room // size
            full = min(times, c // each)
            put(room - each * size, (*pattern, (size, each)), full)
            c -= full * each
            times -= full
            if times and c:  # then fewer than would fill one are left
                put(room - c * size, (*pattern, (size, c)), 1)
                c, times = 0, times - 1
            put(room, pattern, times)
    return [(pattern, times) for groups in open_.values() for pattern, times in groups]


def plan(counts: Mapping[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, how many in each sequence, first offset) by rank."""
    found, ranks, sequence = defaultdict(list), Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            found[size].append((ranks[size], sequence, each, offset))
            ranks[size] += each * times
            offset += size * each
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in found.items()}


def _placed(slots: dict[int, np.ndarray]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                table = slots[int(size)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                nth, inside = np.divmod(rank[mine] - row[:, 0], row[:, 2])
                sequence[mine], offset[mine] = row[:, 1] + nth, row[:, 3] + inside * size
            kept = [n for n in names if n != "rank"]
            yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return of


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns to keep, piece, start, length, ids_crc32, (ids), sequence_id, offset.

    A document is its text's ids, then end_id; null text as empty. Only documents longer than capacity are cut, into
    pieces of capacity, the last one shorter; with a text of any length. Sequences hold at most capacity ids, gapless
    from offset 0. tokenizer: path of a tokenizers file whose pre-tokenizer drops white space.

    The plan is made on the driver over the histogram of lengths, which has capacity rows at most whatever the input;
    pieces are numbered within their length in salted buckets and find their place by number. Rows that repeat are
    packed each. No documents: no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    made = f"row {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = materialize(rows.mapInArrow(in_slices(_pieces(tokenizer, capacity, end_id, with_ids)), made))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(plan(counts, capacity))

    cells = ["length", "bucket"]
    parts = pieces.sparkSession.createDataFrame([(size, -(-c // BUCKET_ROWS)) for size, c in counts.items()], "length long, parts int")
    name = F.xxhash64(F.col("row").cast("string"), "piece", "ids_crc32")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(name, F.col("parts")).cast("int")).drop("parts")
    before = salted.groupBy(*cells).count()
    before = before.select(*cells, (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    order = Window.partitionBy(*cells).orderBy("piece", "start", "ids_crc32", *(F.col(f"row.{c}") for c in keep))
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, cells)
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before")
    out = T.StructType([f for f in ranked.schema if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.mapInArrow(_placed(slots), out)
    return placed.select("row.*", *(c for c in placed.columns if c != "row"))
