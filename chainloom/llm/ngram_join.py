"""N-gram Jaccard join by a token-group matrix: near-duplicate documents and their groups, exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import BLANKS, NO_ID, Batches, id_or_none, in_slices, materialize, real_id, release
from chainloom.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the min-hashes, and how many of these a class must share with a leader to be compared with it:
#: of 12 at a similarity of 0.75 nine are expected, and six or more for 98 of 100 pairs.
_SEEDS = _MIX * np.arange(3, 27, 2, dtype=np.uint64)
_SHARED = 6
#: Tokens of this rank, about 2,000 occurrences, and above are dealt by token and class, so that no task gets all of one.
_HOT_RANK = 33
#: Bytes of sets that meet in one task, about.
_TASK_BYTES = 8_000_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of a text, A-Z lower-cased, words split at blanks; of fewer
    words the whole sequence as one; of none, nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    mixed = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        mixed = (mixed ^ hashes[k : k + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _counts(n: int, width: int, block: int):
    """How often shingles occur by cell of their hash; one set of compressed blocks per task."""

    def of(batches: Batches) -> Batches:
        counts, waiting, held = np.zeros(width, np.uint32), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting.append((shingles(text, n) & np.uint64(width - 1)).astype(np.uint32))
                held += len(waiting[-1])
                if held > 200_000:
                    np.add.at(counts, np.concatenate(waiting), np.uint32(1))
                    waiting, held = [], 0
        if waiting:
            np.add.at(counts, np.concatenate(waiting), np.uint32(1))
        data = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(-1, block)]
        yield pa.record_batch([pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])

    return of


def _ranked(block: int):
    """The blocks of a partition summed as they come, then ranked."""

    def of(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(block, np.uint64))
                sums[k] += np.frombuffer(zlib.decompress(data), np.uint32)
        ranks = [np.round(3 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["block", "ranks"])

    return of


def frequency_ranks(docs: DataFrame, n: int, width: int = 1 << 23, block: int = 1 << 16) -> bytes:
    """For each of width cells (a power of two) a third of the log2 of how often shingles of the cell occur, as one byte,
    compressed: an order from rare to frequent over all documents. Its size is fixed, so it can go to every task; any
    order gives whole results, this one keeps what many documents share out of the prefixes."""
    counted = docs.select("text").mapInArrow(in_slices(_counts(n, width, block)), "block int, counts binary")
    ranked = counted.repartition("block").mapInArrow(_ranked(block), "block int, ranks binary")
    table = np.zeros((width // block, block), np.uint8)
    for r in ranked.collect():  # width bytes in all
        table[r["block"]] = np.frombuffer(r["ranks"], np.uint8)
    return zlib.compress(table.tobytes(), 1)


def _prefixes(n: int, percent: int, ranks: bytes):
    """For each row: id, digest, class of equal sets, size, and on its first sight in the task the prefix and minima. A prefix
    token is its rank (under 128) and 55 bits of its hash, so that the order of tokens is the order of prefixes."""
    table = np.frombuffer(zlib.decompress(ranks), np.uint8)

    def of(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            classes, sizes, prefixes, minima, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, n)
                name = _class(s.tobytes())
                classes.append(name if len(s) else None)
                sizes.append(len(s))
                if not len(s) or name in seen:
                    for column in (prefixes, minima, bits):
                        column.append(None)
                    continue
                seen.add(name)
                keep = len(s) - -(-percent * len(s) // 100) + 1
                rank = table[s & np.uint64(len(table) - 1)].astype(np.uint64)
                prefixes.append(np.sort((rank << np.uint64(55)) | (s >> np.uint64(9)))[:keep].view(np.int64))
                bits.append(_parities(s))
                minima.append([int((s * seed ^ (s >> np.uint64(31)) * _MIX).min()) - 2**63 for seed in _SEEDS])
            if len(seen) > 1_000_000:
                seen.clear()  # only spares repeats within a task
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, longs), pa.array(minima, longs), pa.array(bits, pa.binary())], names=["id", "digest", "class", "n", "prefix", "minima", "bits"])

    return of


def _parities(s: np.ndarray) -> bytes:
    """For each of at least 2 n cells, a power of two, whether an odd number of tokens falls there, as bits. Where the
    bits of two sets differ, so do the sets; so the sets differ in as many tokens at least."""
    width = max(128, 1 << (2 * len(s) - 1).bit_length())
    cells = ((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=width) & 1, bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The same for a number of cells that is smaller by a power of two, size bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _sets(n: int, bits: bytes):
    """(id, class, set) of the rows that may be wanted: those whose bit is set, each class once in a task and id."""
    table = np.frombuffer(zlib.decompress(bits), np.uint8)

    def of(batches: Batches) -> Batches:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = _bit(ids, 8 * len(table))
            mine = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            found: list[tuple[int, int, bytes]] = []
            for k, text in zip(ids[mine].tolist(), batch.column(1).take(pa.array(mine)).to_pylist(), strict=True):
                data = shingles(text, n).tobytes()
                name = _class(data)
                if data and (k, name) not in seen:
                    seen.add((k, name))
                    found.append((k, name, data))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=["id", "class", "set"])

    return of


def _class(data: bytes) -> int:
    """The name of a set, given as bytes: equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(data) >> 1


def _bit(ids: np.ndarray, width: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * _MIX) >> np.uint64(20)).astype(np.int64) % width


def _wanted_bits(ids: DataFrame, width: int = 1 << 26) -> bytes:
    """A bit table of fixed size with the bit of each id set; a filter before an exact one."""

    def of(batches: Batches) -> Batches:
        table = np.zeros(width // 8, np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(), width)
            np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = table.reshape(256, -1)
        used = [k for k in range(256) if parts[k].any()]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in used], pa.binary())], names=["part", "bits"])

    table = np.zeros((256, width // 8 // 256), np.uint8)
    for r in ids.mapInArrow(of, "part int, bits binary").repartition("part").mapInArrow(_merged, "part int, bits binary").collect():
        table[r["part"]] |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return zlib.compress(table.tobytes(), 1)


def _merged(batches: Batches) -> Batches:
    """The bit tables of each part as one."""
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = np.frombuffer(zlib.decompress(data), np.uint8)
            whole[k] = bits | whole[k] if k in whole else bits
    yield pa.record_batch([pa.array(list(whole), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in whole.values()], pa.binary())], names=["part", "bits"])


class _Group:
    """The sets of a group's members as rows of a matrix over the union of their tokens: for each token who has it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.union, starts = np.unique(tokens[order], return_index=True)
        self._owners, self._starts = owners[order], np.append(starts, len(tokens))

    def qualifying(self, mine: np.ndarray, percent: int) -> np.ndarray:
        """Members whose similarity with a set is percent or more; the group is opened only if its union allows any."""
        if 100 * len(self.union) < percent * len(mine):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.union, mine)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == mine]
        if 100 * len(at) < percent * len(mine):
            return np.empty(0, np.int64)
        count = self._starts[at + 1] - self._starts[at]
        shift = np.repeat(self._starts[at] - np.cumsum(count) + count, count)
        common = np.bincount(self._owners[np.arange(len(shift)) + shift], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (len(mine) + self.sizes - common))


def _verify(percent: int):
    """Within a bucket of groups: bound each class that asks by the group's token union and find the members that it is
    linked with; the links returned span what the links found connect."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, tree = [], [], {}

        def root(x: int) -> int:
            while tree.setdefault(x, x) != x:
                tree[x] = tree[tree[x]]
                x = tree[x]
            return x

        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        names, homes = rows["class"].tolist(), rows["home"].to_numpy()
        for _, held, asking in _meetings(rows):
            group = _Group([sets[k] for k in held])
            for k in asking:
                for m in group.qualifying(sets[k], percent).tolist():
                    left, right = root(names[k]), root(names[held[m]])
                    if homes[k] != homes[held[m]] and left != right:
                        a.append(names[k])
                        b.append(names[held[m]])
                        tree[left] = right
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return of


def _meetings(rows: pd.DataFrame) -> Iterator[tuple[int, list[int], list[int]]]:
    """(group, rows of members, rows that ask) of a bucket."""
    found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for k, roles in enumerate(rows["roles"]):
        for group, part, asks in np.asarray(roles).reshape(-1, 3).tolist():
            found.setdefault((group, part), ([], []))[asks].append(k)
    for (group, _), (held, asking) in found.items():
        if held and asking:
            yield group, held, asking


def _sieve(percent: int):
    """Within a bucket of groups: the classes that ask and the members whose parities allow a link with one another."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        classes, homes, sizes = (rows[c].to_numpy() for c in ("class", "home", "n"))
        stay: set[tuple[int, int, bool]] = set()
        for group, held, asking in _meetings(rows):
            width = min(len(rows["bits"].iloc[k]) for k in (*held, *asking))
            members = np.stack([_folded(rows["bits"].iloc[k], width) for k in held])
            for k in asking:
                both = sizes[k] + sizes[held]
                most = both - 2 * -(-percent * both // (100 + percent))  # tokens in which linked sets can differ
                fits = np.bitwise_count(members ^ _folded(rows["bits"].iloc[k], width)).sum(axis=1) <= most
                fits = np.flatnonzero(fits & (homes[held] != homes[k]))
                if len(fits):
                    stay.add((k, group, True))
                    stay.update((held[m], group, False) for m in fits.tolist())
        rows_of = np.array([k for k, _, _ in stay], np.int64)
        return pd.DataFrame({"class": classes[rows_of], "home": homes[rows_of], "n": sizes[rows_of], "group": np.array([g for _, g, _ in stay], np.int64), "asks": np.array([a for _, _, a in stay], bool)})

    return of


def _dealt(asked: DataFrame, held: DataFrame, payload: DataFrame) -> DataFrame:
    """(bucket, class, home, roles, payload) for asked(class, home, n, group) and held(class, home, group): groups that
    are asked much are split into parts by the bytes that ask; every part has all members. Parts are dealt to buckets, and
    a payload goes once to each bucket that needs it. The caller has bounded the members of a group."""
    loads = asked.groupBy("group").agg(F.sum(8 * F.col("n")).alias("bytes"))
    loads = materialize(loads.select("group", "bytes", F.ceil(F.col("bytes") / _TASK_BYTES).cast("long").alias("parts")))
    total = loads.agg(F.sum("bytes")).first()[0] or 0
    least = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, int(total // _TASK_BYTES))
    asks = asked.join(loads, "group").select("class", "home", "group", F.pmod(F.xxhash64("class"), "parts").alias("part"), F.lit(1).cast("long").alias("asks"))
    holds = held.join(loads, "group").select("class", "home", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).cast("long").alias("asks"))
    roles = asks.unionByName(holds).withColumn("bucket", F.pmod(F.xxhash64("group", "part"), F.lit(buckets)))
    roles = roles.groupBy("class", "home", "bucket").agg(F.flatten(F.collect_list(F.array("group", "part", "asks"))).alias("roles"))
    return roles.join(payload.dropDuplicates(["class"]), "class").select("bucket", "class", "home", "roles", *(c for c in payload.columns if c != "class"))


def _links(asked: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different homes: those that ask a group against its members, verified on their sets."""
    return materialize(_dealt(asked, held, sets).groupBy("bucket").applyInPandas(_verify(percent), "a long, b long"))


def text_digest(text: str = "text") -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 75, group_size: int = 128) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links; and of its text
    the digest (see text_digest) and group, the same number for all that links connect (null without words).

    Two documents link when the Jaccard similarity of their sets of distinct n-word shingles is percent / 100 or more.
    Documents without words link with nothing; equal sets are one class and are compared once. Shingles are 64-bit
    hashes. A null doc_id keeps its row, counts as no node, and has a null component. Rows that repeat a doc_id with
    different texts are nodes of their own under one id. No documents: no rows.

    No link between different sets is lost, and groups of copies are not expanded into pairs:
    1. Each set's prefix, its rarest tokens, as many as a link must share one of, by a frequency sketch of fixed size.
    2. First links: classes that share min-hashes with the class of their bucket that has the most common ones,
       verified; the components of these links are the homes.
    3. The token-group matrix: tokens in prefixes of at least two homes, against groups of group_size similar classes
       (of one home, or of homes of one class with like size and a frequent token in common). Groups meet on tokens,
       never classes: a group asks those of larger homes (ties: larger names) that can reach the threshold by their
       sizes, the number of common tokens and the place of these. Parities of token cells then show which classes
       differ too much, before any set moves. A class that still asks is bounded by the group's union of all tokens,
       and only groups that qualify are opened.
    """
    rows = docs.select(id_or_none().alias("id"), "text")
    prefixes = in_slices(_prefixes(n, percent, frequency_ranks(rows, n)))
    made = materialize(rows.withColumn("digest", text_digest()).mapInArrow(prefixes, "id long, digest long, class long, n long, prefix array<long>, minima array<long>, bits binary"))
    named = materialize(made.select("id", "digest", "class", "n"))
    classes = named.filter(F.col("class").isNotNull() & (F.col("id") != NO_ID)).groupBy("class").agg(F.min("n").alias("n"), F.min("id").alias("doc"))
    classes = materialize(classes)
    shown = made.filter("prefix is not null")

    first = materialize(_leaders(shown.select("class", "minima")).join(classes.select("class", "n"), "class"))
    sets = _needed_sets(first.select("class").union(first.select("leader")), classes, rows, n)
    asked = first.select("class", F.col("class").alias("home"), "n", F.col("leader").alias("group"))
    held = first.select(F.col("leader").alias("class"), F.col("leader").alias("home"), F.col("leader").alias("group")).distinct()
    links = _links(asked, held, sets, percent)
    homes = materialize(components(links).select(F.col("node").alias("class"), F.col("component").alias("home")))
    release(first)

    asked, held = _matrix(shown, homes, percent, group_size)
    release(made)
    more = materialize(asked.select("class").union(held.select("class")).distinct().join(sets.select("class"), "class", "left_anti"))
    others = _needed_sets(more, classes, rows, n)
    later = _links(asked, held, sets.unionByName(others), percent)
    for done in (sets, others, more, homes):
        release(done)

    final = components(links.unionByName(later)).select(F.col("node").alias("class"), F.col("component").alias("home"))
    placed = classes.join(final, "class", "left").select("class", "doc", F.coalesce("home", "class").alias("home"))
    smallest = placed.groupBy("home").agg(F.min("doc").alias("component_id"))
    found = placed.join(smallest, "home").select("class", "component_id", "home")
    out = named.join(found, "class", "left")
    component = F.when(F.col("id") != NO_ID, F.coalesce("component_id", "id"))
    return out.select(real_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), "digest", F.coalesce("home", "class").alias("group"))


def _leaders(shown: DataFrame) -> DataFrame:
    """(class, leader): in each bucket of classes with a common min-hash the leader is the class whose min-hashes are
    most common, most likely the one that the others are copies of; classes that share _SHARED with it are its pairs."""
    bands = shown.select("class", F.posexplode("minima").alias("band", "least"))
    crowds = materialize(bands.groupBy("band", "least").agg(F.count("*").alias("many")).filter("many > 1"))
    shared = materialize(bands.join(crowds, ["band", "least"]).select("class", "band", "least", "many"))
    score = shared.groupBy("class").agg(F.sum("many").alias("score"))
    leaders = shared.join(score, "class").groupBy("band", "least").agg(F.max_by("class", F.struct("score", "class")).alias("leader"))
    pairs = shared.join(leaders, ["band", "least"]).filter("class <> leader").groupBy("class", "leader").count().filter(F.col("count") >= _SHARED)
    return pairs.select("class", "leader")


def _needed_sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(class, set) of the classes wanted, from one document of each, and of others by chance; texts are hashed again only
    where the bit table has their id. A class has more than one row where its document's id repeats."""
    picked = materialize(classes.join(wanted.toDF("class").distinct(), "class", "left_semi").select(F.col("doc").alias("id")))
    found = materialize(rows.mapInArrow(in_slices(_sets(n, _wanted_bits(picked))), "id long, class long, set binary").select("class", "set"))
    release(picked)
    return found


def _matrix(shown: DataFrame, homes: DataFrame, percent: int, group_size: int) -> tuple[DataFrame, DataFrame]:
    """(asked, held) for _links: the pairs of groups that can hold a link, by the classes that ask and the members."""
    shared = _of_several(shown.select("class", F.posexplode("prefix").alias("at", "token")))
    shared = materialize(shared.join(homes, "class", "left").withColumn("home", F.coalesce("home", "class")))
    spans = shared.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count("*").alias("holders")).filter("low < high")
    live = materialize(shared.join(spans.select("token", "holders"), "token"))
    release(shared)

    keys = live.groupBy("class", "home").agg(F.max_by("token", F.struct("holders", "token")).alias("token"))
    keys = keys.join(shown.select("class", "n", F.element_at("prefix", -1).alias("end")), "class")
    keys = keys.groupBy("class", "home", "token").agg(F.min("n").alias("n"), F.min("end").alias("end"))  # each class once
    keys = materialize(keys.join(keys.groupBy("home").agg(F.count("*").alias("many")), "home"))
    alone = F.xxhash64("token", F.floor(F.log2("n") * 4), F.shiftright("end", 55), F.lit(1))
    keyed = keys.withColumn("key", F.when(F.col("many") > 1, F.xxhash64("home", F.lit(0))).otherwise(alone))
    parts = keyed.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / group_size, F.sum(8 * F.col("n")) / _TASK_BYTES)).alias("parts"))
    grouped = keyed.join(parts, "key").withColumn("group", F.xxhash64("key", F.pmod(F.xxhash64("class"), "parts")))
    grouped = materialize(grouped.select("class", "home", "n", "end", "many", "group"))
    release(keys)
    groups = grouped.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("end").alias("first_end"), F.max("many").alias("many"), F.max("home").alias("home"), F.count("*").alias("members"))

    # a class of n tokens that has a token at place at, and common tokens up to there, has at most n - at - 1 more
    slack = 100 * F.col("n") - (100 + percent) * F.col("at")
    matrix = live.join(grouped.select("class", "n", "group"), "class").groupBy("token", "group").agg(F.max(slack).alias("slack"))
    matrix = materialize(matrix.join(groups, "group"))
    release(live)
    asking = matrix.select("token", *(F.col(c).alias(f"my_{c}") for c in matrix.columns if c not in ("token", "first_end")))
    rank = F.struct("my_many", "my_group") < F.struct(F.col("many").alias("my_many"), F.col("group").alias("my_group"))
    meets = F.when(F.col("many") > 1, rank & ((F.col("my_many") == 1) | (F.col("my_home") != F.col("home"))))
    meets = meets.otherwise(rank | ((F.col("my_group") == F.col("group")) & (F.col("members") > 1)))
    meets &= (100 * F.col("most") >= percent * F.col("my_least")) & (percent * F.col("least") <= 100 * F.col("my_most"))
    met = asking.join(matrix, "token").filter(meets).groupBy("my_group", "group", "my_members", "my_most", "least", "most")
    whole = F.when(F.col("token") <= F.col("first_end"), F.col("my_slack"))  # up to there the prefixes of all members are known
    met = met.agg(F.count(whole).alias("common"), F.count("*").alias("tokens"), F.max(whole).alias("widest"), F.min(whole).alias("last"))
    # a class alone is bounded by its last common token; of several one may have only common tokens that are not whole
    slack = F.when(F.col("my_members") == 1, F.col("last")).when(F.col("common") == F.col("tokens"), F.col("widest"))
    reach = F.coalesce((100 + percent) * (F.col("common") - 1) + slack, 100 * F.col("my_most"))
    pairs = materialize(met.filter(reach >= percent * F.col("least")).select("my_group", "group", "least", "most"))
    fits = (100 * F.col("most") >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n"))
    members = grouped.select("class", "home", "n", F.col("group").alias("my_group"))
    asked = members.join(pairs, "my_group").filter(fits).select("class", "home", "n", "group")
    held = grouped.join(pairs.select("group").distinct(), "group", "left_semi").select("class", "home", "group")
    dealt = _dealt(materialize(asked), held, shown.select("class", "n", "bits"))
    near = materialize(dealt.groupBy("bucket").applyInPandas(_sieve(percent), "class long, home long, n long, group long, asks boolean"))
    for done in (matrix, grouped, pairs):
        release(done)
    columns = ["class", "home", "n", "group"]
    return near.filter("asks").select(columns).distinct(), near.filter("not asks").select(columns).distinct()


def _of_several(tokens: DataFrame) -> DataFrame:
    """The rows of tokens that more than one class has, in one shuffle: runs of equal tokens in sorted partitions. Tokens
    of a high rank go on unseen, dealt by token and class."""

    def of(batches: Batches) -> Batches:
        last: tuple | None = None  # the row before this batch, and whether it is out already
        for batch in batches:
            token, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(token):
                continue
            size = batch.column(2).to_numpy()
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
            fresh[0] = last is None or last[:2] != (token[0], name[0])
            token, name, size = token[fresh], name[fresh], size[fresh]
            if not len(token):
                continue
            out = (token >> 55) >= _HOT_RANK
            same = token[1:] == token[:-1]
            out[1:] |= same
            out[:-1] |= same
            parts = [(token[out], name[out], size[out])]
            if last is not None and last[0] == token[0]:
                if not last[3]:
                    parts.insert(0, tuple(np.array([x]) for x in last[:3]))
                if not out[0]:
                    parts.insert(1, (token[:1], name[:1], size[:1]))
                    out[0] = True
            last = (token[-1], name[-1], size[-1], bool(out[-1]))
            yield pa.record_batch([pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in range(3)], names=["token", "class", "at"])

    hot = F.when(F.shiftright("token", 55) >= _HOT_RANK, F.pmod(F.xxhash64("class"), F.lit(1024))).otherwise(0)
    dealt = tokens.select("token", "class", F.col("at").cast("long")).repartition(F.col("token"), hot).sortWithinPartitions("token", "class")
    return dealt.mapInArrow(of, "token long, class long, at long")


__all__ = ["BLANKS", "frequency_ranks", "ngram_groups", "overlap", "shingles", "text_digest"]
