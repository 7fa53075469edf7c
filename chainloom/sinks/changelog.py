"""A changelog sink: messages by key with a rising sequence, and compensations for keys that a fork orphans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.errors import SinkError
from chainloom.functions.scalars import row_id, sequence_hex
from chainloom.operators.forks import Block
from chainloom.operators.revisions import compensate, latest_per_key, sequenced
from chainloom.sinks.fs import Folder
from chainloom.sinks.state import State, StateLog

# Limits of messages and their attributes, in bytes.
MOST_BYTES, MOST_KEY = 10_000_000, 1_024


def messages(rows: DataFrame, keys: Sequence[str], kind: str = "change_type", seq: str = "seq") -> DataFrame:
    """One JSON payload a row: its columns with _id, _CHANGE_TYPE and _CHANGE_SEQUENCE_NUMBER; ordering_key is the id."""
    values = [c for c in rows.columns if c not in (kind, seq)]
    name = row_id(*keys)
    body = F.to_json(F.struct(*sorted(values), name.alias("_id"), F.col(kind).alias("_CHANGE_TYPE"), sequence_hex(seq).alias("_CHANGE_SEQUENCE_NUMBER")))
    return rows.select(name.alias("ordering_key"), seq, body.alias("payload"))


def too_large(found: DataFrame) -> DataFrame:
    """Messages over the limits."""
    return found.filter((F.octet_length("payload") > MOST_BYTES) | (F.octet_length("ordering_key") > MOST_KEY))


class ChangelogSink:
    """At least once in order by key, and once by sequence: revisions are written to the outbox and the manifest with the
    state, then published, then confirmed by a second state. publish gets a DataFrame of messages dealt by key and sorted
    by sequence; what was not confirmed is published again. The sequence never goes back, also after a fork, when each
    orphaned key gets its surviving revision, its finalized baseline, its stored inverse or a delete.

    inverse: makes of the rows of a batch (with their seq) those that undo them: keys, seq and the same values, for the
    keys that have any. They are stored with the revisions and go when the manifest has no revision of their key."""

    def __init__(self, spark: SparkSession, path: str, pipe: str, keys: Sequence[str], publish: Callable[[DataFrame], None], block: str = "block_number", inverse: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self._spark, self._keys, self._publish, self._block, self._inverse = spark, list(keys), publish, block, inverse
        self.log, self._folder = StateLog(spark, path, pipe), Folder(spark, path)

    def _table(self, name: str) -> DataFrame | None:
        parts = self.log.load()[1].extra.get(name, [])
        return self._spark.read.parquet(*(self._folder.at(p) for p in parts)) if parts else None

    def _commit(self, rows: DataFrame, state: State, manifest: bool = True) -> State:
        number, _ = self.log.load()
        part = f"revisions/v{number + 1:012d}"
        rows.write.mode("overwrite").parquet(self._folder.at(part))
        found = self._spark.read.parquet(self._folder.at(part))
        bad = too_large(messages(found, self._keys))
        if not bad.isEmpty():
            raise SinkError("a message is over the limits")
        top = found.agg(F.max("seq")).first()[0]
        extra = {**state.extra, "outbox": [part], "seq": max(top or 0, state.extra.get("seq", 0))}
        if manifest:
            extra["manifest"] = [*state.extra.get("manifest", []), part]
            if self._inverse:
                beside = f"inverses/v{number + 1:012d}"
                self._inverse(found.drop("change_type", self._block)).write.mode("overwrite").parquet(self._folder.at(beside))
                extra["inverses"] = [*state.extra.get("inverses", []), beside]
        self.log.save(State(state.cursor, state.floor, state.chain, extra))
        return self.confirm()

    def confirm(self) -> State:
        """Publish what waits in the outbox, then note it as published."""
        _, now = self.log.load()
        waiting = self._table("outbox")
        if waiting is None:
            return now
        self._publish(messages(waiting, self._keys).repartition("ordering_key").sortWithinPartitions("ordering_key", "seq"))
        return self.log.save(State(now.cursor, now.floor, now.chain, {**now.extra, "outbox": []}))

    recover = confirm

    def write(self, rows: DataFrame, headers: Sequence[Block], floor: Block | None = None, order: Sequence[str] = ()) -> State:
        """rows: keys, block and values; each becomes an upsert in the order given within its block."""
        state = self.log.advance(headers, floor)
        out = sequenced(rows, self._block, list(order) or self._keys, state.extra.get("seq", 0)).withColumn("change_type", F.lit("UPSERT"))
        return self._commit(out, state)

    def rollback(self, canonical: Sequence[Block]) -> Block:
        safe = self.log.fork(canonical)
        _, now = self.log.load()
        manifest, baseline = self._table("manifest"), self._table("baseline")
        state = State(safe, now.floor, now.chain, now.extra)
        if manifest is None:
            self.log.save(state)
            return safe
        values = [c for c in manifest.columns if c not in (*self._keys, "seq", "change_type", self._block)]
        base = baseline if baseline is not None else manifest.limit(0)
        undone = compensate(manifest, base, self._keys, self._block, "seq", safe.number, values, self._table("inverses"))
        undone = undone.select(*self._keys, F.lit(safe.number).cast("long").alias(self._block), *values, F.when(F.col("action") == "delete", "DELETE").otherwise("UPSERT").alias("change_type"))
        number, _ = self.log.load()
        kept = f"kept/v{number + 1:012d}"
        manifest.filter(F.col(self._block) <= safe.number).write.mode("overwrite").parquet(self._folder.at(kept))
        state = State(safe, now.floor, now.chain, {**now.extra, "manifest": [kept], **self._pruned(kept, number + 1)})
        self._commit(sequenced(undone, self._block, self._keys, now.extra.get("seq", 0)), state, manifest=False)
        return safe

    def _pruned(self, manifest: str, number: int) -> dict:
        """Inverses of the keys that a manifest still has, as a new part."""
        inverses = self._table("inverses")
        if inverses is None:
            return {}
        part = f"inverses/kept{number:012d}"
        inverses.join(self._spark.read.parquet(self._folder.at(manifest)).select(*self._keys).distinct(), self._keys, "left_semi").select(*inverses.columns).write.mode("overwrite").parquet(self._folder.at(part))
        return {"inverses": [part]}

    def fold(self) -> None:
        """Move what is final into the baseline: the last final revision of each key; the manifest keeps the rest."""
        number, now = self.log.load()
        manifest, baseline = self._table("manifest"), self._table("baseline")
        if manifest is None or now.floor is None:
            return
        final = manifest.filter(F.col(self._block) <= now.floor.number)
        both = final if baseline is None else final.unionByName(baseline)
        parts = {"baseline": f"baseline/v{number + 1:012d}", "manifest": f"kept/v{number + 1:012d}"}
        latest_per_key(both, self._keys, ["seq"]).select(*manifest.columns).write.mode("overwrite").parquet(self._folder.at(parts["baseline"]))
        manifest.filter(F.col(self._block) > now.floor.number).write.mode("overwrite").parquet(self._folder.at(parts["manifest"]))
        self.log.save(State(now.cursor, now.floor, now.chain, {**now.extra, **{k: [v] for k, v in parts.items()}, **self._pruned(parts["manifest"], number + 1)}))
