"""What a pipe has done, told by Spark itself: observed with the scan that is made anyway, never by a second one."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: The name of a pipe's observation.
OBSERVED = "chainloom"


def observed(blocks: DataFrame, count_bytes: bool = True) -> DataFrame:
    """blocks that tell, as they pass, how many they are, between which numbers, and how many bytes their entities take as
    JSON, which costs writing it; count_bytes=False spares that."""
    size = F.lit(0).cast("long")
    for name in [f.name for f in blocks.schema.fields if f.name != "header"] if count_bytes else []:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))).cast("long"), F.lit(0))
    return blocks.observe(OBSERVED, F.count("*").alias("blocks"), F.min("header.number").alias("first"), F.max("header.number").alias("last"), F.sum(size).alias("bytes"))


class PipeMetrics(StreamingQueryListener):
    """Sums over all queries of a pipe, its epochs included: batches, empty batches (skips), blocks, bytes, the last block,
    queries begun, and those that ended in a fork or another failure. Register it with spark.streams.addListener."""

    def __init__(self, fork_code: str = "E1000") -> None:
        self._lock, self._fork = threading.Lock(), fork_code
        self._sums = {"queries": 0, "batches": 0, "skips": 0, "blocks": 0, "bytes": 0, "forks": 0, "failures": 0}
        self._last: int | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._sums["queries"] += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = (event.progress.observedMetrics or {}).get(OBSERVED)
        with self._lock:
            self._sums["batches"] += 1
            if row is None or not row["blocks"]:
                self._sums["skips"] += 1
                return
            self._sums["blocks"] += row["blocks"]
            self._sums["bytes"] += row["bytes"] or 0
            self._last = row["last"] if self._last is None else max(self._last, row["last"])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        with self._lock:
            self._sums["skips"] += 1

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            with self._lock:
                self._sums["forks" if self._fork in event.exception else "failures"] += 1

    def read(self) -> Mapping[str, int | None]:
        """The sums so far."""
        with self._lock:
            return {**self._sums, "last": self._last}
