"""A registry of contracts that grows with a stream: what a batch finds counts for its own later logs and all later batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.operators.registry import first_registrations, of_children

#: Where a log stands on the chain; a child's own log must stand behind the one that created it.
ORDER = ("block_number", "transaction_index", "log_index")


class GrowingRegistry:
    """Registrations as a table of one partition per epoch and batch: a batch that is run again writes over its own.

    schema: the child, the order columns and whatever else is kept, as DDL. A fork ends an epoch at its safe block:
    what an epoch found counts up to the safe blocks of all forks since, so undoing needs no rewrite and can be repeated.
    Reads give one row per child, the first registration that still counts. compact() folds old batches into one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, child: str = "child", order: Sequence[str] = ORDER) -> None:
        self._spark, self._path, self.child, self.order = spark, path.rstrip("/"), child, tuple(order)
        self._type = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("part", T.StringType())])
        self.columns = T.StructType.fromDDL(schema)
        self._type = T.StructType([*self.columns.fields, *self._type.fields])

    def add(self, epoch: int, batch: int, found: DataFrame) -> None:
        """Keep the first registration of each child that a batch found."""
        rows = first_registrations(found.select(*self.columns.names), self.child, self.order)
        rows.write.mode("overwrite").parquet(f"{self._path}/epoch={epoch}/batch={batch}/part=new")

    def _parts(self) -> DataFrame:
        try:
            return self._spark.read.schema(self._type).option("basePath", self._path).parquet(self._path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], self._type)

    @staticmethod
    def _counts(block: str, safe_blocks: Sequence[int]) -> Column:
        """Whether a row's epoch still vouches for its block: under no later fork's safe block, or at it."""
        bounds = [(epoch, min(safe_blocks[epoch:])) for epoch in range(len(safe_blocks))]
        fits = [(F.col("epoch") != epoch) | (F.col(block) <= bound) for epoch, bound in bounds]
        return reduce(lambda a, b: a & b, fits, F.lit(True))

    def read(self, safe_blocks: Sequence[int] = ()) -> DataFrame:
        """One row per child. safe_blocks: where each fork so far ended its epoch, in their order."""
        rows = self._parts().filter(self._counts(self.order[0], safe_blocks)).drop("epoch", "batch", "part")
        return first_registrations(rows, self.child, self.order)

    def compact(self, epoch: int, batch: int, floor: int, safe_blocks: Sequence[int] = ()) -> None:
        """Fold all that came up to a batch into one partition beside it, then drop what it replaces. Only what is final,
        at or below floor, is folded into one row per child: later forks can't reach it; the rest is kept as it is."""
        past = (F.col("epoch") < epoch) | ((F.col("epoch") == epoch) & (F.col("batch") <= batch))
        rows = self._parts().filter(past & self._counts(self.order[0], safe_blocks))
        final = first_registrations(rows.filter(F.col(self.order[0]) <= floor).select(*self.columns.names), self.child, self.order)
        kept = final.unionByName(rows.filter(F.col(self.order[0]) > floor).select(*self.columns.names))
        beside = f"{self._path}/_folded"
        kept.write.mode("overwrite").parquet(beside)
        target = f"{self._path}/epoch={epoch}/batch={batch}/part=folded"
        self._spark.read.schema(self.columns).parquet(beside).write.mode("overwrite").parquet(target)
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self._path).getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        for folder in {name.rpartition("/")[0] for name in self._parts().inputFiles()}:
            e, b, part = (x.partition("=")[2] for x in folder.split("/")[-3:])
            if (int(e), int(b)) <= (epoch, batch) and (int(e), int(b), part) != (epoch, batch, "folded"):
                files.delete(path(folder), True)


@dataclass(frozen=True)
class Discovery:
    """How a pipe finds contracts: registrations(tables) are the creation events of a batch, the registry keeps them."""

    registry: GrowingRegistry
    registrations: Callable[[Mapping[str, DataFrame]], DataFrame]


def later_logs(logs: DataFrame, known: DataFrame, address: str, keep: Sequence[str], child: str = "child", order: Sequence[str] = ORDER) -> DataFrame:
    """Logs of registered children that stand behind their registration on the chain, wherever batches are cut, so that
    a stream gives what one batch over the same blocks gives."""
    return of_children(logs, known, address, child, keep, after=(order, order))
