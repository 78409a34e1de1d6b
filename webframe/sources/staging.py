"""Intermediate tables in the shared folder of the cluster.

A written table cuts lineage like ``checkpoint()`` does, and survives the loss
of executors because it lies in the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Only a local session without one gets a temporary folder; on a cluster a
    folder of one machine would lose data with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = getattr(spark, "_webframe_dir", None)
    if local is None:
        local = tempfile.mkdtemp(prefix="webframe-")
        spark._webframe_dir = local
    return local


@contextmanager
def setting(spark: SparkSession, name: str, value: str | None) -> Iterator[None]:
    """A session setting for a while; None leaves it as it is."""
    before = spark.conf.get(name, None)
    if value is not None:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """One job's folder below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The written table and its row count, from a single job."""
        table, seen = self.observed(df, name, n=F.count(F.lit(1)))
        return table, seen["n"]

    def observed(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """The written table, and aggregates of its rows that are worked out while it is written."""
        seen = Observation(uuid.uuid4().hex)
        target = f"{self.path}/{name}"
        df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target), dict(seen.get)

    def read(self, schema, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def keyed(self, df: DataFrame, name: str, keys: list[str], buckets: int, parts: tuple[str, ...] = ()) -> int:
        """Adds rows to a table dealt by ``keys`` into ``buckets``, in folders by ``parts``; returns their number.

        A scan of it has the partitioning that a join or an aggregate on ``keys`` asks for, so its rows stay where they
        are. The files lie in the job's folder; the session's catalog knows the table by a name of its own.
        """
        seen = Observation(uuid.uuid4().hex)
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if parts:
            writer = df.write.partitionBy(*parts)
        else:
            writer = df.write
        writer = writer.bucketBy(buckets, *keys).option("path", f"{self.path}/{name}").format("parquet")
        writer.mode("append").saveAsTable(self._table(name))
        return seen.get["n"]

    def table(self, name: str) -> DataFrame:
        """The table written by :meth:`keyed`, with all rows added so far."""
        return self.spark.table(self._table(name))

    def released(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of such a table, which the catalog no longer knows; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> str:
        return f"{self.path.rsplit('/', 1)[1]}_{name}".replace("-", "_")
