"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webframe.sources.staging import Workspace, setting

#: Removes the shuffle files of an execution at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space, in the bounds that the contracts use.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_spaces(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scratch(Workspace):
    """A job's folder below the shared one, whose tables can be dropped when they are used up."""

    def save(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """Writes ``df``, in folders by ``parts``, and returns the written table."""
        writer = df.write.partitionBy(*parts) if parts else df.write
        with setting(self.spark, CLEANUP, "true"):
            writer.parquet(self.at(name))
        return self.open(name, df.schema)

    def open(self, name: str, schema: T.StructType) -> DataFrame:
        """A written table with every column taken as nullable."""
        fields = [T.StructField(f.name, f.dataType) for f in schema]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_text(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns ``kept`` of a table and the place of the text among what is sent on, which holds it only once."""
    if text_col in kept:
        return docs.select(*kept), kept.index(text_col)
    return docs.select(*kept, F.col(text_col).alias("_text")), len(kept)
