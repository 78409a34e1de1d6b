"""A saved site that is replaced as a whole: readers see the old version or the new one, never parts of both."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MARKER = "_CURRENT"


class Site:
    """A folder of versions, of which a marker names the one that counts.

    A version is written beside the others through Spark's job commit; then the marker is written under another name
    and renamed over the old one, which file systems do as one step. A job that ends before that leaves the old
    version as it is. Object stores without such a rename need a commit log instead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, files: DataFrame) -> str:
        """Writes ``files`` as the new version; returns its name."""
        name = f"version-{uuid.uuid4().hex}"
        files.write.parquet(f"{self.path}/{name}")
        self._commit(name)
        return name

    def _commit(self, name: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{name}"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MARKER}")
        out = draft.getFileSystem(conf).create(draft, True)
        out.write(bytearray(json.dumps({"version": name}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, target, options)

    def current(self) -> str | None:
        """The name of the version that counts; None before the first one."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MARKER}")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return None
        stream = files.open(where)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["version"]
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The files of the version that counts. It stays that version while a query runs, whatever is published meanwhile."""
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"no version of {self.path} was published")
        return self.spark.read.parquet(f"{self.path}/{name}")
