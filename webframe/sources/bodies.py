"""Raw bodies in files of their own, with their headers in a table beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions.headers import header_get
from webframe.sources.responses import with_headers
from webframe.sources.staging import setting

#: Names of character sets as headers and pages give them, and the decoder for each.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "UTF-8", "ascii": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1",
    "windows-1252": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}
#: Bytes of a body in which a page names its character set.
HEAD = 1024


def declared_charset(headers: Column | str) -> Column:
    """The charset parameter of ``Content-Type`` in lower case, ``''`` if there is none."""
    return F.lower(F.regexp_extract(header_get(headers, "Content-Type"), r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1))


def sniffed_charset(content: Column) -> Column:
    """What the first bytes tell: a byte order mark, or the charset a page names; else ``''``."""
    mark, head = F.hex(F.substring(content, 1, 3)), F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    return (
        F.when(mark == "EFBBBF", "utf-8").when(mark.startswith("FFFE"), "utf-16le").when(mark.startswith("FEFF"), "utf-16be")
        .otherwise(F.lower(F.regexp_extract(head, r"(?is)<meta[^>]+charset\s*=\s*[\"']?([^\s;\"'/>]+)", 1)))
    )


def decoded(content: Column, charset: Column) -> Column:
    """Text of bytes; a character set that is not known counts as UTF-8, bytes that do not fit become U+FFFD, a byte order mark goes.

    For UTF-16 the replacement holds under ``spark.sql.legacy.codingErrorAction``; else such bytes are an error.
    """
    text = F.when(F.lit(False), F.lit(""))
    for decoder in sorted(set(CHARSETS.values()) - {"UTF-8"}):
        names = [n for n, d in CHARSETS.items() if d == decoder]
        text = text.when(charset.isin(*names), F.decode(content, decoder))
    return F.regexp_replace(text.otherwise(F.make_valid_utf8(content.cast("string"))), "^﻿", "")


def read_bodies(spark: SparkSession, path: str, sidecar: DataFrame) -> DataFrame:
    """Responses out of files: ``(path, url, status, headers, mime, declared_length, filename, body_length, charset, body)``.

    ``sidecar(path, url, status, headers)`` names each file by its path below ``path``; files it does not name are left out,
    and a name without a file, or whose file is empty, which a scan leaves out, has no row. The charset is the declared one, else what the body tells, else UTF-8.
    Files are read where they lie; a body is one row, so it must fit a task.
    """
    # A listing may write the scheme of the folder otherwise; what counts is what follows the folder itself.
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring("path", F.locate(root, F.col("path")) + len(root), F.lit(1 << 30))
    found = files.select(below.alias("path"), "content", F.col("length").alias("body_length"))
    joined = found.join(sidecar.select("path", "url", "status", "headers"), "path")
    named = F.coalesce(F.nullif(declared_charset("headers"), F.lit("")), F.nullif(sniffed_charset(F.col("content")), F.lit("")), F.lit("utf-8"))
    charset = F.when(named.isin(*CHARSETS), named).otherwise("utf-8")
    read = with_headers(joined.withColumn("charset", charset))
    # Analysis, which is now, settles that bytes which do not fit are replaced and no error.
    with setting(spark, "spark.sql.legacy.codingErrorAction", "true"):
        read = read.withColumn("body", decoded(F.col("content"), F.col("charset")))
    return read.select("path", "url", "status", "headers", "mime", "declared_length", "filename", "body_length", "charset", "body")
