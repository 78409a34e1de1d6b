"""Save paths: of one URL, and made free of conflicts for a whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.common import as_col, let, memo
from webframe.functions.headers import mime_extension
from webframe.functions.paths import ancestors, dir_name, join_path, numbered_name
from webframe.functions.urls import hostname, is_plain, parse_url, percent_decode
from webframe.operators.prefix import running
from webframe.sources.staging import Workspace


@memo
def save_path(
    url: Column | str, mime: Column | str, filename: Column | str, parent: str | Column = ""
) -> Column:
    """File a mirrored URL is saved to; ``''`` for URLs without one.

    ``parent/host/directory/name``; the query, the scheme and the port do not
    count. ``filename`` (from the disposition header, may be NULL) replaces the
    name, and an empty name becomes ``index`` with the extension of the type.
    """
    mime, filename = as_col(mime), as_col(filename)
    parent = F.lit(parent) if isinstance(parent, str) else parent

    def build(x):
        path, folder = x["path"], x["folder"]
        tail = F.when(
            path.startswith(folder), F.substring(path, F.length(folder) + 1, F.length(path))
        ).otherwise(path)
        unnamed = F.concat(F.lit("index."), mime_extension(mime))
        name = let(tail, lambda t: F.when(t.isin("", "/"), unnamed).otherwise(t))
        host = F.when(x["host"] == "", "").otherwise(F.concat(x["host"], F.lit("/")))
        nothing = x["error"] | ((x["host"] == "") & (path == ""))
        full = join_path(parent, F.concat(host, folder), F.coalesce(filename, name))
        return F.when(nothing, "").otherwise(full)

    def cut(p):
        return let(
            F.when(p["opaque"], "").otherwise(percent_decode(p["path"])),
            lambda path: let(
                {
                    "error": p["error"],
                    "host": hostname(p["host"]),
                    "path": path,
                    "folder": dir_name(path),
                },
                build,
            ),
        )

    def plain(x):
        path = x["path"]
        index = F.concat(F.lit("index."), mime_extension(mime))
        name = F.when(path == "", F.concat(F.lit("/"), index)).when(path.endswith("/"), index)
        return join_path(parent, F.concat(x["host"], path, name.otherwise("")))

    url = as_col(url)
    parts = {
        "host": hostname(F.regexp_extract(url, "://([^/?#]*)", 1)),
        "path": let(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), percent_decode),
    }
    return F.when(is_plain(url) & filename.isNull(), let(parts, plain)).otherwise(
        F.coalesce(let(parse_url(url), cut), F.lit(""))
    )


def last_write_wins(files: DataFrame, order: str) -> DataFrame:
    """One row per ``save_path``: the URL written last, and how many collided."""
    return files.groupBy("save_path").agg(
        F.max_by("url", F.struct(order, "url")).alias("url"),
        F.count(F.lit(1)).alias("n_urls"),
    )


_INDEX = r"(?:/index\.html)+\z"


def _stem(path: str | Column) -> tuple[Column, Column]:
    """A path without the ``/index.html`` it ends in, and how many of them it had."""
    path = as_col(path)
    stem = F.regexp_replace(path, _INDEX, "")
    return stem, F.floor((F.length(path) - F.length(stem)) / len("/index.html"))


def resolve_dir_conflicts(files: DataFrame, path: str = "save_path") -> DataFrame:
    """Files that another file needs as a directory move to ``index.html`` in it.

    That may be needed as a directory too, and so on. Directories come with all
    their parents, so the free one lies past the deepest that is needed.
    """
    needed = files.select(F.explode(ancestors(path)).alias("_dir"))
    stem, depth = _stem("_dir")
    deepest = needed.groupBy(stem.alias("_stem")).agg(F.max(depth).alias("_deepest"))
    stem, depth = _stem(path)
    joined = files.join(deepest, stem == F.col("_stem"), "left")
    more = F.greatest(F.col("_deepest") + 1 - depth, F.lit(0)).cast("int")
    moved = F.concat(F.col(path), F.repeat(F.lit("/index.html"), more))
    return joined.withColumn(path, F.coalesce(moved, F.col(path))).drop("_stem", "_deepest")


def numbered(rows: DataFrame, by: str, out: str) -> DataFrame:
    """Adds ``out``: numbers that rise with ``by``, with gaps; for any column that can be sorted."""
    workspace = Workspace(rows.sparkSession, "numbered")
    in_order = rows.repartitionByRange(by).sortWithinPartitions(by)
    return workspace.write(in_order.withColumn(out, F.monotonically_increasing_id()), "rows")[0]


def _skip_taken(rows: DataFrame, existing: DataFrame, name: str, bucket_size: int) -> DataFrame:
    """Raises ``_n`` past the numbers of a name that are taken already.

    With the taken numbers ``b0 < b1 < ...`` of a name, the row of rank ``r``
    moves up once for every ``j`` with ``bj - j <= r``.
    """
    old = existing.select(F.col(name).alias("_old")).distinct()
    parts = r"(?s)\A(.*)\(([1-9][0-9]{0,17})\)(\.[^./]*)?\z"
    numbered = old.where(F.col("_old").rlike(parts)).select(
        F.regexp_replace("_old", parts, "$1$3").alias(name),
        F.regexp_extract("_old", parts, 2).cast("bigint").alias("_k"),
        "_old",
    )
    # Only names that lead to just this one: "a(1)" is no number of "a.b(1)".
    numbered = numbered.where(numbered_name(name, F.col("_k")) == F.col("_old")).drop("_old")
    taken = old.select(F.col("_old").alias(name), F.lit(0).cast("bigint").alias("_k")).unionByName(numbered)
    taken = taken.join(rows.select(name).distinct(), name, "left_semi")
    counted = running(taken, [name], ["_k"], F.lit(1), "_j", F.floor(F.col("_k") / bucket_size))
    marks = counted.select(name, (F.col("_k") - F.col("_j") + 1).alias("_at"), F.lit(0).alias("_row"))
    both = rows.select("*", F.col("_rank").alias("_at"), F.lit(1).alias("_row")).unionByName(
        marks, allowMissingColumns=True
    )
    shifted = running(
        both, [name], ["_at", "_row"], 1 - F.col("_row"), "_up", F.floor(F.col("_at") / bucket_size)
    )
    return (
        shifted.where("_row = 1")
        .withColumn("_n", F.col("_rank") + F.col("_up"))
        .drop("_at", "_row", "_up")
    )


def unique_names(
    names: DataFrame,
    existing: DataFrame | None = None,
    order: str = "ordinal",
    name: str = "name",
    bucket_size: int = 100_000,
) -> DataFrame:
    """Adds ``unique_name``: each row in turn takes the first free numbered name.

    Candidates of ``a.txt`` are ``a.txt``, ``a(1).txt``, ``a(2).txt`` and so on;
    rows come in the order of ``order`` (unique), after the ``existing`` names.
    All rows propose at once; a name goes to its first claimant and the others
    move on to their next candidate, until nobody is refused. With one common
    order that ends in the same assignment as going row by row. Rows of one name
    start at their rank past the numbers taken before, so that a single round
    without refusals is the usual case.
    """
    workspace = Workspace(names.sparkSession, "names")
    names, _ = workspace.write(names, "names")
    bucket = F.floor(F.col(order) / bucket_size)
    ranked = running(names, [name], [order], F.lit(1), "_rank", bucket)
    rows = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn("_n", F.col("_rank"))
    taken = None
    if existing is not None:
        taken = existing.select(F.col(name).alias("_try")).distinct().withColumn(order, F.lit(None).cast("bigint"))
        rows = _skip_taken(rows, existing, name, bucket_size)
    turn = 0
    while True:
        rows = rows.withColumn(
            "_try",
            F.when(F.trim(name) == "", "").otherwise(numbered_name(name, F.col("_n"))),
        )
        rows, _ = workspace.write(rows, f"round-{turn}")
        claims = rows.where("_try != ''").select("_try", order)
        if taken is not None:
            claims = claims.unionByName(taken)
        # NULL stands for a file that was there before: it sorts first.
        winners = claims.groupBy("_try").agg(
            F.min(F.struct(order)).alias("_w"), F.count(F.lit(1)).alias("_c")
        )
        refused = (
            rows.where("_try != ''")
            .join(winners.where("_c > 1"), "_try")
            .where(~F.col(order).eqNullSafe(F.col(f"_w.{order}")))
            .select(F.col(order).alias("_o"))
        )
        refused, n_refused = workspace.write(refused, f"refused-{turn}")
        if n_refused == 0:
            return rows.select(*names.columns, F.col("_try").alias("unique_name"))
        pushed = rows.join(refused, F.col(order) == F.col("_o"), "left").withColumn(
            "_least", F.col("_n") + F.when(F.col("_o").isNotNull(), 1).otherwise(0) - F.col("_rank")
        )
        # A row stays behind every earlier row of its name.
        pushed = running(pushed.drop("_o"), [name], [order], F.col("_least"), "_shift", bucket, "max")
        rows = pushed.withColumn("_n", F.col("_rank") + F.col("_shift")).drop("_least", "_shift", "_try")
        turn += 1
