"""Site closure: all pages reachable from many seeds at once.

The adjacency lists and the visited keys lie in tables that are bucketed by the keys they are joined on, with as
many buckets as the session has shuffle partitions. Each level is one job: the frontier (keys only) is dealt by URL
to the lists, its targets are brought down to distinct ones with map-side aggregation and dealt by key to the
visited set, and what is new is added there. Neither the graph nor the visited set is shuffled. Levels are
committed writes, so a lost executor costs one level's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.operators.skew import salted_join
from webframe.sources.staging import Workspace

KEY = ["seed_id", "url"]


class Closure:
    """A crawl in progress; :meth:`step` adds one level."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, buckets: int | None = None):
        self._spark = seeds.sparkSession
        self._space = Workspace(self._spark, "closure")
        self._buckets = buckets or int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        if "dst" in edges.columns:
            edges = edges.groupBy("src").agg(F.collect_set("dst").alias("dsts"))
        self._space.keyed(edges.select("src", "dsts"), "graph", ["src"], self._buckets)
        self.depth = 0
        self.added = self._add(seeds.select(F.col("seed_id").cast("bigint"), "url").distinct())

    def _add(self, keys: DataFrame) -> int:
        level = keys.select(*KEY, F.lit(self.depth).cast("bigint").alias("depth"))
        return self._space.keyed(level, "visited", KEY, self._buckets, ("depth",))

    @property
    def reached(self) -> DataFrame:
        return self._space.table("visited")

    def fresh(self) -> DataFrame:
        """The keys one link beyond the last level that were not reached before."""
        visited = self.reached
        frontier = visited.where(F.col("depth") == self.depth).select(*KEY)
        met = frontier.join(self._space.table("graph"), F.col("url") == F.col("src"))
        candidates = met.select("seed_id", F.explode("dsts").alias("url")).distinct()
        return candidates.join(visited.select(*KEY), KEY, "left_anti")

    def finish(self) -> DataFrame:
        """What was reached; the tables leave the catalog, which may be one that outlives the session."""
        reached = self.reached.schema
        self._space.released("graph", self._space.table("graph").schema)
        return self._space.released("visited", reached)

    def step(self) -> int:
        """Adds the next level; returns the number of its keys."""
        fresh = self.fresh()
        self.depth += 1
        self.added = self._add(fresh)
        return self.added


def closure(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    buckets: int | None = None,
    progress: Callable[[dict], None] = lambda event: None,
) -> DataFrame:
    """``(seed_id, url, depth)`` of every URL requested when mirroring the seeds.

    ``edges(src, dst)``, or ``(src, dsts)`` with the targets of a page in one
    row, must only leave pages that are traversed. Each seed has
    its own visited set. Depth is the number of links from the seed. ``progress`` hears of each level.
    """
    crawl = Closure(edges, seeds, buckets)
    progress({"step": "level", "depth": 0, "urls": crawl.added})
    while crawl.added and (max_depth is None or crawl.depth < max_depth):
        crawl.step()
        progress({"step": "level", "depth": crawl.depth, "urls": crawl.added})
    return crawl.finish()


def unseen(frontier: DataFrame, visited: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Distinct frontier keys that were not visited before."""
    key = key or ["seed_id", "url"]
    return frontier.select(*key).distinct().join(visited.select(*key).distinct(), key, "left_anti")


def discovery_parents(reached: DataFrame, nested: DataFrame) -> DataFrame:
    """For each URL beyond the seeds the page and link that led to it first.

    First means the smallest page URL, then link position, one level above.
    ``nested`` is the table of :func:`page_links`; pages are joined whole and
    taken apart afterwards.
    """
    found = (
        reached.select("seed_id", F.col("url").alias("src"), "depth")
        .join(nested, "src")
        .select("seed_id", "depth", "src", F.posexplode("links").alias("pos", "_l"))
        .where("_l.same_host")
        .groupBy("seed_id", F.col("_l.dst").alias("url"))
        .agg(F.min(F.struct("depth", "src", F.col("pos").cast("bigint").alias("pos"))).alias("_first"))
    )
    return (
        reached.where("depth > 0")
        .join(found, ["seed_id", "url"])
        .select("seed_id", "url", "depth", F.col("_first.src").alias("parent"), F.col("_first.pos").alias("pos"))
    )


def link_status(links: DataFrame, results: DataFrame) -> DataFrame:
    """Links with the result of their target; NULL columns where there is none.

    A target with a large share of the links is dealt over several tasks.
    """
    return salted_join(links, results.withColumnRenamed("url", "dst"), "dst", "left")


def link_outcomes(reached: DataFrame, nested: DataFrame, results: DataFrame) -> DataFrame:
    """``(seed_id, outcome, n_links)`` over every link met by the crawl.

    ``nested`` is the table of :func:`page_links`, ``results(url, error, keep)``
    has one row per URL. Links are counted per target before the join, so a popular target is one row: the first link to a
    target has the target's outcome, the others find it already visited.
    """
    counted = (
        reached.select("seed_id", F.col("url").alias("src"))
        .join(nested, "src")
        .select("seed_id", F.explode("links").alias("_l"))
        .select(
            "seed_id",
            F.when(F.col("_l.dst").isNull(), "unresolvable")
            .when(~F.col("_l.same_host"), "off_host")
            .alias("drop_reason"),
            F.col("_l.dst").alias("dst"),
        )
        .select("seed_id", "drop_reason", F.when(F.col("drop_reason").isNull(), F.col("dst")).alias("url"))
        .groupBy("seed_id", "drop_reason", "url")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Every target of a counted link was reached; a seed is visited before any
    # link to it, so none of its links is the first.
    first = F.when(F.col("depth") > 0, 1).otherwise(0).cast("bigint")
    state = (
        F.when(F.col("_hit").isNull(), "not_found")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("keep"), "rejected")
        .otherwise("saved")
    )
    parts = F.when(
        F.col("drop_reason").isNotNull(), F.array(F.struct(F.col("drop_reason").alias("outcome"), "n"))
    ).otherwise(
        F.array(
            F.struct(state.alias("outcome"), first.alias("n")),
            F.struct(F.lit("visited").alias("outcome"), (F.col("n") - first).alias("n")),
        )
    )
    return (
        counted.join(reached.select("seed_id", "url", "depth"), ["seed_id", "url"], "left")
        .join(results.select("url", "error", "keep", F.lit(True).alias("_hit")), "url", "left")
        .select("seed_id", F.inline(parts))
        .where("n > 0")
        .groupBy("seed_id", "outcome")
        .agg(F.sum("n").alias("n_links"))
    )
