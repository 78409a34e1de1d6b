"""Mirror of whole sites from a snapshot of responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.common import with_once
from webframe.functions.paths import join_path, leaves_folder
from webframe.functions.urls import hostname, url_host
from webframe.operators.crawl import closure
from webframe.operators.extract import adjacency, explode_links, page_links
from webframe.operators.filters import with_limits
from webframe.operators.pathset import last_write_wins, resolve_dir_conflicts, save_path
from webframe.operators.rewrite import convert_documents, link_maps, link_pairs, link_targets
from webframe.operators.skew import salted_join
from webframe.operators.transfers import throttle_schedule
from webframe.options import MirrorOptions
from webframe.sources.responses import fetch_error
from webframe.sources.snapshots import with_redirects
from webframe.sources.staging import Workspace


Listener = Callable[[dict], None]


@dataclass(frozen=True)
class Hooks:
    """A job's own columns over the responses, planned into it like the built-in ones.

    ``save_path`` names the file of a response, ``keep`` and ``traverse`` say whether it is kept and its links are
    followed, besides what the options say; NULL counts as no. What is not kept is not followed either, HTML excepted.
    """

    save_path: Column | None = None
    keep: Column | None = None
    traverse: Column | None = None


class Mirror:
    """Results of one mirror job, worked out as they are asked for.

    ``nested(src, links)`` and ``links(src, pos, kind, tag, link, dst,
    same_host)`` of every page that is followed, ``reached(seed_id, url, depth)`` of every URL requested, ``results`` with
    the fetch result per reached URL, ``saved(url, save_path)`` of every kept
    one, ``files(save_path, url, n_urls)`` with the URL whose body each file
    holds. Each is a written table.
    """

    #: Characters of a URL by which the requests of a level are cut into parts.
    _PART = 32

    def __init__(self, responses: DataFrame, seeds: DataFrame, options: MirrorOptions, hooks: Hooks, progress: Listener):
        self._workspace = Workspace(seeds.sparkSession, "mirror")
        if "location" in responses.columns:
            responses = self._write(with_redirects(responses), "responses")
        self.responses = responses
        self.options, self.hooks, self._progress = options, hooks, progress
        self._fetched = self._write(fetched(responses, options, hooks), "fetched")
        self.nested = self._fetched.where("src IS NOT NULL").select("src", "links")
        self.reached = closure(adjacency(self.nested), seeds, options.max_depth, progress=progress)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return self._workspace.write(df, name)[0]

    @property
    def links(self) -> DataFrame:
        return explode_links(self.nested)

    @cached_property
    def results(self) -> DataFrame:
        narrow = self._fetched.drop("src", "links")
        missing = F.when(F.col("keep").isNull(), "not_found").otherwise(F.col("error"))
        joined = self.reached.join(narrow, "url", "left").withColumn("error", missing)
        taken = F.when(F.col("error").isNull(), F.col("body_length"))
        table, seen = self._workspace.observed(
            joined, "results", files=F.count(F.lit(1)), failed=F.count("error"), bytes=F.coalesce(F.sum(taken), F.lit(0))
        )
        self._progress({"step": "results", **seen})
        return table

    @cached_property
    def _settled(self) -> tuple[DataFrame, DataFrame]:
        # Seeds may share URLs: each is saved once, in its last fetch.
        kept = (
            self.results.where("error IS NULL AND keep")
            .groupBy("url", "raw_path")
            .agg(F.max(F.struct("seed_id", "depth")).alias("_last"))
            .select("url", "raw_path", "_last.seed_id", "_last.depth")
        )
        saved, files = settle_paths(kept, ["seed_id", "depth"])
        return self._write(saved, "saved"), files

    @property
    def saved(self) -> DataFrame:
        return self._settled[0]

    @cached_property
    def files(self) -> DataFrame:
        return self._write(self._settled[1], "files")

    def converted(self) -> DataFrame:
        """``(save_path, url, body)`` of the saved HTML and CSS, links rewritten.

        Paths and link maps, which are small, are joined first; bodies are
        moved once, by the join with both.
        """
        return self._converted(self.responses.where(F.col("mime").isin("text/html", "text/css")))

    def _converted(self, responses: DataFrame) -> DataFrame:
        pairs = link_pairs(self.nested)
        maps = link_maps(link_targets(pairs, self.saved, self.options.keep_fragment))
        wanted = self.files.select("url", "save_path").join(maps.withColumnRenamed("src", "url"), "url", "left")
        docs = responses.select("url", "mime", "body").join(wanted, "url")
        return convert_documents(docs).select("save_path", "url", F.col("converted").alias("body"))

    def saved_site(self, convert_links: bool | None = None) -> DataFrame:
        """``(save_path, url, body)`` of every file of the saved site.

        HTML and CSS have their links converted unless ``convert_links`` (by default that of the options) is off; all
        else is as it was fetched.
        """
        if self.options.convert_links if convert_links is None else convert_links:
            return self._converted(self.responses)
        files = self.files.select("url", "save_path")
        return self.responses.select("url", "body").join(files, "url").select("save_path", "url", "body")

    def dangling_links(self) -> DataFrame:
        """``(src, pos, link, dst)``: links to pages that were followed but not kept; they stay as they were written."""
        links = self.links.where("same_host").select("src", "pos", "link", "dst")
        gone = self.results.where("error IS NULL AND NOT keep").select(F.col("url").alias("dst")).distinct()
        return salted_join(links, gone, "dst")

    def schedule(self) -> DataFrame:
        """``(seed_id, url, done_second)``: when each request is through at ``rate_limit`` bytes a second for each seed.

        Requests are made level by level and in order of their URLs; without a limit all are done in second 0.
        """
        taken = F.when(F.col("error").isNull(), F.col("body_length")).otherwise(0)
        requests = self.results.select(
            F.col("seed_id").alias("transfer_id"), F.timestamp_seconds("depth").alias("ts"), F.col("url").alias("event_id"), taken.alias("bytes")
        )
        # Levels are cut further by the beginning of the URL, which does not decrease along them either.
        part = F.struct("ts", F.substring("event_id", 1, self._PART))
        done = throttle_schedule(requests, self.options.rate_limit, part)
        return done.select(F.col("transfer_id").alias("seed_id"), F.col("event_id").alias("url"), "done_second")

    def manifest(self) -> DataFrame:
        """``(url, save_path, status, mime, escapes_root)`` of every saved URL, and ``final_url`` where redirects are known."""
        more = [c for c in ("final_url",) if c in self.responses.columns]
        facts = self.responses.select("url", "status", "mime", *more)
        own = join_path(F.lit(self.options.save_path), hostname(url_host("url")))
        return self.saved.join(facts, "url").select(
            "url", "save_path", "status", "mime", *more, leaves_folder("save_path", own).alias("escapes_root")
        )


def fetch_results(responses: DataFrame, options: MirrorOptions, hooks: Hooks = Hooks()) -> DataFrame:
    """Adds ``error, wanted, keep, traverse, raw_path`` to each response.

    Worked out of the narrow columns; whoever does not select the body does not
    read it.
    """
    path = save_path("url", "mime", "filename", options.save_path) if hooks.save_path is None else hooks.save_path
    limited = with_once(with_limits(responses, options.rejects, options.excludes), raw_path=path)
    if hooks.keep is not None:
        limited = limited.withColumn("keep", F.col("keep") & F.coalesce(hooks.keep, F.lit(False)))
        limited = limited.withColumn("wanted", (F.col("mime") == "text/html") | F.col("keep"))
        limited = limited.withColumn("traverse", F.col("traverse") & F.col("wanted"))
    if hooks.traverse is not None:
        limited = limited.withColumn("traverse", F.col("traverse") & F.coalesce(hooks.traverse, F.lit(False)))
    error = fetch_error(options.allowed_status, F.col("wanted"), F.col("raw_path"))
    if "redirect_error" in responses.columns:
        error = F.coalesce("redirect_error", error)
    return limited.withColumn("error", error)


def fetched(responses: DataFrame, options: MirrorOptions, hooks: Hooks = Hooks()) -> DataFrame:
    """The narrow columns of :func:`fetch_results`, and ``src, links`` of :func:`page_links` for the HTML and CSS bodies
    that a mirror follows, NULL for the others.

    One pass over the responses: bodies are neither joined nor shuffled.
    """
    facts = [c for c in ("final_url", "redirect_error") if c in responses.columns]
    narrow = ("url", "status", "mime", "body_length", "error", "keep", "traverse", "raw_path", *facts)
    followed = F.col("mime").isin("text/html", "text/css") & F.col("error").isNull() & F.col("traverse")
    read = fetch_results(responses, options, hooks).select(
        *narrow, F.when(followed, F.col("url")).alias("_page"), F.when(followed, F.col("body")).alias("_body")
    )
    return page_links(read, "_page", "_body", "mime", options.base_mode, options.canonicalize, narrow)


def settle_paths(kept: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``saved`` and ``files`` of kept rows ``(url, raw_path, *order)``.

    Directory conflicts are settled before collisions, because a moved file may
    land on an ``index.html`` that is there already.
    """
    paths = resolve_dir_conflicts(
        kept.select("raw_path").distinct().withColumn("save_path", F.col("raw_path"))
    )
    placed = kept.join(paths, "raw_path").select(
        "url", "save_path", F.struct(*order).alias("fetch_order")
    )
    return placed.select("url", "save_path"), last_write_wins(placed, "fetch_order")


def mirror(
    responses: DataFrame,
    seeds: DataFrame,
    options: MirrorOptions = MirrorOptions(),
    hooks: Hooks = Hooks(),
    progress: Listener = lambda event: None,
) -> Mirror:
    """Mirror ``seeds(seed_id, url)`` out of ``responses``.

    ``responses(url, status, mime, declared_length, filename, body_length,
    body)`` has one row per requested URL (see ``latest_responses``); with a column ``location`` redirects are followed.
    ``progress`` is called with a dictionary after each level and when the results are known; its numbers
    are worked out by the job that writes them.
    """
    return Mirror(responses, seeds, options, hooks, progress)
