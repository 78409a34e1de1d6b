"""Slash-separated path functions (lexical, no file system access)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import as_col, let, memo

def _no_segments() -> Column:
    return F.array().cast("array<string>")


def clean_slash(path: Column | str) -> Column:
    """Runs of slashes become one slash."""
    return F.regexp_replace(as_col(path), "/{2,}", "/")


def trim_slash(text: Column | str) -> Column:
    """Without one trailing slash."""
    return F.regexp_replace(as_col(text), r"/\z", "")


def _fold_dots(segments: Column, rooted: Column) -> Column:
    def step(acc, seg):
        last = F.try_element_at(acc, F.lit(-1))
        can_pop = (F.size(acc) > 0) & (last != "..")
        return (
            F.when(seg != "..", F.array_append(acc, seg))
            .when(can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(rooted, acc)
            .otherwise(F.array_append(acc, seg))
        )

    return F.aggregate(segments, _no_segments(), step)


@memo
def clean_path(path: Column | str) -> Column:
    """Shortest equivalent path: ``.`` and ``..`` removed, ``''`` becomes ``.``."""

    def fold(path):
        rooted = path.startswith("/")
        segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
        full = F.concat(
            F.when(rooted, "/").otherwise(""), F.array_join(_fold_dots(segments, rooted), "/")
        )
        # Most paths are clean already; one scan decides.
        needs_work = path.rlike(r"//|(?:\A|/)\.\.?(?:/|\z)|(?s:.)/\z|\A\z")
        return F.when(needs_work, let(full, lambda t: F.when(t == "", ".").otherwise(t))).otherwise(
            path
        )

    return let(as_col(path), fold)


def base_name(path: Column | str) -> Column:
    """Last segment; ``.`` for an empty path and ``/`` for only slashes."""
    path = as_col(path)
    last = F.regexp_extract(path, r"(?s)([^/]+)/*\z", 1)
    return F.when(path == "", ".").when(path.rlike(r"\A/+\z"), "/").otherwise(last)


@memo
def dir_name(path: Column | str) -> Column:
    """Cleaned path without its last segment."""
    return clean_path(F.regexp_replace(as_col(path), r"[^/]*\z", ""))


def join_path(*parts: Column | str) -> Column:
    """Non-empty parts joined by slashes and cleaned; ``''`` if all are empty."""
    parts = F.filter(F.array(*[as_col(p) for p in parts]), lambda p: p != "")
    return let(
        F.array_join(parts, "/"), lambda p: F.when(p == "", "").otherwise(clean_path(p))
    )


@memo
def ancestors(path: Column | str) -> Column:
    """All parent directories of a path, deepest first."""

    def build(path):
        parts = F.split(path, "/")
        n = F.size(parts)
        # A leading slash yields an empty first part, which is not a directory.
        shortest = F.when(path.startswith("/"), 2).otherwise(1)
        none = F.array().cast("array<int>")
        lengths = F.when(n - 1 >= shortest, F.sequence(n - 1, shortest, F.lit(-1))).otherwise(none)
        return F.transform(lengths, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))

    return let(clean_path(path), build)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))


@memo
def relative_path(from_file: Column | str, to_file: Column | str) -> Column:
    """Path of ``to_file`` as seen from the directory of ``from_file``."""

    def build(x):
        here, there = x["here"], x["there"]
        differs = F.zip_with(here, there, lambda a, b: ~a.eqNullSafe(b))
        shared = F.coalesce(
            F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.size(here).cast("bigint")
        )
        shared = F.least(shared, F.size(here), F.size(there)).cast("int")

        def walk(shared):
            ups = F.array_repeat(F.lit(".."), F.size(here) - shared)
            rest = F.slice(there, shared + 1, F.size(there) - shared)
            return F.array_join(F.concat(ups, rest), "/")

        return let(
            let(shared, walk), lambda out: F.when(out == "", ".").otherwise(out)
        )

    return let({"here": _segments(dir_name(from_file)), "there": _segments(clean_path(to_file))}, build)


def extension(path: Column | str) -> Column:
    """From the last dot of the last segment, or ``''``."""
    return F.regexp_extract(as_col(path), r"\.[^./]*\z", 0)


def numbered_name(path: Column | str, n: Column) -> Column:
    """``base(n)ext``; the path itself for ``n = 0``."""
    path = as_col(path)
    numbered = F.regexp_replace(
        path, F.lit(r"(?s)\A(.*?)(\.[^./]*)?\z"), F.concat(F.lit("$1("), n.cast("string"), F.lit(")$2"))
    )
    return F.when(n == 0, path).otherwise(numbered)


def output_path(url: Column | str, save_path: str = "", output_file: str | None = None) -> Column:
    """Plain-download target: the text after the last slash, query included."""
    name = F.lit(output_file) if output_file else F.element_at(F.split(as_col(url), "/"), -1)
    return join_path(F.lit(save_path), name) if save_path or output_file else name


def escapes_root(path: Column | str) -> Column:
    """True where a relative path climbs above its start."""
    return clean_path(as_col(path)).rlike(r"\A\.\.(?:/|\z)")


def leaves_folder(path: Column | str, folder: Column | str) -> Column:
    """True where a cleaned path does not lie below the folder it was meant for."""
    inside = let(clean_path(as_col(folder)), lambda f: F.when(f.isin("", "."), "").when(f == "/", f).otherwise(F.concat(f, F.lit("/"))))
    return let(
        {"path": clean_path(as_col(path)), "inside": inside},
        lambda x: ~x["path"].startswith(x["inside"]) | (x["path"] == x["inside"]) | ((x["inside"] == "") & escapes_root(x["path"])),
    )
