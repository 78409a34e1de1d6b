"""Reject and exclude globs compiled into one ``rlike`` each."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import as_col
from webframe.functions.paths import base_name, dir_name

# What the wildcards stand for, and how a word without special characters is anchored.
_WILD = {"*": ".*", "?": ".?"}
_SUFFIX, _PREFIX = ".*{}$", "^/?{}.*"
#: A bracket up to the last closing one of the line, or one character that is special in an expression.
_SPECIAL = re.compile(r"\[.*\]|[\\.+*?()|\[\]{}^$]")


def _translated(m: re.Match) -> str:
    part = m.group()
    return part if len(part) > 1 else _WILD.get(part, "\\" + part)


def compile_glob(pattern: str, is_reject: bool) -> str | None:
    """Regular expression of a glob, or ``None`` if it has none.

    A pattern without special characters is a suffix of the name (reject) or a
    prefix of the directory (exclude); any other is searched for anywhere.
    """
    out = _SPECIAL.sub(_translated, pattern)
    if out == pattern:
        out = (_SUFFIX if is_reject else _PREFIX).format(pattern)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(out)
    except re.error:
        return None
    return out


def _java_class(m: re.Match) -> str:
    inside = m.group(2).replace("[", r"\[").replace("&&", r"&\&")
    return f"[{m.group(1)}{inside}]"


def java_regex(regex: str) -> str:
    """The same language in Java syntax: only ``\\n`` ends a line, and
    brackets or ``&&`` have no meaning inside a class."""
    if regex.endswith("$") and not regex.endswith(r"\$"):
        regex = regex[:-1] + r"\z"
    return re.sub(r"(?<!\\)\[(\^?)(\]?[^\]]*)\]", _java_class, regex)


def _any(text: Column, patterns, is_reject: bool) -> Column:
    compiled = [compile_glob(p, is_reject) for p in patterns]
    parts = [f"(?:{java_regex(c)})" for c in compiled if c is not None]
    return text.rlike("(?d)" + "|".join(parts)) if parts else F.lit(False)


def should_reject(path: Column | str, patterns) -> Column:
    """True where the last segment of a decoded path matches a reject glob."""
    return _any(base_name(as_col(path)), patterns, True)


def should_exclude(path: Column | str, patterns) -> Column:
    """True where the directory of a decoded path matches an exclude glob."""
    return _any(dir_name(as_col(path)), patterns, False)
