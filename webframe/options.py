"""Job arguments shared by the mirror and download plans."""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class MirrorOptions:
    """Arguments of one mirror or download job.

    ``rejects`` are globs on the last path segment, ``excludes`` globs on the
    directory; both only make sense for a mirror. ``base_mode`` is
    ``"directory"`` (a page URL counts as a directory when links are resolved)
    or ``"rfc3986"``. ``max_depth`` stops the crawl early; ``None`` means the
    whole site.
    """

    save_path: str = ""
    output_file: str | None = None
    rejects: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    mirror: bool = True
    convert_links: bool = False
    allowed_status: tuple[int, ...] | None = (200,)
    base_mode: str = "directory"
    canonicalize: bool = False
    keep_fragment: bool = False
    max_depth: int | None = None
    rate_limit: int = 0

    def __post_init__(self):
        if self.base_mode not in ("directory", "rfc3986"):
            raise ValueError(f"unknown base_mode {self.base_mode!r}")
        if self.convert_links and not self.mirror:
            raise ValueError("convert_links needs mirror")
        if (self.rejects or self.excludes) and not self.mirror:
            raise ValueError("rejects and excludes need mirror")
        if self.mirror and self.output_file:
            raise ValueError("output_file cannot be combined with mirror")
        if any(p == "" for p in self.rejects + self.excludes):
            warnings.warn("an empty pattern matches every path", stacklevel=2)
