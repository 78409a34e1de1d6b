"""URL columns: split, validate, clean, resolve, compare.

A URL is split by one regular expression and recomposed from the parts. Spark's
``parse_url`` is not used: it goes through ``java.net.URI``, which refuses
blanks and drops the host when the port is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webframe.functions.common import ALL, as_col, let, memo, record
from webframe.functions.paths import clean_slash

# scheme, authority, path, query, fragment. Without a scheme, three or more
# leading slashes are path, not authority.
_SPLIT = (
    r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*+):(//[^/?#]*+)?|(//(?!/)[^/?#]*+))?+"
    r"([^?#]*+)(\?[^#]*+)?(#.*)?\z"
)
_SEP = "\u0001"
_JOIN = f"$1{_SEP}$2$3{_SEP}$4{_SEP}$5{_SEP}$6"

_UNRESERVED = r"A-Za-z0-9\-_.~"
_PATH_SAFE = _UNRESERVED + r"$&+,/:;=@"
_FRAGMENT_SAFE = _PATH_SAFE + r"?!()*"
_HOST_SAFE = _UNRESERVED + r"!$&'()*+,;=:\[\]<>\x22"
# Characters that may stay as written in a path or fragment.
_KEPT = _PATH_SAFE + r"!'()*\[\]%"

_CONTROL = r"(?s)\A[^#]*[\x00-\x1F\x7F]"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_HOST_OK = rf"\A(?:[{_HOST_SAFE}]|[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f]|%25)*+\z"
_PORT_BAD = r":[0-9]*[^0-9:\]][^:\]]*\z"
_USER_OK = rf"\A[{_UNRESERVED}:!$&'()*+,;=%@]*+\z"

# URLs that cleaning leaves as they are; decides in one scan for most links.
_CLEAN_ALREADY = (
    r"\A(?:https?://[A-Za-z0-9.\-]++(?::[0-9]++)?+(?=[/?#]|\z)|[A-Za-z0-9\-_.~$&+,;=@]*+(?=[/?#]|\z))"
    rf"(?:/(?!/)|[{_UNRESERVED}$&+,:;=@!'()*\[\]]|%(?!2[Ff])[0-9A-Fa-f]{{2}})*+"
    r"(?:\?[^#\x00-\x1F\x7F]*+)?+"
    rf"(?:#[{_FRAGMENT_SAFE}]++)?+\z"
)


# Absolute URLs whose host and path can be read off; no user, no stray characters.
_PLAIN_URL = (
    rf"\Ahttps?://[A-Za-z0-9.\-]++(?::[0-9]++)?+"
    rf"(?:/(?!/|\.\.?(?:[/?#]|\z))(?:[{_UNRESERVED}$&+,:;=@!'()*\[\]]|%[89A-Fa-f][0-9A-Fa-f])*+)*+"
    r"(?:\?[^#\x00-\x1F\x7F]*+)?+"
    rf"(?:#[{_FRAGMENT_SAFE}]++)?+\z"
)
# Paths from the root: the first kind stays as it is, the second is encoded.
_ROOTED_PLAIN = (
    rf"\A(?:/(?!/|\.\.?(?:[/?#]|\z))[{_UNRESERVED}$&+,:;=@]*+)++"
    r"(?:\?[^#\x00-\x1F\x7F]*+)?+"
    rf"(?:#[{_FRAGMENT_SAFE}]++)?+\z"
)
_ROOTED_UNSAFE = r"\A(?:/(?!/|\.\.?(?:/|\z))[^/?#%\x00-\x1F\x7F]*+)++\z"
# What form encoding escapes although a path may hold it.
_FORM_DIFFERENCES = {
    "+": "%20", "*": "%2A", "%2F": "/", "%2C": ",", "%3A": ":", "%3B": ";", "%3D": "=",
    "%40": "@", "%26": "&", "%24": "$", "%2B": "+", "%7E": "~",
}


def _encode_plain(path: Column) -> Column:
    """Encoding of a path without escapes, out of form encoding."""
    out = F.url_encode(path)
    for form, kept in _FORM_DIFFERENCES.items():
        out = F.replace(out, F.lit(form), F.lit(kept))
    return out


def _percent_encode(text: Column, safe: str) -> Column:
    """Decode, then encode everything outside ``safe`` as upper-case UTF-8 bytes."""
    tokens = F.regexp_extract_all(text, F.lit(rf"%[0-9A-Fa-f]{{2}}|[{safe}]++|(?s:.)"), F.lit(0))

    def one(t):
        plain = F.char(F.conv(F.substring(t, 2, 2), 16, 10).cast("int"))
        escaped = F.when(plain.rlike(rf"\A[{safe}]\z"), plain).otherwise(F.upper(t))
        return (
            F.when(t.rlike(rf"\A[{safe}]"), t)
            .when(F.length(t) == 3, escaped)
            .otherwise(F.regexp_replace(F.hex(t), "(..)", "%$1"))
        )

    return F.array_join(F.transform(tokens, one), "")


def _escaped(text: Column, safe: str) -> Column:
    """As written where every character is legal, else re-encoded as a whole."""
    legal = text.rlike(rf"\A[{safe}{_KEPT}]*+\z")
    return F.when(legal, text).otherwise(_percent_encode(text, safe))


def _escaped_fragment(fragment: Column) -> Column:
    return F.when(fragment == "", "").otherwise(
        F.concat(F.lit("#"), _escaped(F.substring(fragment, 2, ALL), _FRAGMENT_SAFE))
    )


@memo
def parse_url(url: Column | str) -> Column:
    """``STRUCT<scheme, userinfo, host, path, query, fragment, opaque, rooted, error>``.

    ``query`` and ``fragment`` keep their ``?`` and ``#``; ``path`` is as
    written; ``rooted`` tells ``scheme:/path`` from ``scheme:///path``;
    ``error`` is true where a strict parser gives up.
    """

    def cut(url):
        return let(
            F.split(F.regexp_replace(url, _SPLIT, _JOIN), _SEP, 5),
            lambda p: record(
                scheme=F.lower(F.get(p, F.lit(0))),
                authority=F.get(p, F.lit(1)),
                path=F.get(p, F.lit(2)),
                query=F.get(p, F.lit(3)),
                fragment=F.get(p, F.lit(4)),
                userinfo=F.regexp_extract(F.get(p, F.lit(1)), r"(?s)\A//(.*)@", 1),
                host=F.regexp_replace(F.get(p, F.lit(1)), r"(?s)\A//(?:.*@)?", ""),
            ),
        )

    def build(x):
        url, p = x["url"], x["p"]
        scheme, authority, path = p["scheme"], p["authority"], p["path"]
        host, fragment = p["host"], p["fragment"]
        opaque = (scheme != "") & (authority == "") & (path != "") & ~path.startswith("/")
        bad_authority = (
            ~host.rlike(_HOST_OK)
            | host.rlike(_PORT_BAD)
            | (host.startswith("[") & ~host.contains("]"))
            | ~p["userinfo"].rlike(_USER_OK)
        )
        error = (
            url.rlike(_CONTROL)
            | url.startswith(":")
            | ((scheme == "") & path.rlike(r"\A[^/]*:"))
            | (~opaque & path.contains("%") & path.rlike(_BAD_ESCAPE))
            | (fragment.contains("%") & fragment.rlike(_BAD_ESCAPE))
            | ((authority != "") & bad_authority)
        )
        encoded = F.when(host.rlike(r"[^\x00-\x7F]|%"), _percent_encode(host, _HOST_SAFE))
        return record(
            scheme=scheme,
            userinfo=p["userinfo"],
            host=encoded.otherwise(host),
            path=path,
            query=p["query"],
            fragment=F.when(fragment == "#", "").otherwise(fragment),
            opaque=opaque,
            rooted=(authority == "") & (scheme != "") & path.startswith("/"),
            error=F.coalesce(error, F.lit(True)),
        )

    return let(as_col(url), lambda u: let({"url": u, "p": cut(u)}, build))


def _compose(scheme, userinfo, host, path, query, fragment, rooted) -> Column:
    def build(x):
        scheme, userinfo, host, path = x["scheme"], x["userinfo"], x["host"], x["path"]
        no_host = (host == "") & (userinfo == "")
        slashes = F.when(no_host & (x["rooted"] | (path == "") | (scheme == "")), "")
        lead = (
            F.when((path != "") & ~path.startswith("/") & (host != ""), "/")
            .when((scheme == "") & no_host & path.rlike(r"\A[^/]*:"), "./")
            .otherwise("")
        )
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            slashes.otherwise("//"),
            F.when(userinfo != "", F.concat(userinfo, F.lit("@"))).otherwise(""),
            host,
            lead,
            path,
            x["query"],
            x["fragment"],
        )

    parts = {
        "scheme": scheme, "userinfo": userinfo, "host": host, "path": path,
        "query": query, "fragment": fragment, "rooted": rooted,
    }
    return let(parts, build)


def _clean_parsed(p: Column) -> Column:
    def clean(decoded):
        strip = (p["host"] == "") & (p["scheme"] != "") & (p["scheme"] != "file")
        collapsed = clean_slash(decoded)
        cleaned = F.regexp_replace(collapsed, F.when(strip, r"\A/+").otherwise(r"\A\z"), F.lit(""))
        return let(
            cleaned,
            lambda c: F.when(c == decoded, _escaped(p["path"], _PATH_SAFE)).otherwise(c),
        )

    text = _compose(
        p["scheme"], p["userinfo"], p["host"], let(_percent_encode(p["path"], _PATH_SAFE), clean),
        p["query"], _escaped_fragment(p["fragment"]), p["rooted"],
    )
    return F.when(~p["error"] & ~p["opaque"], text)


@memo
def clean_url(url: Column | str) -> Column:
    """Slashes of the path collapsed, unsafe characters encoded; NULL on error."""
    return let(
        as_col(url),
        lambda u: F.when(u.rlike(_CLEAN_ALREADY), u).otherwise(let(parse_url(u), _clean_parsed)),
    )


_DOTS = r"(?:\A|/)\.\.?(?:/|\z)"


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` of a rooted path, keeping a final slash."""

    def step(acc, seg):
        return (
            F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, seg))
        )

    def fold(path):
        segments = F.slice(F.split(path, "/"), 2, ALL)
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        # A final dot segment names a directory.
        final = F.when(path.rlike(r"/\.\.?\z"), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        resolved = F.concat(F.lit("/"), F.array_join(F.concat(kept, final), "/"))
        return F.when(path.rlike(_DOTS), resolved).otherwise(path)

    return let(path, fold)


@memo
def base_of(url: Column | str, base_mode: str = "directory") -> Column:
    """What resolving needs of a page URL, parsed once per page.

    ``dir`` is the path links are appended to: with ``base_mode="directory"``
    the whole path followed by a slash, with ``"rfc3986"`` the path up to its
    last slash.
    """

    def build(p):
        path = p["path"]
        if base_mode == "directory":
            own = F.when(path.endswith("/"), _escaped(path, _PATH_SAFE)).otherwise(
                F.concat(_percent_encode(path, _PATH_SAFE), F.lit("/"))
            )
            folder = own
        else:
            own = _escaped(path, _PATH_SAFE)
            folder = F.concat(F.lit("/"), F.regexp_replace(own, r"\A/|[^/]*\z", ""))
        return let(
            {"own": own, "dir": folder},
            lambda x: record(
                scheme=p["scheme"],
                userinfo=p["userinfo"],
                host=p["host"],
                dir=x["dir"],
                own=x["own"],
                query=p["query"],
                fragment=p["fragment"],
                origin=F.when(
                    (p["scheme"] != "") & (p["host"] != "") & (p["userinfo"] == ""),
                    F.concat(p["scheme"], F.lit("://"), p["host"]),
                ),
                error=F.coalesce(p["error"] | p["opaque"], F.lit(True)),
            ),
        )

    return let(parse_url(clean_url(url)), build)


def resolve_parsed(base: Column, cleaned: Column, ref: Column) -> Column:
    """Absolute URL of a link, or NULL.

    ``base`` comes from :func:`base_of`, ``cleaned`` from :func:`clean_url`
    and ``ref`` is ``parse_url(cleaned)``.
    """
    path = ref["path"]
    own_host = (ref["host"] != "") | (ref["userinfo"] != "")
    target = (
        F.when(own_host | path.startswith("/"), path)
        .when(path == "", base["own"])
        .otherwise(F.concat(base["dir"], path))
    )
    inherit = ~own_host & (path == "") & (ref["query"] == "")
    relative = _compose(
        base["scheme"],
        F.when(own_host, ref["userinfo"]).otherwise(base["userinfo"]),
        F.when(own_host, ref["host"]).otherwise(base["host"]),
        _remove_dots(target),
        F.when(inherit, base["query"]).otherwise(ref["query"]),
        F.when(inherit & (ref["fragment"] == ""), base["fragment"]).otherwise(ref["fragment"]),
        F.lit(False),
    )
    return F.when(ref["scheme"] != "", cleaned).when(~base["error"] & ~ref["error"], relative)


@memo
def absolute_url(parent: Column | str, link: Column | str, base_mode: str = "directory") -> Column:
    """Absolute form of ``link`` found on ``parent``; NULL if it has none."""
    return let(
        {"base": base_of(parent, base_mode), "link": as_col(link)},
        lambda x: resolve_with(x["base"], x["link"]),
    )


@memo
def resolve_with(base: Column | str, link: Column | str) -> Column:
    """Like :func:`absolute_url` for a page already parsed by :func:`base_of`.

    Plain URLs and paths from the root, most links, need one or two scans; the
    others go through the parser.
    """
    base, link = as_col(base), as_col(link)
    any_link = let(
        {"base": base, "link": clean_url(link)},
        lambda x: let(
            parse_url(x["link"]), lambda ref: resolve_parsed(x["base"], x["link"], ref)
        ),
    )
    rooted = link.startswith("/") & base["origin"].isNotNull() & ~base["error"]
    return (
        F.when(rooted & link.rlike(_ROOTED_PLAIN), F.concat(base["origin"], link))
        .when(rooted & link.rlike(_ROOTED_UNSAFE), F.concat(base["origin"], _encode_plain(link)))
        .when(link.startswith("http") & link.rlike(_PLAIN_URL), link)
        .otherwise(any_link)
    )


@memo
def url_host(url: Column | str) -> Column:
    """Host with port; ``''`` without one; NULL for an unparsable URL."""
    url = as_col(url)
    parsed = let(parse_url(url), lambda p: F.when(~p["error"], p["host"]))
    return F.when(url.rlike(_PLAIN_URL), F.regexp_extract(url, "://([^/?#]*)", 1)).otherwise(parsed)


@memo
def same_host(a: Column | str, b: Column | str) -> Column:
    """Equal hosts, ports included; false if either URL is unparsable."""
    return F.coalesce(url_host(a) == url_host(b), F.lit(False))


def hostname(host: Column) -> Column:
    """Host without port and brackets."""
    return F.when(
        host.startswith("["), F.regexp_extract(host, r"\A\[([^\]]*)\]", 1)
    ).otherwise(F.regexp_replace(host, r":[0-9]*\z", ""))


def percent_decode(text: Column) -> Column:
    """``%xx`` decoded; a plus sign stays a plus sign."""
    return F.when(
        text.contains("%"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    ).otherwise(text)


@memo
def url_path(url: Column | str) -> Column:
    """Decoded path; NULL for an unparsable URL."""
    url = as_col(url)
    parsed = let(
        parse_url(url),
        lambda p: F.when(~p["error"], F.when(p["opaque"], "").otherwise(percent_decode(p["path"]))),
    )
    plain = let(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), percent_decode)
    return F.when(url.rlike(_PLAIN_URL), plain).otherwise(parsed)


def is_plain(url: Column) -> Column:
    """True for an absolute URL without user, dot segments or doubled slashes."""
    return url.rlike(_PLAIN_URL)


def drop_fragment(url: Column | str) -> Column:
    return F.regexp_replace(as_col(url), "(?s)#.*", "")


@memo
def with_default_scheme(url: Column | str, scheme: str = "http") -> Column:
    """Seed URL with a scheme put in front where it has none; NULL on error."""

    def build(p):
        text = _compose(
            F.when(p["scheme"] == "", scheme).otherwise(p["scheme"]),
            p["userinfo"], p["host"], _escaped(p["path"], _PATH_SAFE),
            p["query"], _escaped_fragment(p["fragment"]), p["rooted"],
        )
        opaque = F.concat(p["scheme"], F.lit(":"), p["path"], p["query"], p["fragment"])
        return F.when(~p["error"], F.when(p["opaque"], opaque).otherwise(text))

    return let(parse_url(url), build)


@memo
def validate_url(url: Column | str) -> Column:
    """``STRUCT<url, valid, error>`` of a seed as typed by a user.

    A bare host gets ``https://`` (``http://`` for the local host), ``:80`` and
    ``:443`` choose the scheme; the host needs a dot unless it is local.
    """
    raw = as_col(url)
    parts = F.split(raw, ":")
    port = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    first = F.get(parts, F.lit(0))
    ported = (
        F.when(port == "80", F.concat(F.lit("http://"), first))
        .when(port == "443", F.concat(F.lit("https://"), first))
        .otherwise(raw)
    )
    local = ported.startswith("localhost") | ported.startswith("127.0.0.1")
    full = (
        F.when(ported.startswith("http://") | ported.startswith("https://"), ported)
        .when(local, F.concat(F.lit("http://"), ported))
        .otherwise(F.concat(F.lit("https://"), ported))
    )

    def check(x):
        full, path, userinfo, host = x["full"], x["path"], x["userinfo"], x["host"]
        name = F.element_at(F.split(host, ":"), 1)
        unparsable = (
            full.rlike(r"[\x00-\x1F\x7F]")
            | path.rlike(_BAD_ESCAPE)
            | ~host.rlike(_HOST_OK)
            | host.rlike(_PORT_BAD)
            | (host.startswith("[") & ~host.contains("]"))
            | ~userinfo.rlike(_USER_OK)
        )
        # The names of the errors, which results show.
        error = (
            F.when(raw.startswith("/"), "relative path")
            .when(unparsable, "invalid URL")
            .when(host == "", "host missing")
            .when(host.startswith(".") | host.startswith("-"), "wrong host format")
            .when(
                ~name.contains(".") & ~name.isin("localhost", "127.0.0.1"),
                "invalid domain format",
            )
        )
        return let(
            error,
            lambda e: record(url=F.when(e.isNull(), full), valid=e.isNull(), error=e),
        )

    # A request URI has no fragment: '#' belongs to the host or the path.
    def cut(full):
        authority = F.regexp_extract(full, r"(?s)\Ahttps?://([^/?]*)", 1)
        parts = {
            "full": full,
            "path": F.regexp_extract(full, r"(?s)\Ahttps?://[^/?]*([^?]*)", 1),
            "userinfo": F.regexp_extract(authority, r"(?s)\A(.*)@", 1),
            "host": F.regexp_replace(authority, r"(?s)\A.*@", ""),
        }
        return let(parts, check)

    return let(full, cut)
