"""DuckDB SQL that gives the same rows as the registered queries.

The SQL is worked out from the semantics alone: characters are encoded one by
one, dot segments are folded over a list, reachability is a recursive query.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


def enc(text: str) -> str:
    """Percent-encoding of a path, character by character."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '.'), lambda ch: "
        "CASE WHEN regexp_matches(ch, '^[A-Za-z0-9._~$&+,/:;=@-]$') THEN ch ELSE url_encode(ch) END), '')"
    )


def undot(path: str) -> str:
    """Dot segments of a rooted path removed."""
    return f"""
    CASE WHEN {path} IS NULL THEN NULL ELSE coalesce(nullif(array_to_string(list_reduce(
        list_transform(list_concat([''], string_split({path}, '/')[2:]), lambda s: [s]),
        lambda acc, s: CASE WHEN s[1] = '.' THEN acc
            WHEN s[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END
            ELSE list_concat(acc, s) END), '/')
        || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END, ''), '/') END"""


PARTS = f"""
parts AS (
    SELECT page_id, url, html, {HOST} AS h, regexp_extract(url, '^(https?)://', 1) AS s,
        regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p,
        regexp_extract(url, '(\\?[^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS f
    FROM pages)"""


def resolving(links: str) -> str:
    """CTEs up to ``resolved(page_id, url, pos, link, dst)`` for a list of links."""
    return f"""
WITH {PARTS},
listed AS (SELECT *, {links} AS links FROM parts),
ex AS (SELECT page_id, url, h, s, p, q, f, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos FROM listed),
cut AS (
    SELECT *, regexp_extract(link, '^([^?#]*)', 1) AS lp, regexp_extract(link, '^[^?#]*(\\?[^#]*)', 1) AS lq,
        regexp_extract(link, '(#.*)$', 1) AS lf, p || CASE WHEN p LIKE '%/' THEN '' ELSE '/' END AS d
    FROM ex),
target AS (
    SELECT *, CASE WHEN lp = '' THEN d WHEN lp LIKE '//%' THEN NULL WHEN lp LIKE '/%' THEN {enc("lp")}
        WHEN regexp_matches(lp, '^[A-Za-z]+:') THEN NULL ELSE d || {enc("lp")} END AS t FROM cut),
resolved AS (
    SELECT page_id, url, h, pos, link, CASE
        WHEN regexp_matches(link, '^https?://') THEN link
        WHEN regexp_matches(link, '^[A-Za-z]+:') THEN NULL
        WHEN link LIKE '//%' THEN s || '://' || regexp_extract(link, '^//([^/]*)', 1)
            || regexp_replace(regexp_extract(link, '^//[^/]*(.*)$', 1), '/+', '/', 'g')
        ELSE s || '://' || h || {undot("t")}
            || CASE WHEN lp = '' AND lq = '' THEN q ELSE lq END
            || CASE WHEN lp = '' AND lq = '' AND lf = '' THEN f ELSE lf END
        END AS dst FROM target)"""


OWN = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
FORMS = resolving(
    f"list_concat({OWN}, ['../x', './y/../z', '?q=1', '#frag', '', '../../../../up', '//' || h || '//cdn//' || page_id,"
    " 'mailto:a@' || h, 'javascript:void(0)', 'b' || page_id || '.html', 'http://' || h || '/abs/' || page_id, '.',"
    " 'a:b', '/p/./q/../r/'])"
)
PLAIN = resolving(OWN)
DST_PATH = "url_decode(regexp_extract(dst, '^https?://[^/?#]*([^?#]*)', 1))"
DST_HOST = "regexp_extract(dst, '^https?://([^/?#]*)', 1)"
SAVED = (
    FORMS
    + f""", saved AS (
    SELECT *, {DST_HOST} || {DST_PATH} || CASE WHEN {DST_PATH} LIKE '%/' THEN 'index.html'
        WHEN {DST_PATH} = '' THEN '/index.html' ELSE '' END AS save_path
    FROM resolved WHERE dst IS NOT NULL)"""
)

# URLs ----------------------------------------------------------------------

ORACLES["url_parts"] = f"""
WITH {PARTS} SELECT page_id, s AS scheme, h AS host, p AS path, q AS query, f AS fragment, false AS error FROM parts"""

SEEDS = f"""
forms AS (
    SELECT page_id, [url, h, h || ':80', h || ':443', '/' || h, 'ftp://' || h, split_part(h, '.', 1), 'https://-' || h,
        'a b' || h, 'localhost:' || page_id, 'https://', h || ':8080/x?y'] AS raws
    FROM (SELECT page_id, url, {HOST} AS h FROM pages)),
seeds AS (SELECT page_id, generate_subscripts(raws, 1) - 1 AS variant, unnest(raws) AS raw FROM forms),
full_seeds AS (
    SELECT *, CASE WHEN split_part(raw, ':', 2) = '80' THEN 'http://' || split_part(raw, ':', 1)
        WHEN split_part(raw, ':', 2) = '443' THEN 'https://' || split_part(raw, ':', 1)
        WHEN raw LIKE 'http://%' OR raw LIKE 'https://%' THEN raw
        WHEN raw LIKE 'localhost%' THEN 'http://' || raw ELSE 'https://' || raw END AS u FROM seeds),
judged AS (
    SELECT *, regexp_extract(u, '^https?://([^/?]*)', 1) AS a FROM full_seeds),
checked AS (
    SELECT *, CASE WHEN raw LIKE '/%' THEN 'relative path'
        WHEN a LIKE '% %' OR regexp_matches(a, '#|:.*[^0-9]') THEN 'invalid URL'
        WHEN a = '' THEN 'host missing'
        WHEN a LIKE '.%' OR a LIKE '-%' THEN 'wrong host format'
        WHEN split_part(a, ':', 1) NOT LIKE '%.%' AND split_part(a, ':', 1) NOT IN ('localhost', '127.0.0.1')
        THEN 'invalid domain format' END AS error FROM judged)"""

ORACLES["validate_urls"] = f"""
WITH {SEEDS} SELECT page_id, variant, raw, CASE WHEN error IS NULL THEN u END AS url, error IS NULL AS valid, error FROM checked"""

ORACLES["seed_union"] = f"""
WITH {SEEDS} SELECT raw, CASE WHEN error IS NULL THEN u END AS url, error, count(*) AS n FROM checked GROUP BY ALL"""

ORACLES["url_list_scan"] = f"""
WITH {SEEDS} SELECT CASE WHEN error IS NULL THEN u END AS url, error, count(*) AS n FROM checked GROUP BY ALL"""

ORACLES["clean_slash"] = """
SELECT page_id, regexp_replace(replace(replace(url, '/', '//'), 'e', 'e///'), '/+', '/', 'g') AS cleaned FROM pages"""

ORACLES["clean_url"] = f"""
WITH {PARTS},
words AS (SELECT *, p || q || f AS rest, regexp_extract(html, '<a href="/([^"]*)"', 1) AS w FROM parts),
forms AS (
    SELECT page_id, [url, 'http://' || h || rest, 'https://' || h || '/a/' || {enc("w")} || '/',
        'http://' || h || '/a%20b/' || {enc("w")}, NULL, NULL, '../' || {enc("w")} || '/',
        '/' || {enc("w")} || '?q=a//b c#f'] AS urls FROM words)
SELECT page_id, generate_subscripts(urls, 1) - 1 AS variant, unnest(urls) AS cleaned FROM forms"""

ORACLES["resolve_links"] = FORMS + " SELECT page_id, pos, link, dst FROM resolved"

ORACLES["same_host"] = (
    FORMS
    + f""" SELECT page_id, pos, coalesce(CASE WHEN dst IS NOT NULL THEN h = {DST_HOST} END, false) AS same FROM resolved"""
)

ORACLES["seed_default_scheme"] = """
WITH forms AS (
    SELECT page_id, [url, regexp_replace(url, '^https?://', ''), '//' || regexp_replace(url, '^https?://', '')] AS raws FROM pages),
ex AS (SELECT page_id, generate_subscripts(raws, 1) - 1 AS variant, unnest(raws) AS raw FROM forms)
SELECT page_id, variant, raw, CASE WHEN variant = 0 THEN raw ELSE 'http://' || ltrim(raw, '/') END AS url FROM ex"""

ORACLES["unresolvable_links"] = FORMS + " SELECT link, count(*) AS n FROM resolved WHERE dst IS NULL GROUP BY link"

# Headers -------------------------------------------------------------------

RESP = """
resp AS (
    SELECT page_id, url, html, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status,
        CASE page_id % 5 WHEN 0 THEN 'text/css; charset=utf-8' WHEN 1 THEN ' image/png ' WHEN 2 THEN ''
            ELSE 'text/html; charset=utf-8' END AS content_type,
        CASE page_id % 5 WHEN 0 THEN 'text/css' WHEN 1 THEN 'image/png' WHEN 2 THEN '' ELSE 'text/html' END AS mime,
        CASE WHEN page_id % 17 = 0 THEN -1 ELSE strlen(html) + CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END END AS declared,
        strlen(html) AS received,
        CASE WHEN page_id % 6 = 0 THEN 'f' || page_id || '.txt' END AS filename
    FROM pages)"""

ORACLES["header_get"] = f"""
WITH {RESP} SELECT page_id, content_type, coalesce('attachment; filename="' || filename || '"', '') AS disposition, '' AS absent FROM resp"""
ORACLES["mime_type"] = f"WITH {RESP} SELECT page_id, mime FROM resp"
ORACLES["content_length"] = f"WITH {RESP} SELECT page_id, declared AS declared_length FROM resp"
ORACLES["disposition_filename"] = f"WITH {RESP} SELECT page_id, filename FROM resp"
ORACLES["mime_extension"] = f"""
WITH {RESP} SELECT page_id, CASE mime WHEN 'text/css' THEN 'css' WHEN 'image/png' THEN 'png' ELSE 'html' END AS extension FROM resp"""
ORACLES["length_check"] = f"""
WITH {RESP} SELECT page_id, CASE WHEN declared < 0 THEN 'unchecked' WHEN received < declared THEN 'short'
    WHEN received > declared THEN 'long' ELSE 'ok' END AS "check" FROM resp"""
ORACLES["status_filter"] = f"WITH {RESP} SELECT page_id, url FROM resp WHERE status = 200"
ORACLES["mime_dispatch"] = f"""
WITH {RESP} SELECT page_id, CASE mime WHEN 'text/html' THEN 'html' WHEN 'text/css' THEN 'css' ELSE 'leaf' END AS branch FROM resp"""
ORACLES["save_path"] = f"""
WITH {RESP}, p AS (SELECT *, {HOST} AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM resp)
SELECT page_id, '/mirror/' || h || regexp_replace(path, '[^/]*$', '') || coalesce(filename,
    nullif(regexp_extract(path, '[^/]*$'), ''),
    'index.' || CASE mime WHEN 'text/css' THEN 'css' WHEN 'image/png' THEN 'png' ELSE 'html' END)
    AS save_path FROM p WHERE path <> '' AND path NOT LIKE '%/'
UNION ALL
SELECT page_id, '/mirror/' || h || path || CASE WHEN path = '' THEN '/' ELSE '' END || coalesce(filename,
    'index.' || CASE mime WHEN 'text/css' THEN 'css' WHEN 'image/png' THEN 'png' ELSE 'html' END)
    AS save_path FROM p WHERE path = '' OR path LIKE '%/'"""
ORACLES["status_report"] = f"""
WITH {RESP}, p AS (
    SELECT *, strftime(to_timestamp(page_id * 37 + 1700000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS stamp,
        {HOST} AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM resp),
q AS (
    SELECT *, h || CASE WHEN path LIKE '%/' OR path = '' THEN rtrim(path, '/') || '/' || coalesce(filename,
        'index.' || CASE mime WHEN 'text/css' THEN 'css' WHEN 'image/png' THEN 'png' ELSE 'html' END)
        ELSE regexp_replace(path, '[^/]*$', '') || coalesce(filename, regexp_extract(path, '[^/]*$')) END AS save FROM p)
SELECT page_id, 'start' AS kind, 'start at ' || stamp AS line FROM q
UNION ALL SELECT page_id, 'status', 'sending request, awaiting response... status '
    || CASE WHEN status = 200 THEN '200 OK' ELSE '404 Not Found' END FROM q
UNION ALL SELECT page_id, 'length', CASE WHEN declared < 0 THEN 'content size: unspecified [~--.- B]'
    ELSE 'content size: ' || declared || ' [~' || printf('%.2fMB', declared / 1000000.0::DOUBLE) || ']' END FROM q
UNION ALL SELECT page_id, 'file', 'saving file to: ' || save FROM q
UNION ALL SELECT page_id, 'finished', CASE WHEN status = 200 THEN 'Downloaded [' || url || '] finished at ' || stamp
    ELSE 'failed at ' || stamp END FROM q"""

# Extraction ----------------------------------------------------------------

ORACLES["attr_links"] = f"""
WITH l AS (SELECT page_id, {OWN} AS links FROM pages)
SELECT page_id, generate_subscripts(links, 1) - 1 AS pos, 'a' AS tag, unnest(links) AS link FROM l"""

DECO = f"""
deco AS (
    SELECT page_id, list_concat(list_concat(
        [{{'kind': 'style_element', 'tag': 'style', 'link': '/bg/' || page_id || '.png'}},
         {{'kind': 'style_element', 'tag': 'style', 'link': '/css/' || (page_id % 7) || '.css'}}],
        list_transform({OWN}, lambda u: {{'kind': 'attr', 'tag': 'a', 'link': u}})),
        [{{'kind': 'style_attr', 'tag': 'div', 'link': '/ad/' || (page_id % 13) || '.png'}},
         {{'kind': 'attr', 'tag': 'img', 'link': '/img/' || page_id || '.jpg'}}]) AS links FROM pages),
deco_links AS (SELECT page_id, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS l FROM deco)"""

ORACLES["html_links"] = f"""
WITH {DECO} SELECT page_id, pos, l.kind AS kind, l.tag AS tag, l.link AS link FROM deco_links"""
ORACLES["style_links"] = f"""
WITH {DECO} SELECT page_id, pos, l.link AS link FROM deco_links WHERE l.kind = 'style_element'"""
ORACLES["style_attr_links"] = f"""
WITH {DECO} SELECT page_id, l.tag AS tag, l.link AS link FROM deco_links WHERE l.kind = 'style_attr'"""

SHEET = f"""
nth AS (
    SELECT page_id, generate_subscripts(links, 1) - 1 AS i, unnest(links) AS link
    FROM (SELECT page_id, {OWN} AS links FROM pages))"""
ORACLES["css_urls"] = f"""
WITH {SHEET} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, link FROM nth WHERE i % 4 < 3"""
ORACLES["css_url_tokens"] = f"""
WITH {SHEET} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos,
    CASE i % 4 WHEN 0 THEN 'url("' || link || '")' WHEN 1 THEN 'url( ''' || link || ''' )' ELSE 'url(' || link || ')' END AS token
FROM nth WHERE i % 4 < 3"""
ORACLES["rewrite_css"] = f"""
WITH {SHEET} SELECT page_id, '/* url(/comment.png) */ ' || coalesce(rules, '') AS css FROM (SELECT page_id FROM pages)
LEFT JOIN (
    SELECT page_id, string_agg('.r' || i || CASE i % 4 WHEN 0 THEN '{{background:url("/m' || link || '")}}'
        WHEN 1 THEN '{{background:url( ''/m' || link || ''' )}}' WHEN 2 THEN '{{background:url(/m' || link || ')}}'
        ELSE '{{content:"url(''' || link || ''')"}}' END, chr(10) ORDER BY i) AS rules FROM nth GROUP BY page_id) USING (page_id)"""
ORACLES["rewrite_html"] = """
SELECT page_id, replace(replace(replace(html, '<a href="', '<a href="/m'), '<style>p{margin:0}</style>',
    '<style>p{margin:0;background:url(''/bg/' || page_id || '.png'')} /* url(no.png) */ @import url(/css/' || (page_id % 7) || '.css);</style>'),
    '<div class="ad">', '<div class="ad" style="background:url(&quot;/ad/' || (page_id % 13) || '.png&quot;)"><IMG alt=">" src=/img/'
    || page_id || '.jpg>') AS html FROM pages"""
ORACLES["links_per_page"] = f"""
SELECT url AS src, len(l) AS n_links, len(list_distinct(l)) AS n_distinct, array_to_string(l, ' ') AS links
FROM (SELECT url, {OWN} AS l FROM pages) WHERE len(l) > 0"""
ORACLES["relative_path"] = (
    SAVED
    + f""", both_paths AS (
    SELECT page_id, pos, string_split(h || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')[:-2] AS here,
        string_split(save_path, '/') AS there FROM saved),
common AS (
    SELECT *, len(list_filter(range(1, least(len(here), len(there)) + 1), lambda k: here[1:k] = there[1:k])) AS n FROM both_paths)
SELECT page_id, pos, coalesce(nullif(array_to_string(list_concat(list_transform(range(n, len(here)), lambda k: '..'),
    there[n + 1:]), '/'), ''), '.') AS relative FROM common"""
)

# Filters -------------------------------------------------------------------

BASE = "regexp_extract(rtrim(path, '/'), '[^/]*$')"
DIR = "coalesce(nullif(rtrim(regexp_replace(path, '[^/]*$', ''), '/'), ''), CASE WHEN path LIKE '/%' THEN '/' ELSE '.' END)"
REJECT_RE = "(.*ion)|(th.?r)|(.*en$)|(\\.html)"
EXCLUDE_RE = "(^/?/en.*)|(/f.*)"
PATHS = FORMS + f", paths AS (SELECT page_id, pos, dst, {DST_PATH} AS path FROM resolved WHERE dst IS NOT NULL)"
NAME = f"CASE WHEN path = '' THEN '.' WHEN rtrim(path, '/') = '' THEN '/' ELSE {BASE} END"

ORACLES["reject_filter"] = PATHS + f" SELECT page_id, pos, dst FROM paths WHERE regexp_matches({NAME}, '{REJECT_RE}')"
ORACLES["exclude_filter"] = PATHS + f" SELECT page_id, pos, dst FROM paths WHERE regexp_matches({DIR}, '{EXCLUDE_RE}')"
ORACLES["should_download"] = f"""
WITH {RESP}, p AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM resp),
k AS (SELECT *, NOT (regexp_matches({NAME}, '{REJECT_RE}') OR regexp_matches({DIR}, '{EXCLUDE_RE}')) AS keep FROM p)
SELECT page_id, mime = 'text/html' OR keep AS wanted, mime = 'text/html' OR (mime = 'text/css' AND keep) AS traverse, keep FROM k"""

_GLOBS = [
    ("*ion", ".*ion", ".*ion"), ("th?r", "th.?r", "th.?r"), ("en", ".*en$", "^/?en.*"), (".html", "\\.html", "\\.html"),
    ("/en", ".*/en$", "^/?/en.*"), ("/f*", "/f.*", "/f.*"), ("[0-4]*", "[0-4].*", "[0-4].*"), ("", ".*$", "^/?.*"),
]
ORACLES["glob_compile"] = (
    f"WITH p AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages) "
    + " UNION ALL ".join(
        f"SELECT '{g}' AS pattern, {str(rej).lower()} AS is_reject, '{rx}' AS regex, "
        f"count_if(regexp_matches({NAME if rej else DIR}, '{rx}'))::BIGINT AS n_matches FROM p"
        for g, r, x in _GLOBS
        for rej, rx in ((True, r), (False, x))
    )
)

# Crawl ---------------------------------------------------------------------


def site(rejected: str = "false", seed: str = "min(page_id)", seeds: str = "") -> str:
    """CTEs of the linked site: nodes, links with targets, and reached URLs.

    The walk keeps one row for each seed and URL, the one it met first, so it ends by itself at any depth.
    """
    return f"""
WITH RECURSIVE num AS (
    SELECT page_id, h, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n, html FROM (SELECT *, {HOST} AS h FROM pages)),
nodes AS (
    SELECT h, n, 'http://' || h || '/p/' || n AS url, CASE WHEN n % 7 = 0 THEN 404 ELSE 200 END AS status, 'text/html' AS mime,
        n::VARCHAR AS name FROM num
    UNION ALL SELECT h, n, 'http://' || h || '/s/' || n || '.css', 200, CASE WHEN n % 4 = 0 THEN 'image/png' ELSE 'text/css' END,
        n || '.css' FROM num
    UNION ALL SELECT h, n, 'http://' || h || '/i/' || n || '.png', 200, 'image/png', n || '.png' FROM num),
res AS (
    SELECT url, status, mime, NOT ({rejected}) AS keep,
        CASE WHEN mime <> 'text/html' AND ({rejected}) THEN 'skipped' WHEN status <> 200 THEN 'bad_status' END AS error FROM nodes),
page_links AS (
    SELECT 'http://' || h || '/p/' || n AS src, h, list_concat(['/s/' || n || '.css', '/p/' || (2 * n), '/p/' || (2 * n + 1), '/p/1',
        '/p/' || (2 * n), 'http://other.example.org/x', 'mailto:x@' || h], {OWN}) AS links FROM num),
css_links AS (SELECT 'http://' || h || '/s/' || n || '.css' AS src, h, ['/i/' || n || '.png', '/s/' || (n + 1) || '.css'] AS links FROM num),
all_links AS (
    SELECT src, h, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS link FROM page_links
    UNION ALL SELECT src, h, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS link FROM css_links),
links AS (
    SELECT src, pos, link, CASE WHEN link LIKE 'mailto:%' THEN NULL WHEN link LIKE 'http:%' THEN link
        ELSE 'http://' || h || {enc("link")} END AS dst, link LIKE '/%' AS same FROM all_links),
followed AS (
    SELECT l.* FROM links l JOIN res ON l.src = res.url WHERE res.error IS NULL AND res.mime IN ('text/html', 'text/css')
        AND (res.mime = 'text/html' OR res.keep)),
edges AS (SELECT DISTINCT src, dst FROM followed WHERE same),
seeds AS (SELECT {seed} AS seed_id, 'http://' || h || '/p/1' AS url FROM num GROUP BY h {seeds}),
walk(seed_id, url, depth) USING KEY (seed_id, url) AS (
    SELECT seed_id, url, 0::BIGINT FROM seeds
    UNION SELECT w.seed_id, e.dst, min(w.depth) + 1 FROM walk w JOIN edges e ON w.url = e.src
        LEFT JOIN recurring.walk r ON r.seed_id = w.seed_id AND r.url = e.dst WHERE r.url IS NULL GROUP BY w.seed_id, e.dst),
reached AS (SELECT seed_id, url, depth FROM walk),
results AS (
    SELECT r.*, res.status, res.mime, res.keep, CASE WHEN res.url IS NULL THEN 'not_found' ELSE res.error END AS error
    FROM reached r LEFT JOIN res USING (url))"""


SITE = site()
SITE_REJECTED = site("contains(name, '5') OR contains(name, '.png')")

ORACLES["same_host_edges"] = SITE + " SELECT src, pos, dst FROM links WHERE same AND src LIKE '%/p/%'"
ORACLES["fetch_join"] = (
    SITE
    + """ SELECT f.dst AS url, n.status::BIGINT AS status, CASE WHEN n.url IS NULL THEN 'not_found'
    WHEN n.status <> 200 THEN 'bad_status' END AS error
FROM (SELECT DISTINCT dst FROM links WHERE same AND src LIKE '%/p/%') f LEFT JOIN nodes n ON f.dst = n.url"""
)
ORACLES["mirror_closure"] = SITE + " SELECT seed_id, url, depth FROM reached"
ORACLES["mirror_depth"] = SITE + " SELECT depth, count(*) AS n_urls FROM reached GROUP BY depth"
ORACLES["multi_seed_mirror"] = (
    site(seed="min(page_id) * 2", seeds="UNION ALL SELECT min(page_id) * 2 + 1, 'http://' || h || '/p/2' FROM num GROUP BY h")
    + """ SELECT seed_id, count(*) AS n_requested, count_if(error IS NULL)::BIGINT AS n_ok, max(depth) AS max_depth
FROM results GROUP BY seed_id"""
)
ORACLES["link_status"] = (
    SITE
    + """ SELECT f.src, f.pos, f.dst, r.status::BIGINT AS status, r.error FROM followed f
LEFT JOIN results r ON f.dst = r.url WHERE f.same"""
)
ORACLES["discovery_parent"] = (
    SITE
    + """, cand AS (
    SELECT r.seed_id, r.url, r.depth, f.src, f.pos, row_number() OVER (PARTITION BY r.seed_id, r.url ORDER BY f.src, f.pos) AS k
    FROM reached r JOIN followed f ON f.dst = r.url AND f.same
    JOIN reached s ON s.seed_id = r.seed_id AND s.url = f.src AND s.depth = r.depth - 1)
SELECT seed_id, url, depth, src AS parent, pos FROM cand WHERE k = 1"""
)
ORACLES["kept_pages"] = SITE_REJECTED + " SELECT seed_id, url, mime FROM results WHERE error IS NULL AND keep"
ORACLES["link_outcomes"] = (
    SITE_REJECTED
    + """, met AS (
    SELECT r.seed_id, CASE WHEN f.dst IS NULL THEN 'unresolvable' WHEN NOT f.same THEN 'off_host' END AS dropped, t.depth,
        CASE WHEN t.error IS NOT NULL THEN t.error WHEN NOT t.keep THEN 'rejected' ELSE 'saved' END AS state,
        row_number() OVER (PARTITION BY r.seed_id, f.dst ORDER BY f.src, f.pos) AS k
    FROM reached r JOIN followed f ON r.url = f.src
    LEFT JOIN results t ON t.seed_id = r.seed_id AND t.url = f.dst)
SELECT seed_id, CASE WHEN dropped IS NOT NULL THEN dropped WHEN k = 1 AND depth > 0 THEN state ELSE 'visited' END AS outcome,
    count(*) AS n_links FROM met GROUP BY ALL"""
)
PATH = "regexp_replace(url, '^http://', '')"
ORACLES["mirror_manifest"] = (
    SITE
    + f""" SELECT url, '/mirror/' || {PATH} AS save_path, status::BIGINT AS status, mime, false AS escapes_root
FROM results WHERE error IS NULL"""
)
ORACLES["convert_links_css"] = (
    SITE
    + f""" SELECT r.url, {PATH.replace("url", "r.url")} AS save_path, 'a{{b:url(''../i/' || n || '.png'')}} c{{d:url(' ||
    CASE WHEN x.url IS NOT NULL THEN (n + 1) || '.css' ELSE '/s/' || (n + 1) || '.css' END || ')}}' AS body
FROM results r JOIN nodes USING (url) LEFT JOIN (SELECT url FROM results WHERE error IS NULL) x
    ON x.url = 'http://' || h || '/s/' || (n + 1) || '.css'
WHERE r.error IS NULL AND r.mime = 'text/css'"""
)
ORACLES["convert_links_html"] = (
    SITE
    + f""", ok AS (SELECT url FROM results WHERE error IS NULL),
p AS (
    SELECT r.url, num.h, num.n, num.html, EXISTS (SELECT 1 FROM ok WHERE ok.url = 'http://' || num.h || '/p/' || (2 * num.n)) AS l,
        EXISTS (SELECT 1 FROM ok WHERE ok.url = 'http://' || num.h || '/p/' || (2 * num.n + 1)) AS rt
    FROM results r JOIN num ON r.url = 'http://' || num.h || '/p/' || num.n WHERE r.error IS NULL)
SELECT url, {PATH} AS save_path, md5('<link rel="stylesheet" href="../s/' || n || '.css"><a href="'
    || CASE WHEN l THEN '' ELSE '/p/' END || (2 * n) || '">l</a><a href="' || CASE WHEN rt THEN '' ELSE '/p/' END || (2 * n + 1)
    || '">r</a><a href="1">up</a><a href="' || CASE WHEN l THEN '' ELSE '/p/' END || (2 * n)
    || '">l again</a><a href="http://other.example.org/x">off</a><a href="mailto:x@' || h || '">mail</a>' || html) AS body_md5 FROM p"""
)
ORACLES["saved_site"] = (
    ORACLES["convert_links_html"]
    + " UNION ALL SELECT url, save_path, md5(body) FROM ("
    + ORACLES["convert_links_css"].removeprefix(SITE)
    + f") UNION ALL SELECT url, {PATH}, md5(CASE WHEN url LIKE '%.css' THEN 'a{{b:url(''/i/' || n || '.png'')}} c{{d:url(/s/' || (n + 1) || '.css)}}' ELSE 'png' END)"
    + " FROM results JOIN nodes USING (url) WHERE results.error IS NULL AND results.mime = 'image/png'"
)
ORACLES["latest_responses"] = f"""
WITH {RESP}, crawls AS (
    SELECT url, page_id, html, unnest(list_filter([0, CASE WHEN page_id % 3 = 0 THEN 1 END, CASE WHEN page_id % 4 = 1 THEN 2 END],
        lambda c: c IS NOT NULL))::BIGINT AS crawl FROM resp)
SELECT url, crawl, page_id, md5('<!-- ' || crawl || ' -->' || html) AS body_md5 FROM crawls
QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl DESC, page_id DESC) = 1"""
ORACLES["redirects"] = f"""
WITH RECURSIVE num AS (
    SELECT h, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n FROM (SELECT *, {HOST} AS h FROM pages)),
hop AS (
    SELECT h, n, CASE WHEN n % 3 = 0 THEN n // 3 WHEN n % 10 = 5 THEN n + 5 WHEN n % 10 = 0 THEN n - 5 WHEN n % 2 = 1 THEN n + 6 END AS t FROM num),
hops AS (SELECT * FROM hop WHERE t IS NOT NULL),
walk(h, n, goal, k) AS (
    SELECT h, n, t, 1::BIGINT FROM hops
    UNION ALL SELECT w.h, w.n, x.t, w.k + 1 FROM walk w JOIN hops x ON x.h = w.h AND x.n = w.goal WHERE w.k <= 10),
ended AS (SELECT w.* FROM walk w LEFT JOIN hops x ON x.h = w.h AND x.n = w.goal WHERE x.n IS NULL AND w.k <= 10)
SELECT 'http://' || o.h || '/p/' || o.n AS url, 'http://' || e.h || '/p/' || e.goal AS final_url, e.k AS n_hops,
    CASE WHEN e.n IS NULL THEN 'too_many_redirects' END AS error FROM hops o LEFT JOIN ended e USING (h, n)"""
ORACLES["binary_scan"] = f"""
WITH p AS (SELECT page_id, {HOST} AS h, html FROM pages),
f AS (SELECT h, string_agg(html || chr(10), '' ORDER BY page_id) AS body FROM p GROUP BY h)
SELECT 'http://' || h || '/' AS url, 'text/html' AS mime, 'utf-8' AS charset, strlen(body) AS body_length, md5(body) AS body_md5 FROM f"""
ORACLES["frontier_dedup"] = (
    FORMS
    + """, c AS (SELECT page_id, page_id % 5 AS seed_id, dst AS url FROM resolved WHERE dst IS NOT NULL)
SELECT DISTINCT seed_id, url FROM c WHERE page_id % 3 <> 0
EXCEPT SELECT seed_id, url FROM c WHERE page_id % 3 = 0"""
)

# Downloads and paths -------------------------------------------------------

DOWN = f"""
WITH {RESP}, asked AS (
    SELECT url FROM pages UNION ALL SELECT CASE WHEN page_id % 3 = 0 THEN url ELSE url || '/none' END FROM pages
    WHERE page_id % 3 = 0 OR page_id % 10 = 1),
done AS (
    SELECT a.url, CASE WHEN r.url IS NULL THEN 'not_found' WHEN r.status <> 200 THEN 'bad_status'
        WHEN r.declared >= 0 AND r.received < r.declared THEN 'short_body' ELSE 'success' END AS outcome
    FROM asked a LEFT JOIN resp r USING (url))"""
ORACLES["success_list"] = DOWN + " SELECT url, count(*) AS n FROM done WHERE outcome = 'success' GROUP BY url"
ORACLES["download_outcomes"] = DOWN + " SELECT outcome, count(*) AS n_urls FROM done GROUP BY outcome"

LAST = "regexp_extract({}, '[^/]*$')"
ORACLES["output_path"] = f"""
SELECT page_id, {LAST.format("url")} AS name, '/d' || CASE WHEN url LIKE '%/' THEN '' ELSE '/' || {LAST.format("url")} END AS path FROM pages"""
ORACLES["unique_names"] = (
    FORMS
    + f""", names AS (SELECT page_id, pos, {LAST.format("dst")} AS name FROM resolved WHERE dst IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id, pos) - 1 AS k FROM names)
SELECT page_id, pos, name, CASE WHEN k = 0 OR name = '' THEN name
    ELSE regexp_replace(name, '\\.[^.]*$', '') || '(' || k || ')' || regexp_extract(name, '\\.[^.]*$') END AS unique_name FROM ranked"""
)
ORACLES["path_ancestors"] = (
    SAVED
    + """, parts2 AS (SELECT string_split(save_path, '/') AS a FROM saved),
dirs AS (SELECT unnest(list_transform(range(1, len(a)), lambda k: array_to_string(a[1:k], '/'))) AS dir FROM parts2)
SELECT dir, count(*) AS n_files FROM dirs GROUP BY dir"""
)
ORACLES["clean_path"] = (
    PATHS
    + f""" SELECT page_id, pos, coalesce(nullif(rtrim(path, '/'), ''), '/') AS rooted, '../..' || rtrim(path, '/') AS relative,
    {DIR} AS dir, {NAME} AS base FROM (
        SELECT page_id, pos, path FROM paths)"""
)
ORACLES["path_collisions"] = (
    SAVED
    + """ SELECT save_path, arg_max(dst, (page_id, pos)) AS url, count(*) AS n_urls FROM saved GROUP BY save_path HAVING count(*) > 1"""
)
ORACLES["dir_conflicts"] = (
    SAVED
    + """, files AS (SELECT DISTINCT save_path FROM saved)
SELECT save_path AS raw_path, save_path || CASE WHEN EXISTS (SELECT 1 FROM files g WHERE starts_with(g.save_path, f.save_path || '/'))
    THEN '/index.html' ELSE '' END AS save_path FROM files f"""
)

# Transfers and sizes -------------------------------------------------------

TR = "tr AS (SELECT user_id AS transfer_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS bytes, event_type AS kind FROM events)"
RUN = f"""
WITH {TR}, run AS (
    SELECT *, CAST(sum(bytes) OVER (PARTITION BY transfer_id ORDER BY ts, event_id) AS BIGINT) AS downloaded,
        CASE WHEN transfer_id % 7 = 0 THEN -1 ELSE CAST(sum(bytes) OVER (PARTITION BY transfer_id) AS BIGINT) END AS total FROM tr)"""
TICKS = f"""
WITH {TR}, ticks AS (
    SELECT transfer_id, date_trunc('second', ts) AS second, CAST(sum(bytes) AS BIGINT) AS rate FROM tr GROUP BY ALL)"""
AVG = """, folded AS (
    SELECT transfer_id, list_reduce(list({'a': rate, 'n': 1::BIGINT} ORDER BY second) FILTER (rate > 0),
        lambda x, y: {'a': CAST(trunc((x.a::DOUBLE * x.n + y.a) / (x.n + 1)) AS BIGINT), 'n': x.n + 1}) AS f
    FROM ticks GROUP BY transfer_id)"""

SIZE = """CASE WHEN {n} >= 1073741824 THEN printf('%.2f GiB', {n} / 1073741824.0::DOUBLE)
    WHEN {n} >= 1048576 THEN printf('%.2f MiB', {n} / 1048576.0::DOUBLE)
    WHEN {n} >= 1024 THEN printf('%.2f KiB', {n} / 1024.0::DOUBLE) WHEN {n} < 0 THEN '--.- B' ELSE {n} || ' B' END"""
DURATION = """(CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h' ELSE '' END || CASE WHEN {s} >= 60 THEN ({s} % 3600 // 60) || 'm' ELSE '' END
    || ({s} % 60) || 's')"""

BODY_SIZE = f"""size AS (
    SELECT 'http://' || h || '/p/' || n AS url, strlen('<link rel="stylesheet" href="/s/' || n || '.css"><a href="/p/' || (2 * n) || '">l</a><a href="/p/'
        || (2 * n + 1) || '">r</a><a href="/p/1">up</a><a href="/p/' || (2 * n) || '">l again</a><a href="http://other.example.org/x">off</a>'
        || '<a href="mailto:x@' || h || '">mail</a>' || html) AS b FROM num
    UNION ALL SELECT 'http://' || h || '/s/' || n || '.css', strlen('a{{b:url(''/i/' || n || '.png'')}} c{{d:url(/s/' || (n + 1) || '.css)}}') FROM num
    UNION ALL SELECT 'http://' || h || '/i/' || n || '.png', 3 FROM num)"""
ORACLES["mirror_summary"] = (
    SITE
    + f""", {BODY_SIZE},
t AS (
    SELECT count(*) AS files, coalesce(sum(b) FILTER (error IS NULL), 0)::BIGINT AS bytes, (max(depth) - min(depth)) * 60 AS seconds
    FROM results LEFT JOIN size USING (url))
SELECT files, bytes, seconds, {SIZE.format(n="bytes")} AS size_text FROM t"""
)
ORACLES["mirror_schedule"] = (
    SITE
    + f""", {BODY_SIZE},
run AS (
    SELECT seed_id, url, sum(CASE WHEN error IS NULL THEN b ELSE 0 END) OVER (PARTITION BY seed_id ORDER BY depth, url) AS done
    FROM results LEFT JOIN size USING (url))
SELECT seed_id, url, greatest((done - 1) // 50000, 0)::BIGINT AS done_second FROM run"""
)
ORACLES["dangling_links"] = (
    SITE_REJECTED
    + """ SELECT f.src, f.pos, f.link, f.dst FROM followed f
WHERE f.same AND f.dst IN (SELECT url FROM results WHERE error IS NULL AND NOT keep)"""
)
ORACLES["running_bytes"] = RUN + " SELECT transfer_id, event_id, downloaded FROM run"
ORACLES["percent_complete"] = (
    RUN
    + """ SELECT event_id, CASE WHEN total <= 0 THEN '--.-%' ELSE printf('%.2f', (downloaded * 100)::DOUBLE / total::DOUBLE) || '%' END AS percent FROM run"""
)
ORACLES["eta"] = (
    RUN
    + f""", r AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(bytes // 1000, 1) END AS rate FROM run),
l AS (SELECT *, CASE WHEN rate > 0 THEN CAST(trunc((total - downloaded)::DOUBLE / rate) AS BIGINT) END AS left_s FROM r)
SELECT event_id, CASE WHEN downloaded = 0 OR total < 0 OR rate = 0 THEN chr(128347) ELSE {DURATION.format(s="left_s")} END AS eta FROM l"""
)
ORACLES["rate_per_second"] = TICKS + " SELECT transfer_id, strftime(second, '%Y-%m-%d %H:%M:%S') AS second, rate FROM ticks"
ORACLES["rate_ticks"] = f"""
WITH {TR}, had AS (SELECT transfer_id, date_trunc('hour', ts) AS hour, sum(bytes)::BIGINT AS rate FROM tr GROUP BY ALL),
span AS (SELECT transfer_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM had GROUP BY transfer_id)
SELECT transfer_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(rate, 0) AS rate FROM span LEFT JOIN had USING (transfer_id, hour)"""
ORACLES["avg_rate"] = TICKS + AVG + " SELECT transfer_id, f.n AS n, f.a AS avg_rate FROM folded WHERE f IS NOT NULL"
ORACLES["final_status"] = (
    TICKS
    + AVG
    + """, last AS (
    SELECT transfer_id, arg_max(kind, (ts, event_id)) = 'error' AS failed, CAST(sum(bytes) AS BIGINT) AS downloaded,
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM tr GROUP BY transfer_id)
SELECT transfer_id, failed, downloaded, CASE WHEN transfer_id % 7 <> 0 THEN transfer_id * 1000 WHEN failed THEN -1 ELSE downloaded END AS total, seconds,
    coalesce(nullif(f.a, 0), downloaded) AS avg_rate FROM last LEFT JOIN folded USING (transfer_id)"""
)
ORACLES["throttle_schedule"] = RUN + " SELECT event_id, greatest((downloaded - 1) // 5000, 0) AS done_second FROM run"
ORACLES["content_hash"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"
ORACLES["parse_rate"] = """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(l_quantity AS BIGINT) * CASE (l_orderkey + l_linenumber) % 5
    WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 0 ELSE 1 END AS rate FROM lineitem"""
SIZED = """
WITH s AS (
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey * 7 + l_linenumber AS i, l_extendedprice AS p FROM lineitem),
z AS (
    SELECT l_orderkey, l_linenumber, CASE WHEN i % 50 = 0 THEN -1 ELSE CAST(floor(p * CASE i % 4 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 1
        WHEN 2 THEN 300 ELSE 90000 END) AS BIGINT) END AS n FROM s)"""
ORACLES["format_size"] = SIZED + f" SELECT l_orderkey, l_linenumber, {SIZE.format(n='n')} AS size FROM z"
ORACLES["round_bytes"] = (
    SIZED
    + """ SELECT l_orderkey, l_linenumber, CASE WHEN n < 1000000000 THEN printf('%.2fMB', n / 1000000.0::DOUBLE)
    ELSE printf('%.2fGB', n / 1000000000.0::DOUBLE) END AS size FROM z"""
)
ORACLES["format_time"] = f"""
WITH t AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) % 100000 AS s FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {DURATION.format(s="s")} AS since FROM t"""

# Streams -------------------------------------------------------------------

ORACLES["stream_links"] = PLAIN + " SELECT url AS src, pos, link, dst FROM resolved"
ORACLES["stream_visited"] = PLAIN + " SELECT DISTINCT h AS site, dst AS url FROM resolved WHERE dst IS NOT NULL"
ORACLES["stream_rate"] = (
    TICKS
    + """ SELECT transfer_id, strftime(second, '%Y-%m-%d %H:%M:%S') AS second, rate FROM ticks"""
)
ORACLES["stream_status"] = f"""
WITH {TR}, msg AS (
    SELECT * REPLACE (CASE kind WHEN 'signup' THEN 'start' WHEN 'view' THEN 'length' WHEN 'click' THEN 'progress'
        WHEN 'purchase' THEN 'finished' ELSE 'failed' END AS kind) FROM tr),
mark AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS now FROM msg),
seen AS (SELECT *, epoch_us(ts) AS us FROM msg, mark WHERE epoch_us(ts) <= now),
cut AS (
    SELECT *, CASE WHEN lag(us) OVER o IS NULL OR us - lag(us) OVER o > 86400000000 THEN 'gap'
        WHEN lag(kind) OVER o IN ('finished', 'failed') THEN 'next' WHEN kind = 'start' THEN 'again' END AS opens
    FROM seen WINDOW o AS (PARTITION BY transfer_id ORDER BY ts, event_id)),
part AS (
    SELECT *, count(opens) OVER (PARTITION BY transfer_id ORDER BY ts, event_id) AS attempt FROM cut),
tick AS (
    SELECT transfer_id, attempt, us // 1000000 AS second, sum(bytes)::BIGINT AS rate FROM part WHERE kind = 'progress' GROUP BY ALL),
mean AS (
    SELECT transfer_id, attempt, list_reduce(list({{'a': rate, 'n': 1::BIGINT}} ORDER BY second) FILTER (rate > 0),
        lambda x, y: {{'a': CAST(trunc((x.a::DOUBLE * x.n + y.a) / (x.n + 1)) AS BIGINT), 'n': x.n + 1}}) AS f
    FROM tick GROUP BY ALL),
whole AS (
    SELECT transfer_id, attempt, min(us) AS a, max(us) AS b, any_value(now) AS now, arg_max(kind, (ts, event_id)) AS last_kind,
        arg_min(opens, (ts, event_id)) AS opened,
        coalesce(arg_max(bytes, (ts, event_id)) FILTER (kind = 'length'), -1)::BIGINT AS told,
        coalesce(sum(bytes) FILTER (kind = 'progress'), 0)::BIGINT AS downloaded
    FROM part GROUP BY ALL),
next AS (SELECT *, lead(opened) OVER (PARTITION BY transfer_id ORDER BY attempt) AS after FROM whole)
SELECT transfer_id, strftime(make_timestamp(a), '%Y-%m-%d %H:%M:%S') AS started, strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S') AS ended,
    CASE WHEN last_kind IN ('finished', 'failed') THEN last_kind WHEN after = 'again' THEN 'abandoned'
        WHEN after = 'gap' OR now - b > 86400000000 THEN 'stalled' ELSE last_kind END AS phase,
    CASE WHEN last_kind = 'finished' AND told = -1 THEN downloaded ELSE told END AS total, downloaded, coalesce(f.n, 0) AS n,
    CASE WHEN last_kind = 'finished' AND coalesce(f.a, 0) = 0 THEN downloaded ELSE coalesce(f.a, 0) END AS avg_rate,
    (b - a) // 1000000 AS seconds
FROM next LEFT JOIN mean USING (transfer_id, attempt)"""
ORACLES["stream_admission"] = "SELECT page_id, url, strlen(html) AS n_bytes FROM pages"
