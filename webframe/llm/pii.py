"""Personal data: fixed patterns, and further identifiers by bootstrapped contextual extraction.

Four kinds are found by expression. Their spans seed a bootstrap: each of them, and
each other thing that looks like an identifier, has a lexical pattern, the two words
before it, however far. Patterns and values form a graph. Round by round a pattern scores the mean score
of its values and a value a share of the score of its best pattern, seeds staying at 1, until the scores have settled;
the share keeps a pattern from raising itself by its own values. Patterns
that end above a threshold and hold enough different seeds are trusted, and
values that stand behind them, but are no seeds, are reported as kind "id". These
are seeds of the next generation, which starts again from all seeds, until no
pattern is added. All of it is DataFrame expressions; the graph is joined and aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions.common import let, with_once
from webframe.llm.common import Scratch

#: The kinds in their order. Repeats are possessive where nothing can follow, and a run in which a match
#: failed is not tried from its later places; both find the same, in linear time.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match for a kind to be looked for; cheap, and matched by every text with a valid find.
_GATES = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
#: Something that looks like an identifier: a run of at least six letters, digits, "_" and "-" with a digit.
IDENTIFIER = r"(?<![\p{L}0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
LEAST_LENGTH, TRUST, LEAST_SEEDS = 6, 0.8, 5
#: Share of its best pattern's score that a value gets. Scores only rise, and have settled when those of the values rise
#: by no more than SETTLED in a round on average.
SHARE, SETTLED = 0.8, 1e-4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]++", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the right every second doubled, sum to a multiple of ten."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    digit = lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(at, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _places(text: Column, expression: str) -> Column:
    """(start, end, value, before) of the leftmost non-overlapping matches; ``before`` is the text since the last one."""
    pieces = {"m": F.regexp_extract_all(text, F.lit(expression), F.lit(0)), "b": F.split(text, expression, -1)}

    def build(p: Column) -> Column:
        sizes = F.transform(p["m"], lambda m, i: F.length(F.get(p["b"], i)) + F.length(m))
        none = F.expr("cast(array() as array<int>)")
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["ends"], acc["at"] + n).alias("ends"))
        ends = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("ends")), step, lambda acc: acc["ends"])
        one = lambda m, end, b: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), b.alias("before"))
        return let(
            ends,
            lambda e: F.transform(p["m"], lambda m, i: one(m, F.get(e, i), F.get(p["b"], i))),
        )

    return let(pieces, build)


_SPAN = "array<struct<start:int,end:int,value:string,pattern:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _with_pattern(found: Column) -> Column:
    """(start, end, value, pattern) of places; the pattern is the last two words before a place."""
    words = r"(\p{L}++[^\p{L}]++\p{L}++|^[^\p{L}]*+\p{L}++)[^\p{L}]*+$"
    pattern = lambda x: F.regexp_extract(x["before"], words, 1)
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["value"], pattern(x).alias("pattern")))


def _spans(text: Column, kind: str) -> Column:
    """The valid finds of a kind."""
    found = F.filter(_places(text, KINDS[kind]), lambda x: _valid(kind, x["value"]))
    return F.when(text.rlike(_GATES[kind]), _with_pattern(found)).otherwise(_none())


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _identifiers(text: Column) -> Column:
    """What looks like an identifier."""
    found = F.filter(_places(text, IDENTIFIER), lambda x: F.length(x["value"]) >= LEAST_LENGTH)
    return F.when(text.rlike("[0-9]"), _with_pattern(found))


def trusted_patterns(
    occurrences: DataFrame, scratch: Scratch, settled: float = SETTLED, trust: float = TRUST, least_seeds: int = LEAST_SEEDS
) -> DataFrame:
    """(pattern, score, seeds) of the patterns that end with a score of ``trust`` and hold ``least_seeds`` seed values.

    Values behind a trusted pattern are seeds of the next generation; the last one adds no pattern. Trusted patterns stay
    trusted, as more seeds lower no score, so there are at most as many generations as trusted patterns, and one more.
    """
    edges = occurrences.where("pattern != ''").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges, generation, known = scratch.save(edges, "edges-0"), 0, 0
    while True:
        found = scratch.save(_generation(edges, scratch, generation, settled, trust, least_seeds), f"trusted-{generation}")
        n = found.count()
        if n == known:
            return found
        known, generation = n, generation + 1
        behind = edges.join(found, "pattern", "left_semi").select("value").distinct().withColumn("behind", F.lit(True))
        seed = (F.col("seed") | F.col("behind").isNotNull()).alias("seed")
        edges = scratch.save(edges.join(behind, "value", "left").select("pattern", "value", seed), f"edges-{generation}")
        scratch.drop(f"edges-{generation - 1}")


def _generation(
    edges: DataFrame, scratch: Scratch, generation: int, settled: float, trust: float, least_seeds: int
) -> DataFrame:
    values = edges.groupBy("value").agg(F.max("seed").cast("double").alias("v"))
    total, k = values.agg(F.avg("v")).first()[0] or 0.0, 0
    while True:
        patterns = edges.join(values, "value").groupBy("pattern").agg(
            (F.sum("v") / F.count(F.lit(1))).alias("p"), F.count_if("seed").alias("seeds")
        )
        patterns = scratch.save(patterns, f"patterns-{generation}-{k}")
        own = F.when(F.col("seeds") >= least_seeds, SHARE * F.col("p")).otherwise(0.0)
        best = edges.join(patterns, "pattern").groupBy("value").agg(
            F.greatest(F.max("seed").cast("double"), F.max(own)).alias("v")
        )
        values = scratch.save(best, f"values-{generation}-{k}")
        before, total, k = total, values.agg(F.avg("v")).first()[0] or 0.0, k + 1
        if total - before <= settled:
            return patterns.where((F.col("p") >= trust) & (F.col("seeds") >= least_seeds)).select(
                "pattern", F.col("p").alias("score"), "seeds"
            )


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = TRUST, least_seeds: int = LEAST_SEEDS
) -> DataFrame:
    """One row per input row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``.

    Spans are "kind:start:end" in code points, end exclusive, by kind in the order of KINDS and "id" last, then by
    start, joined with commas; ``base_sha256`` is the digest of those of the four kinds. Matches of a kind are leftmost
    and do not overlap; one that is not valid is dropped and its text not tried again. Null and empty texts have no
    spans. Repeated rows are found in like any other; in the graph only distinct pairs of pattern and value count.
    Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "personal-data")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    found = with_once(texts, **{kind: _spans(F.col("text"), kind) for kind in KINDS})
    base = F.flatten(F.array(*[F.col(kind) for kind in KINDS]))
    noted = F.array_join(F.flatten(F.array(*[_written(kind, F.col(kind)) for kind in KINDS])), ",")
    rows = with_once(found, written=noted, base=base, found=_identifiers(F.col("text")))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    rows = scratch.save(rows.select("id", "text_key", *counts, "written", "base", "found"), "rows")
    apart = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    key = ["id", "text_key", "start", "end", "value", "pattern"]
    seeds = rows.select("id", "text_key", F.inline("base")).select(*key, F.lit(True).alias("seed"))
    others = rows.select("id", "text_key", "base", F.inline("found")).where(apart).select(*key, F.lit(False).alias("seed"))
    pattern = F.regexp_replace(F.lower("pattern"), r"[^\p{L}]++", " ")
    seen = seeds.unionByName(others).withColumn("pattern", pattern)
    patterns = trusted_patterns(seen, scratch, trust=trust, least_seeds=least_seeds)
    more = seen.where(~F.col("seed")).join(patterns, "pattern", "left_semi").select("id", "text_key", "start", "end").distinct()
    place = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("more")
    more = more.groupBy(F.col("id").alias("mid"), F.col("text_key").alias("mkey")).agg(place)
    out = rows.join(more, F.col("id").eqNullSafe(F.col("mid")) & (F.col("text_key") == F.col("mkey")), "left")
    added = F.array_join(_written("id", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,end:int>>)"))), ",")
    spans = F.concat_ws(",", F.nullif("written", F.lit("")), F.nullif(added, F.lit("")))
    return out.select(
        F.col("id").alias(id_col), *[f"n_{kind}" for kind in KINDS], F.sha2("written", 256).alias("base_sha256"), spans.alias("spans")
    )
