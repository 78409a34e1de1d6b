"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: lower-case words, with numbers, units
after numbers and names (capitalised words inside a sentence, neighbouring ones as
one) replaced by typed placeholders. Every window of WIDTH tokens of a document is
looked up among the windows of the benchmark items by hash, so that WIDTH common
tokens in a row are found wherever they lie. Windows that no item may have are
sorted out first, by a bitmap of fixed size. Items with hardly any word of their own are looked up by their raw words.

A hit fixes how item and document are aligned. The aligned tokens are compared
in full; alignments of one item that are shifted against each other by a few tokens, as
by an inserted word, are taken together, each token of the item counting once. The values behind the
placeholders are paired up: a question whose numbers or names were exchanged has one new value for each
old one. All of it is DataFrame expressions; the document text is read once to find hits and once for
the documents that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions.common import let
from webframe.llm.common import Scratch

#: Tokens of a window, and the fewest literal (not placeholder) tokens in an item that is looked up by its template.
WIDTH, LITERALS = 6, 3
#: A pair counts when so many aligned tokens agree, or that share of the item.
LEAST_TOKENS, LEAST_SHARE = 13, 0.75
#: Items shorter than LEAST_ITEM are too short to be evidence; those shorter than WHOLE must agree but for one token
#: outside a window, and those that are shorter than a window must be there as a whole.
LEAST_ITEM, WHOLE = 4, 2 * WIDTH - 1
#: Alignments of one item that lie so many tokens apart are one passage.
SHIFT = 3
#: Bits of the bitmap of windows, in words of 64: at most 2^(BITMAP_BITS - 6) rows of 16 bytes.
BITMAP_BITS = 24
NAME, NUMBER, UNIT, JOINED = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = (
    "kg g mg km m cm mm mi ft in lb lbs oz l ml s sec seconds min minutes h hours days weeks months years "
    "percent dollars euros usd eur cents meters metres miles degrees"
).split()


def marked(text: Column) -> Column:
    """Tokens of a text: lower-case words, those that a placeholder stands for with it in front."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{NUMBER}{UNIT}{JOINED}]", " ")
    # Numbers without separators, and apart from letters that follow them.
    out = F.regexp_replace(out, r"[.,](?<=[0-9][.,])(?=[0-9])", "")
    out = F.regexp_replace(out, r"(?=[0-9])(?<![\p{L}0-9])([0-9]++)(?=\p{L})", "$1 ")
    # Each expression begins with what is rare, so that most places fail at once.
    out = F.regexp_replace(out, r"\p{Lu}(?<=[\p{L}0-9,;:] \p{Lu})\p{Ll}++(?![\p{L}0-9])", f"{NAME}$0")
    out = F.regexp_replace(out, rf" {NAME}(?<={NAME}\p{{L}}{{1,40}} {NAME})", JOINED)
    out = F.regexp_replace(out, rf"(?=[0-9])(?<![\p{{L}}0-9])([0-9]++) ?+({'|'.join(UNITS)})(?![\p{{L}}0-9])", f"$1 {UNIT}$2")
    out = F.regexp_replace(out, r"(?=[0-9])(?<![\p{L}0-9])[0-9]++(?!\p{L})", f"{NUMBER}$0")
    return F.array_remove(F.split(F.lower(out), rf"[^\p{{L}}\p{{M}}0-9{NAME}{NUMBER}{UNIT}{JOINED}]++"), "")


def template(tokens: Column) -> Column:
    """Marked tokens with the placeholder alone where there is one."""
    return F.transform(tokens, lambda x: F.when(x.between(NAME, JOINED), F.left(x, F.lit(1))).otherwise(x))


def values(tokens: Column) -> Column:
    """The words themselves, one for each marked token."""
    return F.transform(tokens, lambda x: F.when(x.between(NAME, JOINED), F.substring(x, 2, 1 << 20)).otherwise(x))


def raw_words(tokens: Column) -> Column:
    """The words of marked tokens, each for itself."""
    return F.flatten(F.transform(values(tokens), lambda x: F.split(x, JOINED)))


def _windows(tokens: Column, width: int) -> Column:
    """(position, hash) of the windows of an array; null if it is shorter than ``width``. Each token is hashed once."""

    def found(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - width)
        key = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
        return F.transform(at, lambda i: F.struct(i.alias("at"), key(i).alias("key")))

    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.when(F.size(h) >= width, found(h)))


def _spread(df: DataFrame, width: int) -> DataFrame:
    """One row for each window of the column ``tokens``. No filter on it: that would work the column out twice."""
    return df.select(*[c for c in df.columns if c != "tokens"], F.inline(_windows(F.col("tokens"), width)))


def _meet(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(id, text_key, item_id, start) of the windows that a document and an item share, all positions of both."""
    asked = _spread(items, width).withColumnRenamed("at", "item_at")
    word = lambda key: F.shiftrightunsigned(key, 64 - BITMAP_BITS + 6)
    bit = lambda key: F.shiftrightunsigned(key, 64 - BITMAP_BITS).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("key")))
    bitmap = asked.groupBy(word(F.col("key")).alias("word")).agg(F.bit_or(one).alias("bits"))
    found = _spread(docs, width).join(F.broadcast(bitmap), word(F.col("key")) == F.col("word"))
    found = found.where(F.getbit("bits", bit(F.col("key"))) == 1).drop("word", "bits")
    return found.join(asked, "key").select("id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("start"))


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document and benchmark item that it holds: id, ``text_key``, ``item_id``, ``n_match``,
    ``n_item`` (tokens), ``start`` (token of the document that aligns with the item's first; may be negative) and
    ``kind`` ("exact", or "reparameterised" if values behind placeholders differ).

    Pairs are those of LEAST_TOKENS or LEAST_SHARE of the item agreeing, in alignments at most SHIFT tokens apart that share a
    window each. If the values are not
    paired one to one, only literal tokens count. Equal items are reported once, under their smallest id. Null and
    empty texts match nothing; repeated rows of one id and text give one row; a null id is kept as null. Empty tables
    give no rows. ``text_key`` tells texts of one id apart. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("item_id").alias("item_id"))
    items = items.select("item_id", marked("text").alias("m"))
    raw = F.size(F.filter(template("m"), lambda w: ~w.isin(NAME, NUMBER, UNIT))) < LITERALS
    items = items.withColumn("raw", raw)
    either = lambda of: F.when(F.col("raw"), raw_words("m")).otherwise(of("m"))
    items = items.select("item_id", "raw", either(template).alias("item"), either(values).alias("item_values"))
    items = scratch.save(items.where(F.size("item") >= LEAST_ITEM), "items")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    kinds = items.select("raw", F.least(F.size("item"), F.lit(WIDTH)).alias("width")).distinct().collect()
    hits = None
    for raw, width in sorted(map(tuple, kinds)):  # at most six: items of WIDTH tokens or more, and each length below
        part = raw_words if raw else template
        own = items.where((F.col("raw") == raw) & (F.least(F.size("item"), F.lit(WIDTH)) == width))
        own = own.select("item_id", F.col("item").alias("tokens"))
        met = _meet(rows.select("id", "text_key", part(marked("text")).alias("tokens")), own, width)
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        hits = rows.select("id", "text_key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start")).where("false")
    hits = scratch.save(hits.distinct(), "hits")
    asked = hits.select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    found = rows.join(asked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi")
    found = found.dropDuplicates(["id", "text_key"]).select("id", "text_key", marked("text").alias("m"))
    found = found.select("id", "text_key", template("m").alias("tokens"), values("m").alias("words"), raw_words("m").alias("raws"))
    # Alignments that lie near each other are one passage.
    here = Window.partitionBy("id", "text_key", "item_id").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(here) > SHIFT, F.lit(True))
    hits = hits.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(here))
    hits = hits.withColumnRenamed("id", "_id").withColumnRenamed("text_key", "_key")
    aligned = hits.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).join(
        items, "item_id"
    )
    aligned = aligned.withColumns({c: F.when(F.col("raw"), F.col("raws")).otherwise(F.col(c)) for c in ("tokens", "words")})
    # Item token k stands beside document token start + k; where either has none there is nothing to compare.
    first, last = F.greatest(-F.col("start"), F.lit(0)), F.least(F.size("item"), F.size("tokens") - F.col("start")) - 1
    beside = F.transform(
        F.sequence(first, last),
        lambda k: F.struct(
            k.alias("k"), (k + F.col("start")).alias("j"), F.get("item", k).alias("a"), F.get("item_values", k).alias("w"),
            F.get("words", k + F.col("start")).alias("v"), F.get("tokens", k + F.col("start")).alias("b"),
        ),
    )
    same = F.filter(beside, lambda x: x["a"] == x["b"])
    key = ["id", "text_key", "item_id", "passage"]
    aligned = aligned.select(*key, "start", F.size("item").alias("n_item"), F.when(first <= last, same).alias("p"))
    aligned = aligned.withColumn("own", F.size("p")).withColumn("start", F.col("start").cast("int"))
    # Each token of the item, and each of the document, counts in the alignment that has most of them.
    tokens = aligned.select(*key, "start", "own", "n_item", F.inline("p"))
    best = F.struct("own", -F.col("start"))
    tokens = tokens.groupBy(*key, "n_item", "k").agg(F.max_by(F.struct("j", "a", "w", "v", "start", "own"), best).alias("t"))
    tokens = tokens.groupBy(*key, "n_item", "t.j").agg(F.max_by("t", F.struct("t.own", -F.col("t.start"))).alias("t"))
    slots = F.filter("p", lambda x: x["a"].isin(NAME, NUMBER, UNIT))
    same = tokens.groupBy(*key, "n_item").agg(
        F.collect_list(F.struct("t.a", "t.w", "t.v")).alias("p"), F.max_by("t.start", F.struct("t.own", -F.col("t.start"))).alias("start")
    )
    same = same.withColumn("slots", slots)
    both = F.array_distinct(F.transform("slots", lambda x: F.struct(x["a"], x["w"], x["v"])))
    types_old = F.array_distinct(F.transform("slots", lambda x: F.struct(x["a"], x["w"])))
    types_new = F.array_distinct(F.transform("slots", lambda x: F.struct(x["a"], x["v"])))
    paired = (F.size(both) == F.size(types_old)) & (F.size(both) == F.size(types_new))
    n_match = F.when(paired, F.size("p")).otherwise(F.size("p") - F.size("slots"))
    judged = same.select(
        "id", "text_key", "item_id", "start", "n_item", n_match.alias("n_match"),
        F.when(F.exists("slots", lambda x: x["w"] != x["v"]), "reparameterised").otherwise("exact").alias("kind"),
    )
    n, m = F.col("n_item"), F.col("n_match")
    enough = F.when(n < WIDTH, m == n).when(n < WHOLE, m >= n - 1).otherwise((m >= LEAST_TOKENS) | (m >= LEAST_SHARE * n))
    best = F.max_by(F.struct("n_match", "n_item", "start", "kind"), F.struct("n_match", -F.col("start")))
    out = judged.where(enough).groupBy("id", "text_key", "item_id").agg(best.alias("b"))
    return out.select(F.col("id").alias(id_col), "text_key", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a contaminated pair, with all their columns."""
    bad = contaminated_pairs(docs, benchmark, id_col, text_col).select(
        F.col(id_col).alias("_bad_id"), F.col("text_key").alias("_bad_key")
    )
    on = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text_col) == F.col("_bad_key"))
    return docs.join(bad.distinct(), on, "left_anti")
