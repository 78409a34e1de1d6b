"""Fuzzy duplicates of lines: SimHash, pigeonhole blocks, edit similarity, one occurrence per connected group.

Lines are normalised (lower case, no ASCII signs, numbers as 0, single spaces) and
made distinct. The SimHash of a distinct line has 64 bits, each the
majority of that bit over the hashes of its words. Two lines are candidates
when at most DISTANCE bits differ. Then of PARTS parts of the bits at least
PARTS - DISTANCE agree, so lines meet on one of the C(PARTS, DISTANCE) choices of so
many parts. Candidates are linked when the edit distance over words is at most
a quarter of the longer line; words count as equal there if their hashes agree modulo 20,000, so that about one
pair of different words in 20,000 does. Everything is DataFrame expressions.

Of an occurrence only numbers are kept: its key, its SimHash and its number of words, all worked out
from one reading. Lines whose numbers of words differ by more than the edit distance may are not compared.

A place where lines meet may hold very many. In a place of at most CROWD + 1 lines each is compared with all
before it, where they are sorted. In a larger one each line is first compared with the
first and the previous one of its place only; what is linked then is one group. Then
those of them that still hold several groups are joined in full, only across groups.
With more data take more PARTS, which makes places narrower: the bits of a place
(64 * (PARTS - DISTANCE) / PARTS, 26 here) should exceed the logarithm of the number of lines.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webframe.functions.common import with_once
from webframe.llm.common import Scratch
from webframe.llm.components import components

DISTANCE, PARTS = 3, 5
#: A place of more than one line more than this is crowded.
CROWD = 32
#: Bits of the filter for texts that are read again.
FILTER_BITS = 26
#: Largest edit distance over words, as a share of the longer line.
MOST_EDITS = 0.25


def normal_line(line: Column) -> Column:
    """Lower case, runs of ASCII signs and white space as one space, numbers as 0.

    What stays as it is, a single space or 0, is not matched: most of a text is passed over.
    """
    signs = r"\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
    line = F.regexp_replace(F.lower(line), f"[{signs}][ {signs}]*+| [ {signs}]++", " ")
    return F.trim(F.regexp_replace(line, r"[1-9][0-9]*+|0[0-9]++", "0"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line of every document as it is."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_key"),
        F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_no", "line"),
    )


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line of every document with its normal form and a key of that, null for a line without letters or digits."""
    lines = _lines(docs, id_col, text_col)
    lines = with_once(lines, norm=F.nullif(normal_line(F.col("line")), F.lit("")))
    return lines.withColumn("key", F.when(F.col("norm").isNotNull(), _key()))


def _key() -> Column:
    return F.struct(F.xxhash64("norm").alias("x"), F.hash("norm").alias("y"))


def _at() -> Column:
    """A number for the place of a line, the same for rows of one text."""
    return F.xxhash64("text_key", "line_no")


def _with_sim(lines: DataFrame, width: int) -> DataFrame:
    """Replaces ``norm`` by ``sim``, its SimHash, and ``n``, its number of words; null and 0 for a null. Adds the order of rows as ``row``.

    The counts of the bits are fields of ``width`` bits, for lines of at most 2^(width - 2) words. A line
    is summed up where it is read, only the sums are shuffled. All counts of a sum are compared with half the
    number of words at once: what is added makes the second highest bit of a field tell whether its count is larger. That keeps the
    generated code short enough to be compiled.
    """
    # Numbers of their own, as a key in one column would take the slower of Spark's hash tables.
    other = [c for c in lines.columns if c not in ("key", "norm")]
    lines = lines.select(*other, "key.x", "key.y", "norm", F.monotonically_increasing_id().alias("row"))
    own = [*other, "x", "y"]
    words = lines.select("row", *own, F.explode_outer(F.split("norm", " ")).alias("w")).select("row", *own, "w", F.xxhash64("w").alias("h"))
    fields = 64 // width
    shifts = range(64 - width * (fields - 1))
    ones = F.lit(sum(1 << (width * k) for k in range(fields)))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(ones)).alias(f"s{k}") for k in shifts]
    counted = words.groupBy("row", *own).agg(F.count("w").alias("n"), *sums)
    half = (F.lit((1 << (width - 2)) - 1) - F.shiftright("n", 1)) * ones
    counted = counted.select("*", F.explode(F.array(half)).alias("half"))
    sim = F.lit(0).cast("long")
    for k in shifts:
        sim = sim.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"s{k}") + F.col("half"), width - 2).bitwiseAND(ones), k))
    key = F.when(F.col("n") > 0, F.struct("x", "y")).alias("key")
    return counted.select("row", *other, key, F.when(F.col("n") > 0, sim).alias("sim"), F.col("n").cast("int").alias("n"))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line of every document: id, text_key, line_no, key, sim, n. Narrow sums do for documents below 2^20 bytes."""
    few = F.coalesce(F.octet_length(text_col) < 1 << 20, F.lit(True))
    narrow, wide = (
        _with_sim(_occurrences(docs.where(some), id_col, text_col).select("id", "text_key", "line_no", "key", "norm"), width)
        for some, width in ((few, 21), (~few, 32))
    )
    return narrow.unionByName(wide).sortWithinPartitions("row").drop("row")


def _distinct(lines: DataFrame) -> DataFrame:
    """One row of each key, with the least ``at`` and how often it came; the other columns are the same in all its rows."""
    same = [F.min(c).alias(c) for c in lines.columns if c != "key"]
    found = lines.select("key.*", *[c for c in lines.columns if c != "key"]).groupBy("x", "y").agg(*same, F.count(F.lit(1)).alias("times"))
    return found.select(F.struct("x", "y").alias("key"), *[c for c in found.columns if c not in ("x", "y")])


def _simhash(lines: DataFrame) -> DataFrame:
    """(key, sim) of (key, norm), where equal lines may come several times. A column ``at`` is returned too, the least one of a line."""
    return _distinct(_with_sim(lines, 32).drop("n", "row")).drop("times")


def _places(sims: DataFrame, distance: int, parts: int) -> DataFrame:
    """A row of (place, line, rest, n) for each choice of parts: the number of the choice with the bits of its parts, and the other bits."""
    edges = [64 * k // parts for k in range(parts + 1)]

    def bits(chosen, number: int) -> Column:
        """The bits of the chosen parts, one after the other, behind a number."""
        out = F.lit(number).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            part = F.shiftrightunsigned("sim", edges[k]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = F.shiftleft(out, width).bitwiseOR(part)
        return out

    choices = []
    for number, chosen in enumerate(combinations(range(parts), parts - distance)):
        others = [k for k in range(parts) if k not in chosen]
        place, rest = bits(chosen, number), bits(others, 0)
        if number.bit_length() + sum(edges[k + 1] - edges[k] for k in chosen) > 64:
            place, rest = F.xxhash64(F.lit(number), bits(chosen, 0)), F.col("sim")
        choices.append(F.struct(place.alias("place"), rest.alias("rest")))
    return sims.select("line", "n", F.inline(F.array(*choices))).select("place", "line", "rest", "n")


def _most(a: Column, b: Column) -> Column:
    """The largest edit distance of similar lines of so many words."""
    return F.floor(F.greatest(a, b) * MOST_EDITS).cast("int")


def _near(a, b, distance: int) -> Column:
    """Whether two rows of one place, by their ``rest`` and ``n``, may be similar."""
    return (F.bit_count(a("rest").bitwiseXOR(b("rest"))) <= distance) & (F.abs(a("n") - b("n")) <= _most(a("n"), b("n")))


def _symbols(text: str) -> Column:
    """A line with one character for each word, so that an edit distance over characters is one over words."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(20_000)) + 0x4E00), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(text, " "), code), "")), "UTF-16BE")


def _some(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose ``at`` may be among those of ``wanted``, by a bitmap of fixed size that is made from all of them.

    The bitmap has at most 2^(FILTER_BITS - 15) rows of 4 KB, so it can be broadcast. It keeps the text of other
    lines out of the shuffle; what it lets through by chance is sorted out by the join that follows.
    """
    bit = lambda key: F.pmod(key, F.lit(1 << FILTER_BITS)) + 1
    marked = wanted.select(bit(F.col("at")).alias("bit"))
    maps = marked.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")
    )
    at = F.bitmap_bit_position(bit(F.col("at")))
    octet = F.conv(F.hex(F.substring(F.col("map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = lines.join(F.broadcast(maps), F.bitmap_bucket_number(bit(F.col("at"))) == F.col("bucket"))
    return here.where(F.shiftright(octet, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0).drop("bucket", "map")


def _coded(pairs: DataFrame, lines: DataFrame, raw: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(line, code) for the lines of the pairs (a, b), read again from the documents at one occurrence of each.

    Only lines that the bitmap lets through are normalised again.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    wanted = scratch.save(ends.join(lines.select("line", "key", "at"), "line"), f"wanted-{name}")
    found = _some(raw.select(_at().alias("at"), "line"), wanted).select("at", normal_line(F.col("line")).alias("norm"))
    found = found.join(wanted, "at").where(_key() == F.col("key")).dropDuplicates(["line"])
    return scratch.save(found.select("line", _symbols("norm").alias("code")), f"codes-{name}")


def _verified(pairs: DataFrame, lines: DataFrame, raw: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose lines are similar by edit distance over words."""
    pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs-{name}")
    codes = _coded(pairs, lines, raw, scratch, name)
    both = pairs.join(codes.toDF("a", "u"), "a").join(codes.toDF("b", "v"), "b")
    most = _most(F.length("u"), F.length("v"))
    near = (F.abs(F.length("u") - F.length("v")) <= most) & (F.call_function("levenshtein", F.col("u"), F.col("v"), most) >= 0)
    return scratch.save(both.where(near).select("a", "b"), f"links-{name}")


def fuzzy_line_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    parts: int = PARTS,
) -> DataFrame:
    """One row for each line of each document: id, ``text_key``, ``line_no`` from 0, ``group_id``, ``group_size``, ``kept``.

    A text is cut at each line feed; a null text is one empty line. Of the occurrences of a group's lines, the first by
    id (a null one last), then text_key and line_no, is kept. Rows of one id and text are the same occurrence: kept
    or dropped together, and both counted. Lines without a letter or digit are kept and in no group (null, size 1).
    ``group_id`` is a number that holds within the result. Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    raw = _lines(docs, id_col, text_col)
    own = scratch.save(_own(docs, id_col, text_col), "own")
    lines = _distinct(own.where("key is not null").select("key", "sim", "n", _at().alias("at")))
    lines = scratch.save(lines.select(F.monotonically_increasing_id().alias("line"), "key", "sim", "n", "at", "times"), "lines")
    met = scratch.save(_met(_places(lines.select("line", "sim", "n"), distance, parts), distance), "met")
    pairs = met.select(F.col("line").alias("a"), F.explode("near").alias("b"))
    links = _verified(pairs, lines, raw, scratch, "first")
    first = components(links, "a", "b", scratch, "first")

    # Crowded places whose lines are not all in one group.
    grouped = met.where("crowded").join(first.withColumnRenamed("node", "line"), "line", "left")
    grouped = scratch.save(grouped.select("place", "line", "rest", "n", F.coalesce("root", "line").alias("g")), "grouped")
    mixed = grouped.groupBy("place").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("place")
    rows = grouped.join(mixed, "place")
    a, b = rows.alias("a"), rows.alias("b")
    across = a.join(b, F.col("a.place") == F.col("b.place")).where(F.col("a.g") < F.col("b.g"))
    across = across.where(_near(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), distance))
    rest = _verified(across.select(F.col("a.line").alias("a"), F.col("b.line").alias("b")), lines, raw, scratch, "rest")
    final = components(links.unionByName(rest), "a", "b", scratch, "final")

    # Only lines that came several times or are linked need to know their group.
    named = lines.select("line", "key", "times").join(final.withColumnRenamed("node", "line"), "line", "left")
    alone = F.col("root").isNull() & (F.col("times") == 1)
    named = named.select("key", F.coalesce("root", "line").alias("group_id"), alone.alias("alone"))
    placed = own.select("id", "text_key", "line_no", "key").join(named, "key", "left").withColumn("alone", F.coalesce("alone", F.lit(True)))
    placed = scratch.save(placed.select("id", "text_key", "line_no", "group_id", "alone"), "placed")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "line_no")
    several = placed.where("not alone")
    groups = several.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))

    def result(rows: DataFrame, size: Column, kept: Column) -> DataFrame:
        return rows.select(F.col("id").alias(id_col), "text_key", "line_no", "group_id", size.cast("long").alias("group_size"), kept.alias("kept"))

    is_first = order.eqNullSafe(F.col("first"))
    return result(placed.where("alone"), F.lit(1), F.lit(True)).unionByName(result(several.join(groups, "group_id"), F.col("n"), is_first))


def _met(places: DataFrame, distance: int) -> DataFrame:
    """(place, line, rest, n, crowded, near): the rows that are in a crowded place or near others of their place.

    ``near`` has the near ones of all lines before it in its place, in a crowded place of the first and the previous one.
    """
    in_order = Window.partitionBy("place").orderBy("rest", "line")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("line", "rest", "n")
    places = places.withColumn("lines", F.count(F.lit(1)).over(whole)).where("lines > 1")
    places = places.select("*", F.collect_list(row).over(in_order.rowsBetween(-CROWD, -1)).alias("before"), F.first(row).over(in_order).alias("f"))
    crowded = F.col("lines") > CROWD + 1
    others = F.when(crowded, F.when(F.size("before") > 0, F.array("f", F.element_at("before", -1)))).otherwise(F.col("before"))
    met = places.select("place", "line", "rest", "n", crowded.alias("crowded"), F.coalesce(others, F.array()).alias("others"))
    near = F.transform(F.filter("others", lambda o: _near(F.col, lambda c: o[c], distance)), lambda o: o["line"])
    return with_once(met, near=near).drop("others").where("crowded or size(near) > 0")


def drop_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text) of each distinct (id, text) of ``docs``, with the kept lines only; "" if none is kept."""
    groups = fuzzy_line_groups(docs, id_col, text_col, **options).where("kept").select(
        F.col(id_col).alias("gid"), F.col("text_key").alias("gkey"), F.col("line_no").alias("gno")
    ).distinct()
    every = _occurrences(docs.select(id_col, text_col).distinct(), id_col, text_col)
    on = F.col("id").eqNullSafe(F.col("gid")) & (F.col("text_key") == F.col("gkey")) & (F.col("line_no") == F.col("gno"))
    kept = F.when(F.col("gkey").isNotNull(), F.struct("line_no", "line"))
    lines = every.join(groups, on, "left").groupBy("id", "text_key").agg(F.sort_array(F.collect_list(kept)).alias("l"))
    return lines.select(F.col("id").alias(id_col), F.array_join("l.line", "\n").alias(text_col))
