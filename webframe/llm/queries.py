"""Registered queries of the operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm.chat_format import format_conversations, read_back
from webframe.llm.common import table
from webframe.llm.decontaminate import contaminated_pairs
from webframe.llm.exact_dedup import exact_dedup
from webframe.llm.html_extract import extract_text
from webframe.llm.jaccard_join import ngram_jaccard_join
from webframe.llm.language_id import held_out, identify_language
from webframe.llm.license_scan import scan_licenses
from webframe.llm.line_dedup import fuzzy_line_groups
from webframe.llm.merge_dropout import encode_pieces
from webframe.llm.pii import find_personal_data
from webframe.llm.prefix_bpe import decode_bpe, encode_bpe
from webframe.llm.run_detect import find_runs
from webframe.llm.treap_search import lexical_search


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = encode_pieces(docs.select("doc_id", sha.alias("text_sha256"), "text"), out_col="ids", decoded_col="text")
    same = F.sha2("text", 256) == F.col("text_sha256")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_sha256", same.alias("lossless"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra)))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    found = identify_language(docs.select("doc_id", "held_out", "text"), docs.where(~F.col("held_out")))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_spans")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_line_groups(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    found = decode_bpe(found.withColumn("n_tokens", F.size("ids").cast("long")))
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _with_periodic_words(docs: DataFrame) -> DataFrame:
    """One of ten documents repeats its words from a place on, which its id tells; the others are as they were."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("_words", words).withColumn("_n", F.size("_words"))
    start = F.col("_g") % F.col("_n")
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, start))
    docs = docs.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1)

    def word(i):
        return F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), word), " ")
    return docs.select("doc_id", F.when(F.col("_p").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_with_periodic_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs", (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_chat_format": op4_chat_format,
    "op5_personal_data": op5_personal_data,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op11_bpe": op11_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
