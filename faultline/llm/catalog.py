"""The operators as queries with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import held_out
from faultline.llm.context_tree import score_texts
from faultline.llm.decontaminate import contaminated
from faultline.llm.divergence import audit_sources
from faultline.llm.jaccard_join import near_classes
from faultline.llm.language import identify
from faultline.llm.licenses import scan_licenses
from faultline.llm.manifest import manifest, proof_digest
from faultline.llm.mixing import mix_sources
from faultline.llm.oracles import OP12_SQL, OP13_SQL
from faultline.llm.packing import pack
from faultline.llm.render import extract
from faultline.llm.repeats import cut, repeated_windows
from faultline.llm.syncmers import compare_with_next
from faultline.llm.url_filter import judge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = cut(docs, repeated_windows(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    compared = compare_with_next(table(spark, folder, "documents"))
    return compared.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


@query("op3_mix_sources")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "source", "n_tokens", "epoch", "slot")


@query("op4_ngram_jaccard")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(table(spark, folder, "documents"))


@query("op5_licenses")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    labelled = identify(docs.select("doc_id", "text", "lang"), ~out)
    return labelled.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The hosts of the test pages stand below these names as below public suffixes.
URL_SUFFIXES = ["example.com", "example.net", "example.org"]


@query("op7_url_filter")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """A page's number in its path is the document it was made of; that document's labels are the page's outcome."""
    labels = table(spark, folder, "labels")
    bad = (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("int")
    outcomes = labels.where("toxic IS NOT NULL OR quality IS NOT NULL").select("doc_id", bad.alias("bad"))
    page_key = F.regexp_extract("url", r"://[^/?#]*/[a-z]+/(\d{1,18})", 1).try_cast("long")
    return judge(table(spark, folder, "pages"), outcomes, URL_RULES, URL_SUFFIXES, page_key)


@query("op8_context_tree")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"), held_out(F.col("doc_id"), 10, 0))


@query("op9_decontaminate")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_html_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).select("page_id", "text", "n_blocks")


@query("op11_pack")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


@query("op12_manifest", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Tampered: the texts of documents with an even crc32 of their number have lost their line breaks."""
    docs = table(spark, folder, "documents")
    tampered = F.when(held_out(F.col("doc_id"), 2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


@query("op13_audit_sources", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(table(spark, folder, "documents"))
