"""Named queries of this subpackage; ``ORACLE`` is the SQL of those that SQL
can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depuse.llm import (
    apportion, bbit_minhash, best_fit, chunking, collocations, crf_lines, crosspolytope, hilbert, importance, rank_order, surrogates,
    url_filter, vafile,
)
from depuse.llm.oracle import ORACLE  # noqa: F401 - read by the entry module

# The rules of the url query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rules on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth one, exactly."""
    vectors = vafile.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vafile.search(vectors, F.col("vec_id") % 50 == 0)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards along the curve of (lang, source, size)."""
    docs = table(spark, sf_dir, "documents")
    keep = {
        "doc_id": F.col("doc_id"), "size": hilbert.size_of(F.col("text")), "text_crc32": hilbert.crc_of(F.col("text")),
    }
    out = hilbert.hilbert_shards(docs, SHARDS, keep)
    return out.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for its entities."""
    return surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line field's verdict on every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return crf_lines.label_quality(docs, labels, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages that occur earlier."""
    return chunking.dedupe_passages(table(spark, sf_dir, "documents"))


def op7_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    return apportion.apportion(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(rank_order.fold(F.col("doc_id")) == 0, F.lit(False))
    named = rank_order.identify(docs, rank_order.learn(docs))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return best_fit.pack(table(spark, sf_dir, "documents"), with_text=False).drop("text")


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the tenth drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of every language."""
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("grp", "lang")


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every twentieth one."""
    return crosspolytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_vafile": op2_vafile,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_surrogates": op4_surrogates,
    "op5_crf_lines": op5_crf_lines,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_sainte_lague": op7_sainte_lague,
    "op8_rank_order": op8_rank_order,
    "op9_best_fit": op9_best_fit,
    "op10_bbit_minhash": op10_bbit_minhash,
    "op11_importance": op11_importance,
    "op12_collocations": op12_collocations,
    "op13_cross_polytope": op13_cross_polytope,
}
