"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, kmeans_tree, line_dedup, media, mixing, ngram_jaccard, pitman_yor, suffix_dedup, toxicity, vector_packing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_extraction.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: the corpus's own size, no source more than twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = docs.agg(F.sum(F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 4) + 1).alias("t")).first()["t"]
    return mixing.mix(docs, max_repeats=2.0, budget=float(size or 0)).select("doc_id", "source", "epoch", "position", "repeats")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; rows whose crc32(doc_id) mod 4 is 2 are never learnt from."""
    labels = table(spark, sf_dir, "labels").where(crc_of("doc_id") % 4 != 2).select("doc_id", "toxic")
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select(
        "doc_id",
        (crc_of("doc_id") % 4 == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that strings of 200 bytes found elsewhere cover."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity groups of all documents: 3-word shingles, Jaccard 0.9."""
    return ngram_jaccard.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100)


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as media payloads in content-defined chunks, stored and read back."""
    return media.media_column(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return vector_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vec_id divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kmeans_tree.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all texts; learnt from rows whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of("doc_id") % 5 != 1).alias("learn"))
    return pitman_yor.score_texts(docs, "learn").withColumn("held_out", ~F.col("train")).drop("train")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of two lines or more."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.size("_gone"), F.lit(0))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.greatest(removed, F.lit(0)).cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_blocks": op1_html_blocks,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_media_chunks": op6_media_chunks,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_kmeans_tree": op8_kmeans_tree,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_line_dedup": op10_line_dedup,
}
#: The others are held against brute force in tests/llm: components, byte windows, hashes and models are beyond SQL or too slow in it.
ORACLES: dict[str, str] = {
    "op10_line_dedup": """
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
s AS (SELECT doc_id, i AS pos, a[i] AS raw, trim(a[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM a, unnest(range(1, len(a) + 1)) AS u(i)),
n AS (SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s WHERE t <> ''),
g AS (SELECT doc_id, k, t, lead(t) OVER (PARTITION BY doc_id ORDER BY k) AS t2 FROM n),
w AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, k) AS turn FROM g WHERE t2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, k FROM w WHERE turn > 1 UNION ALL SELECT doc_id, k + 1 FROM w WHERE turn > 1)),
lost AS (SELECT doc_id, pos FROM n JOIN gone USING (doc_id, k)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE s.t <> '') AS n_lines, count(lost.pos) AS n_removed, coalesce(string_agg(s.raw, chr(10) ORDER BY s.pos) FILTER (WHERE lost.pos IS NULL), '') AS t
  FROM s LEFT JOIN lost USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(t) AS n_chars_kept, md5(t) AS kept_md5 FROM documents d LEFT JOIN kept USING (doc_id)""",
}
