"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir); its result is written and
read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, mixing, ngram_jaccard, scratch, textkit, toxicity, vector_packing
from lodestone.llm.queries import table, tokenizer_path

#: A document is rejected from this score on; at 0.5 the calibrated score says toxic rather than not.
TOXIC = 0.5
#: How often the mix may take a source, if the most frequent one is taken once.
MAX_REPEATS = 1.5


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejection score. Null and empty texts have the score of no evidence and stay with those of
    it; rows that share an id or a text go or stay alike, as scores are of texts; an empty table gives no rows."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), TOXIC)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of line runs; a document that was nothing else goes. Null, empty and blank texts stay
    as they are, of repeated rows the first keeps its lines; columns may have any names; an empty table gives no rows."""
    gone = textkit.free("_gone", docs.columns)
    out = line_dedup.dedup_lines(docs, gone=gone)
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = out.where(F.col(gone).isNull() | ~blank)
    return kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*map(scratch.col, docs.columns))


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8. Texts without words stay, rows that
    share an id stay or go together, columns may have any names; an empty table gives no rows."""
    return ngram_jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rarer sources up to MAX_REPEATS times; every document once at least. Null is a source, null and empty texts count
    one token, repeated rows count each; columns may have any names; an empty table gives no rows."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*map(scratch.col, docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece. Null and empty texts are an end alone, repeated rows are packed
    each, null ids stay; other columns are not looked at; an empty table gives no rows."""
    return vector_packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_once), ("ngram_jaccard", near_once), ("mixing", mixed), ("packing", packed)]
#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
