"""Reports on repeated measurements: summaries, comparisons, omissions and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(value: str | Column, p: float) -> Column:
    """Linear interpolation, rounded half away from zero."""
    return F.round(F.percentile(value, F.lit(p))).cast("long")


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, median, least, largest and interquartile range; each quartile is rounded before they are subtracted."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), quantile(value, 0.5).alias("median_nanos"), F.min(value).cast("long").alias("min_nanos"), F.max(value).cast("long").alias("max_nanos"), (quantile(value, 0.75) - quantile(value, 0.25)).alias("iqr_nanos"))


def compare(summaries: DataFrame, case: str, role: str, reference, candidate) -> DataFrame:
    """By case: both medians and their ratio, reference over candidate."""
    pick = lambda r, name: F.max(F.when(F.col(role) == r, F.col("median_nanos"))).alias(name)
    g = summaries.groupBy(case).agg(pick(reference, "reference_nanos"), pick(candidate, "candidate_nanos"))
    return g.where("reference_nanos is not null and candidate_nanos > 0").withColumn("ratio", F.col("reference_nanos") / F.col("candidate_nanos"))


def omissions(df: DataFrame, case: str, role: str, roles: list, repeats: int) -> DataFrame:
    """(case, reason): a role's number of samples is not `repeats`, in the order of roles."""
    n = df.groupBy(case).agg(*(F.count_if(F.col(role) == r).alias(f"_n{i}") for i, r in enumerate(roles)))
    said = [F.when(F.col(f"_n{i}") != repeats, F.concat(F.lit(f"{r}: "), F.col(f"_n{i}").cast("string"), F.lit(f" of {repeats} samples"))) for i, r in enumerate(roles)]
    return n.select(case, F.array_join(F.array_compact(F.array(*said)), "; ").alias("reason")).where("reason <> ''")


def geometric_mean(value: str) -> Column:
    return F.exp(F.avg(F.log(value)))


def consistent(value: str) -> Column:
    """The value if all are equal, else "mixed"."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise("mixed")


def hash_order(df: DataFrame, seed: str, key: str) -> DataFrame:
    """Order by sha256(seed NUL key). All keys meet in one task: plans hold cases, not data."""
    h = F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(key)), 256)
    return df.withColumn("place", F.row_number().over(Window.orderBy(h)).cast("long"))


def ratio_bucket(ratio: str | Column) -> Column:
    """log2 of the ratio, held between 1/8 and 8."""
    return F.log2(F.least(F.greatest(F.col(ratio) if isinstance(ratio, str) else ratio, F.lit(0.125)), F.lit(8.0)))


def duration(nanos: Column) -> Column:
    return F.when(nanos >= 10**9, F.format_string("%.2f s", nanos / 1e9)).when(nanos >= 10**6, F.format_string("%.1f ms", nanos / 1e6)).otherwise(F.format_string("%.1f us", nanos / 1e3))


def bar_class(ratio: Column, backend: Column) -> Column:
    return F.when(backend == "gpu", "gpu").when(ratio >= 1, "faster").otherwise("slower")


def escaped(text: Column) -> Column:
    """For XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def content_digest(df: DataFrame, key: str) -> DataFrame:
    """One digest of all rows, whatever their order: of the sorted digests of rows. Rows are hashed first, so what
    meets is a digest a row; for tables of cases, not data."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.select(F.struct(F.col(key), row.alias("h")).alias("x")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), ""), 256).alias("digest"))
