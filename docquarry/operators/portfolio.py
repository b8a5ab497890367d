"""Portfolio analytics over flat results: doc_id, dealer_name, model_name, asset_cost, confidence,
signature_present, stamp_present (and pos, the input position, where order matters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

CONFIDENCE_MARK = 0.75


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def run_summary(df: DataFrame) -> DataFrame:
    """Documents, mean confidence and seconds (over at least one), and unhandled failures."""
    n = F.greatest(F.count("*"), F.lit(1))
    return df.agg(
        F.count("*").alias("documents"),
        (F.coalesce(F.sum("confidence"), F.lit(0.0)) / n).alias("mean_confidence"),
        (F.coalesce(F.sum("seconds"), F.lit(0.0)) / n).alias("mean_seconds"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def label_summary(df: DataFrame) -> DataFrame:
    """How many labelled documents succeeded and failed (``error`` is null or not)."""
    return df.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def kpis(df: DataFrame) -> DataFrame:
    """One pass: totals skip nulls, flag rates are over known flags, full compliance is over all rows."""
    sig, stamp = F.col("signature_present"), F.col("stamp_present")
    return df.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("asset_cost"), F.lit(0)).alias("total_cost"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("least_confidence"),
        F.max("confidence").alias("most_confidence"),
        _rate(sig).alias("signed_rate"),
        _rate(stamp).alias("stamped_rate"),
        F.avg(F.coalesce(sig & stamp, F.lit(False)).cast("int")).alias("compliant_rate"),
    )


def sidebar(df: DataFrame) -> DataFrame:
    """Percentages and the total; 0 where a column is absent or has no value."""
    have = set(df.columns)
    rate = lambda c: F.coalesce(_rate(F.col(c)) * 100, F.lit(0.0)) if c in have else F.lit(0.0)
    total = F.coalesce(F.sum("asset_cost"), F.lit(0)) if "asset_cost" in have else F.lit(0)
    mean = F.coalesce(F.avg("confidence") * 100, F.lit(0.0)) if "confidence" in have else F.lit(0.0)
    return df.agg(mean.alias("confidence_pct"), rate("signature_present").alias("signed_pct"), rate("stamp_present").alias("stamped_pct"), total.alias("total_cost"))


def top_dealers(df: DataFrame, n: int = 12) -> DataFrame:
    sums = df.where("dealer_name is not null").groupBy("dealer_name").agg(F.coalesce(F.sum("asset_cost"), F.lit(0)).alias("total_cost"))
    return sums.orderBy(F.desc("total_cost"), "dealer_name").limit(n)


def model_counts(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent models; ties by first position."""
    counts = df.where("model_name is not null").groupBy("model_name").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return counts.orderBy(F.desc("n"), "first_pos").limit(n)


def approximate_models(df: DataFrame, n: int = 10) -> DataFrame:
    """The same as a bounded sketch, for very many models."""
    return df.where("model_name is not null").agg(F.expr(f"approx_top_k(model_name, {n})").alias("top"))


def compliance_matrix(df: DataFrame) -> DataFrame:
    """Four conditional counts in one pass; unknown flags are in no cell."""
    sig, stamp = F.col("signature_present"), F.col("stamp_present")
    return df.agg(
        F.count_if(sig & stamp).alias("both"),
        F.count_if(sig & ~stamp).alias("signature_only"),
        F.count_if(~sig & stamp).alias("stamp_only"),
        F.count_if(~sig & ~stamp).alias("neither"),
    )


def confidence_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Counts by fixed edges over [0, 1]; the last bin is closed."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return df.where("confidence between 0 and 1").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def risk_flags(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` risky rows in input order, and how many there are beyond them."""
    risky = df.where(rules.is_risky(F.col("confidence"), F.col("signature_present"), F.col("stamp_present")))
    total = risky.agg(F.count("*").alias("c"))
    shown = risky.orderBy("pos").limit(n)
    cols = ["doc_id", "dealer_name", "model_name", "asset_cost", "confidence", "signature_present", "stamp_present"]
    return shown.select(*cols, F.greatest(total.scalar() - n, F.lit(0)).alias("more"))


def verdicts(df: DataFrame) -> DataFrame:
    issues = rules.verdict_issues(F.col("confidence"), F.col("signature_present"), F.col("stamp_present"), F.col("asset_cost"))
    return df.withColumn("issues", issues).withColumn("verdict", rules.verdict(F.col("issues")))


def flatten(records: DataFrame) -> DataFrame:
    """Nested result records to the flat columns that this module reads."""
    f = F.col("fields")
    return records.select(
        "doc_id", f["dealer_name"].alias("dealer_name"), f["model_name"].alias("model_name"), f["horse_power"].alias("horse_power"), f["asset_cost"].alias("asset_cost"),
        "confidence", f["signature"]["present"].alias("signature_present"), f["stamp"]["present"].alias("stamp_present"),
    )
