"""Confidence-weighted merge of extractor outputs, and the scores that follow from it.  Pure expressions: the
whole merge is one projection over one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text

FIELDS = ["dealer_name", "model_name", "horse_power", "asset_cost", "signature_present", "stamp_present"]
VLM_CONFIDENCE = 0.75
HP_TOLERANCE, COST_TOLERANCE = 0.0, 0.05


def _result(value: Column, confidence: Column, source: Column, conflicted: Column) -> Column:
    return F.struct(value.alias("value"), confidence.cast("double").alias("confidence"), source.alias("source"), conflicted.alias("conflicted"))


def _merge(a: Column, b: Column, ca: Column, cb: Column, agree: Column, both: Column, names: tuple[str, str], tie_a: bool, damp: float) -> Column:
    """``a`` and ``b`` with confidences; ``both`` is the value where they agree; conflicts keep the more
    confident side, damped."""
    no = F.lit(False)
    wins = ca >= cb if tie_a else ca > cb
    one = lambda v, c, n: _result(v, c, F.lit(n), no)
    return (
        F.when(a.isNull() & b.isNull(), _result(F.nullif(both, both), F.lit(0.0), F.lit("none"), no))
        .when(a.isNull(), one(b, cb, names[1]))
        .when(b.isNull(), one(a, ca, names[0]))
        .when(agree, _result(both, F.least(F.lit(1.0), (ca + cb) / 2 + 0.1), F.lit("both"), no))
        .otherwise(_result(F.when(wins, a).otherwise(b), F.when(wins, ca).otherwise(cb) * damp, F.when(wins, names[0]).otherwise(names[1]), F.lit(True)))
    )


def merge_text(ocr: Column, vlm: Column, ocr_conf: Column, vlm_conf: Column) -> Column:
    agree = text.text_agree(ocr, vlm) | text.text_partial_agree(ocr, vlm)
    return _merge(ocr, vlm, ocr_conf, vlm_conf, agree, vlm, ("ocr", "vlm"), False, 0.9)


def numeric_agree(a: Column, b: Column, tolerance: float) -> Column:
    return (a == b) | (F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1)) <= tolerance)


def merge_number(ocr: Column, vlm: Column, ocr_conf: Column, vlm_conf: Column, tolerance: float) -> Column:
    """Agreeing numbers give their mean, halves to even."""
    mean = F.bround((ocr + vlm) / 2).cast("bigint")
    return _merge(ocr.cast("bigint"), vlm.cast("bigint"), ocr_conf, vlm_conf, numeric_agree(ocr, vlm, tolerance), mean, ("ocr", "vlm"), False, 0.85)


def merge_flag(found: Column, vlm: Column, found_conf: Column, vlm_conf: Column) -> Column:
    """Detection against the model; detection wins ties, and nothing at all is false at one half."""
    none = found.isNull() & vlm.isNull()
    merged = _merge(found, vlm, found_conf, vlm_conf, found == vlm, found, ("detection", "vlm"), True, 0.9)
    return F.when(none, _result(F.lit(False), F.lit(0.5), F.lit("none"), F.lit(False))).otherwise(merged)


def build_consensus(ocr: DataFrame, vlm: DataFrame, found: DataFrame) -> DataFrame:
    """Three sources by doc_id, any of which may lack a document, to one row per document.

    ocr: dealer_name, model_name, horse_power, asset_cost and <field>_conf; vlm: the six fields; found:
    signature_present, stamp_present and <field>_conf.  The joins share one partitioning by doc_id.
    """
    side = lambda df, p: df.select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "doc_id"])
    df = side(ocr, "o").join(side(vlm, "v"), "doc_id", "full_outer").join(side(found, "d"), "doc_id", "full_outer")
    c = lambda name: F.col(name)
    conf = lambda name, default: F.coalesce(c(name), F.lit(default))
    sure = F.lit(VLM_CONFIDENCE)
    fields = [merge_text(c(f"o_{f}"), c(f"v_{f}"), conf(f"o_{f}_conf", 0.0), sure).alias(f) for f in ("dealer_name", "model_name")]
    for f, tolerance in (("horse_power", HP_TOLERANCE), ("asset_cost", COST_TOLERANCE)):
        fields.append(merge_number(c(f"o_{f}"), c(f"v_{f}"), conf(f"o_{f}_conf", 0.0), sure, tolerance).alias(f))
    for f in ("signature_present", "stamp_present"):
        fields.append(merge_flag(c(f"d_{f}"), c(f"v_{f}"), conf(f"d_{f}_conf", 0.0), sure).alias(f))
    return df.select("doc_id", *fields)


def overall_confidence() -> Column:
    """Mean confidence of the fields that have a value, four digits; 0 if none has."""
    filled = F.array_compact(F.array(*[F.when(F.col(f)["value"].isNotNull(), F.col(f)["confidence"]) for f in FIELDS]))
    total = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(filled) > 0, F.round(total / F.greatest(F.size(filled), F.lit(1)), 4)).otherwise(0.0)


def has_conflicts() -> Column:
    """Covers the four text and number fields only."""
    return F.col("dealer_name.conflicted") | F.col("model_name.conflicted") | F.col("horse_power.conflicted") | F.col("asset_cost.conflicted")


def score_report() -> list[Column]:
    """score_<field> for the six fields, and score: their mean less .05 for each missing value."""
    bonus = {
        "dealer_name": rules.name_bonus(F.col("dealer_name.value")),
        "model_name": rules.model_bonus(F.col("model_name.value")),
        "horse_power": rules.hp_bonus(F.col("horse_power.value")),
        "asset_cost": rules.cost_bonus(F.col("asset_cost.value")),
    }
    each = {f: rules.clamp01(F.col(f)["confidence"] + bonus.get(f, F.lit(0.0))) for f in FIELDS}
    total, missing = F.lit(0.0), F.lit(0.0)
    for f in FIELDS:
        total = total + each[f]
        missing = missing + F.when(F.col(f)["value"].isNull(), 0.05).otherwise(0.0)
    return [*[each[f].alias(f"score_{f}") for f in FIELDS], rules.clamp01(total / len(FIELDS) - missing).alias("score")]
