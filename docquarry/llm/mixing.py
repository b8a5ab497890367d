"""Mixing sources to target weights.

Each document gets a hash-random key.  Within a source, documents are taken in key order until the source's
budget of words is met; a budget above the source's size takes whole epochs first.

The order is never materialised for whole sources: keys are uniform, so their first hexadecimal digits cut a
source into ranges of equal share.  One aggregation sums words by (source, range); a running sum over those
few rows finds the range where the budget ends, and only the rows of that range are sorted.  The result is
one cut key per source, a table as long as the number of sources, and each document is compared with it
where it lies.  A source with a third of all rows is spread over all ranges.

Defined results: null text has 0 words; a null source is a source of its own, last; documents with equal
doc_id have equal keys and are taken or left together, those without one by their text; documents without words are
in the first epoch's order but change no budget; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import free_name, materialise, n_words

WEIGHTS = (5, 2, 1)  # by source in code point order, repeating
SHARE = 1.5  # of all words
MAX_EPOCHS = 2  # no source is taken more often
RANGE_ROWS = 100_000  # rows of all sources for each key range of a source, about
LEAST_DIGITS = 3  # 4096 key ranges for each source


def _key(doc_id, text):
    """Hash-random; rows without a doc_id take theirs from the text, so that they aren't taken or left as a block."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (src, source_size) -> with ``target``.

    Sharing out excess by weight until no target is above its cap ends where the sources with the smallest
    cap/weight are at their caps and the rest share what is left by weight; a running sum finds that point.
    ``sizes`` has one row per source, so a window over all of it is small.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs)
    rising = Window.orderBy((F.col("cap") / F.col("w")), F.col("src").isNull(), F.col("src"))
    whole = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("budget", F.sum("source_size").over(whole) * share)
    df = df.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    df = df.withColumn("rest_w", F.sum("w").over(after))
    open_ = (F.col("cap") * F.col("rest_w")) > (F.col("left") * F.col("w"))  # from here on none is above its cap
    df = df.withColumn("open", open_)
    first = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("open"), F.struct("left", "rest_w")), ignorenulls=True).over(first)
    df = df.withColumn("level", level)
    share_out = F.col("w") * F.col("level.left") / F.col("level.rest_w")
    return df.select("src", "source_size", F.when(F.col("open"), share_out).otherwise(F.col("cap").cast("double")).alias("target"))


def cuts(docs: DataFrame, **plan) -> DataFrame:
    """One row per source: src, source_size, target, epochs (whole ones) and cut_key (documents up to and
    including it are taken once more; null: none)."""
    small = materialise(docs.select(F.col("source").alias("src"), _key("doc_id", "text").alias("k"), n_words(F.col("text")).alias("n")))
    # as many hexadecimal digits as keep the range in which a budget ends small, whatever the number of rows
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, small.count() / RANGE_ROWS), 16)))
    small = small.withColumn("r", F.substring("k", 1, digits))
    ranges = materialise(small.groupBy("src", "r").agg(F.sum("n").alias("n")))
    goal = materialise(targets(ranges.groupBy("src").agg(F.sum("n").alias("source_size")), **plan))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("over", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("src").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0))).withColumnRenamed("src", "s")
    last = ranges.join(goal, F.col("s").eqNullSafe(F.col("src"))).where("over > 0 and start < over and over <= start + n")
    last = materialise(last.select("s", "r", "start", "over"))
    # inside the range where the budget ends: in key order, cut where the sum comes nearest to the budget
    there = small.join(last.withColumnRenamed("r", "rr"), F.col("src").eqNullSafe(F.col("s")) & (F.col("r") == F.col("rr")))
    there = there.groupBy("s", "r", "k", "start", "over").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("s", "r").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = there.withColumn("end", F.col("start") + F.sum("n").over(inside))
    chosen = there.where(F.col("end") - F.col("n") / 2 <= F.col("over")).groupBy("s", "r").agg(F.max("k").alias("key"))
    chosen = last.join(chosen.withColumnRenamed("s", "cs").withColumnRenamed("r", "cr"), F.col("s").eqNullSafe(F.col("cs")) & (F.col("r") == F.col("cr")), "left")
    # no document of the range fits: the cut lies before the range
    chosen = chosen.select(F.col("s"), F.coalesce(F.col("key"), F.col("r")).alias("cut_key"))
    out = goal.join(chosen, F.col("src").eqNullSafe(F.col("s")), "left")
    return materialise(out.select("src", "source_size", "target", "epochs", "cut_key"))


def mix(docs: DataFrame, **plan) -> DataFrame:
    """``docs`` with source_size, target, size (words) and copies (times that the mix holds the document)."""
    at = {x: free_name(docs.columns, x) for x in ("size", "source_size", "target", "copies", "src", "epochs", "cut_key")}
    cut = cuts(docs, **plan)
    cut = cut.select(*[F.col(c).alias(at[c]) for c in cut.columns])
    df = docs.withColumn(at["size"], n_words(F.col("text"))).join(cut, F.col("source").eqNullSafe(F.col(at["src"])))
    once_more = (_key("doc_id", "text") <= F.col(at["cut_key"])).cast("long")
    df = df.withColumn(at["copies"], F.col(at["epochs"]) + F.coalesce(once_more, F.lit(0)))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(at[c]) for c in ("size", "source_size", "target", "copies")])


def mixed(docs: DataFrame, **plan) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the columns of ``docs``."""
    df = mix(docs, **plan)
    copies = df.columns[-1]
    n = free_name(df.columns, "copy_")
    many = df.withColumn(n, F.explode(F.sequence(F.lit(1), F.greatest(F.col(copies), F.lit(1)).cast("int"))))
    return many.where(F.col(copies) > 0).select(*[F.col(f"`{c}`") for c in docs.columns])
