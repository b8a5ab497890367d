"""Exact deduplication by deterministic block naming.

Every normalised text is cut into fixed-size blocks.  The distinct blocks are sorted and each gets an
integer name; then adjacent names are paired, the distinct pairs are sorted and named in turn, until one
name per document is left.  Two documents have the same (level, name) exactly if their texts are equal:
no step relies on a hash being free of collisions.

Blocks are sorted by (64-bit fingerprint, content).  Content is only compared where one fingerprint stands
for several contents, which one aggregation over the distinct blocks finds out; so whole texts are shuffled
once, after map-side combining, and everything later moves a few integers per block.

Defined results: null text counts as empty, empty texts are equal to one another, a text of any length is
read whole, rows that repeat a doc_id are separate rows (the first of them may stay), a null doc_id sorts
last, an empty table gives an empty table, other columns are carried through by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, free_name, materialise, without

BLOCK = 8192  # code points


def normalised(text: Column) -> Column:
    """The text that is compared: each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(text: Column, block: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _sorted_names(keys: DataFrame, by: list[str]) -> DataFrame:
    """One row per distinct key with ``name``: integers that ascend in the keys' sort order."""
    distinct = keys.select(*by).distinct()
    return materialise(distinct.orderBy(*by).withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_sha256, and the collision-free identity (level, name)."""
    text = normalised(F.col("text"))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), text.alias("text"))
    cut = base.select("rid", "doc_id", F.sha2("text", 256).alias("sha"), _blocks(F.col("text"), block).alias("blocks"))
    occurrences = cut.select("rid", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "block"))
    occurrences = occurrences.withColumn("fp", F.xxhash64("block"))

    distinct = occurrences.select("fp", "block").distinct()
    shared = materialise(distinct.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"))
    if shared.isEmpty():
        named = occurrences.withColumn("tie", F.lit(0))
    else:
        order = Window.partitionBy("fp").orderBy("block")
        ties = materialise(distinct.join(shared, "fp").select("fp", "block", F.row_number().over(order).alias("tie")))
        named = occurrences.join(ties, ["fp", "block"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    first = F.col("idx") == 0
    rows = materialise(
        named.select("rid", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "n", "idx", "fp", "tie")
    )
    names = _sorted_names(rows, ["fp", "tie"])
    rows = rows.join(names, ["fp", "tie"]).select("rid", "doc_id", "sha", "n", "idx", "name")

    done, level = [], 0
    while True:
        rows = materialise(rows)
        done.append(rows.where("n = 1").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = rows.where("n > 1")
        if rest.isEmpty():
            break
        even = F.col("idx") % 2 == 0
        pairs = rest.groupBy("rid", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
            F.max(F.ceil(F.col("n") / 2).cast("int")).alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialise(pairs)
        names = _sorted_names(pairs, ["left", "right"])
        rows = pairs.join(names, ["left", "right"]).select("rid", "doc_id", "sha", "n", "idx", "name")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest doc_id of a group of equal texts stays.
    """
    ids = identities(docs, block)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    groups = materialise(ids.groupBy("level", "name").agg(F.min(key).alias("keep"), F.count("*").alias("group_size")))
    return ids.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.  Only dropped rows are shuffled.

    Rows that share a doc_id are told apart by their text: of fully equal ones one stays.
    """
    verdict = exact_dedup(docs, block)
    digest = F.sha2(normalised(F.col("text")), 256)
    twin = F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("twin")
    gone = materialise(verdict.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_digest"), twin).distinct())
    left = without(docs, gone.where("not twin").drop("twin"), digest)
    twins = gone.where("twin").drop("twin")
    if not twins.isEmpty():  # rows that repeat a doc_id and a text
        name = free_name(docs.columns, "digest_")
        marked = left.withColumn(name, digest)
        match = marked["doc_id"].eqNullSafe(twins["gone_id"]) & (marked[name] == twins["gone_digest"])
        left = marked.join(twins, match, "left_anti").unionByName(marked.join(twins, match, "left_semi").dropDuplicates(["doc_id", name])).drop(name)
    return left
