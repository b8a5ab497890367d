"""Operators on OCR text blocks: lines, overlap removal, neighbourhoods, and the rule-based field parser.

Blocks are rows (doc_id, block_idx, text, confidence, bbox).  Everything is partitioned by document, so a page
is the largest group; documents spread over tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import amounts, geometry, text

#: Label patterns that precede a model name.
MODEL_LABELS = [r"model\s*[:\-–.]+\s*", r"model\s+name\s*[:\-–.]+\s*", r"tractor\s+model\s*[:\-–.]+\s*", r"vehicle\s+model\s*[:\-–.]+\s*"]


def line_groups(blocks: DataFrame, tolerance: float = 12) -> DataFrame:
    """``blocks`` with ``line_no`` (from 0): gaps and islands over centre_y; a line goes on while the step from
    the block before is within the tolerance."""
    order = Window.partitionBy("doc_id").orderBy("cy_", "block_idx")
    df = blocks.withColumn("cy_", geometry.centre_y(F.col("bbox")))
    df = df.withColumn("new_", F.when(F.col("cy_") - F.lag("cy_").over(order) > tolerance, 1).otherwise(0))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("line_no", F.sum("new_").over(running)).drop("cy_", "new_")


def line_texts(blocks: DataFrame, tolerance: float = 12) -> DataFrame:
    """(doc_id, line_no, line_text): blocks of a line from left to right."""
    df = line_groups(blocks, tolerance)
    item = F.struct(F.col("bbox")[0].alias("x"), geometry.centre_y(F.col("bbox")).alias("y"), F.col("block_idx").alias("i"), F.col("text").alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda b: b["t"]), " ")
    return df.groupBy("doc_id", "line_no").agg(joined.alias("line_text"))


def suppress_overlaps(blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression for each document, best confidence first (then block order); what stays
    is numbered by (y_min, x_min)."""
    item = F.struct((-F.col("confidence")).alias("c"), F.col("block_idx").alias("i"), "bbox", "text", "confidence")
    ordered = F.sort_array(F.collect_list(item))
    kind = "array<struct<c:double,i:bigint,bbox:array<int>,text:string,confidence:double>>"
    lists = blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("text"), F.col("confidence").cast("double"), F.col("bbox").cast("array<int>"))
    lists = lists.groupBy("doc_id").agg(ordered.cast(kind).alias("all_"))

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: geometry.iou(k["bbox"], b["bbox"]) >= threshold)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all_", F.array().cast(kind), step)
    placed = F.sort_array(F.transform(kept, lambda b: F.struct(b["bbox"][1].alias("y"), b["bbox"][0].alias("x"), b["i"].alias("i"), b.alias("b"))))
    out = lists.select("doc_id", F.posexplode(placed).alias("pos", "p"))
    return out.select("doc_id", "pos", F.col("p.b.i").alias("block_idx"), F.col("p.b.text").alias("text"), F.col("p.b.confidence").alias("confidence"), F.col("p.b.bbox").alias("bbox"))


def merge_languages(*runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Blocks of several OCR languages in one table, overlaps removed; a failed language is an empty run."""
    every = runs[0].withColumn("run_", F.lit(0))
    for k, run in enumerate(runs[1:], 1):
        every = every.unionByName(run.withColumn("run_", F.lit(k)))
    place = Window.partitionBy("doc_id").orderBy("run_", "block_idx")
    return suppress_overlaps(every.withColumn("block_idx", F.row_number().over(place) - 1).drop("run_"), threshold)


def text_near(blocks: DataFrame, keyword: str, radius: float = 200, case_sensitive: bool = False) -> DataFrame:
    """Blocks within ``radius`` of each block that contains the keyword, as often as there are such anchors.

    A band join on one page's blocks: the equi-join key is the document and a grid cell as wide as the radius,
    so only neighbouring cells meet, however many blocks a document has."""
    hay = F.col("text") if case_sensitive else F.lower("text")
    needle = keyword if case_sensitive else keyword.lower()
    df = blocks.withColumn("cx_", geometry.centre_x(F.col("bbox"))).withColumn("cy_", geometry.centre_y(F.col("bbox")))
    cell = lambda c: F.floor(F.col(c) / max(radius, 1)).cast("long")
    anchors = df.where(F.contains(hay, F.lit(needle))).select(F.col("doc_id").alias("d"), F.col("block_idx").alias("anchor_idx"), F.col("cx_").alias("ax"), F.col("cy_").alias("ay"), cell("cx_").alias("gx"), cell("cy_").alias("gy"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    anchors = anchors.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    anchors = anchors.select("d", "anchor_idx", "ax", "ay", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    df = df.withColumn("bx", cell("cx_")).withColumn("by", cell("cy_"))
    near = df.join(anchors, (F.col("doc_id") == F.col("d")) & (F.col("bx") == F.col("gx")) & (F.col("by") == F.col("gy")))
    near = near.where((F.col("block_idx") != F.col("anchor_idx")) & (F.abs(F.col("cx_") - F.col("ax")) <= radius) & (F.abs(F.col("cy_") - F.col("ay")) <= radius))
    return near.select("doc_id", "anchor_idx", "block_idx", "text")


def region_text(blocks: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """(doc_id, region_text): blocks whose centre lies in the region, in block order."""
    inside = blocks.where(geometry.in_region(F.col("bbox"), x1, y1, x2, y2))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"]), " ")
    return inside.groupBy("doc_id").agg(joined.alias("region_text"))


def confident(blocks: DataFrame, threshold: float = 0.3) -> DataFrame:
    return blocks.where(F.col("confidence") >= threshold)


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, full_text): blocks joined by single spaces in block order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"]), " ")
    return blocks.groupBy("doc_id").agg(joined.alias("full_text"))


# The field parser.  A page's blocks are collected once; each field is an expression on that array, so the whole parser
# is one shuffle by document.

_LINE = "struct<y:double,items:array<struct<x:double,y:double,i:bigint,t:string>>>"


def pages_of(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """(doc_id, b, h): a page's blocks in block order, texts composed, and the page's height (9999 if unknown)."""
    # a text that is composed already goes along once; rows are dealt before they are collected, as lists don't get smaller
    df = blocks.withColumn("composed_", text.nfc(F.col("text")) if compose else F.col("text")).withColumn("raw_", F.col("text") if compose else F.lit(None).cast("string"))
    box = F.col("bbox")
    item = F.struct(
        F.col("block_idx").cast("long").alias("i"), F.col("composed_").alias("t"), F.col("raw_").alias("raw"), F.col("confidence").cast("double").alias("c"),
        box[0].cast("double").alias("x1"), box[1].cast("double").alias("y1"), box[3].cast("double").alias("y2"), geometry.centre_y(box).cast("double").alias("cy"),
    )
    height = F.max(F.when(F.col("image_h") > 0, F.col("image_h")).otherwise(9999))
    return df.select("doc_id", item.alias("item_"), "image_h").repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list("item_")).alias("b"), height.alias("h"))


def _raw(x: Column) -> Column:
    return F.coalesce(x["raw"], x["t"])


def _full(b: Column) -> Column:
    return F.array_join(F.transform(b, lambda x: x["t"]), " ")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _has(words: list[str]):
    """Whether a text has one of the words; its lower case is made once."""
    return lambda t: _let(F.lower(t), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in words]))


def _lines(b: Column, tolerance: float = 12) -> Column:
    """Texts of a page's lines, top to bottom: gaps and islands over centre_y, as a fold over the sorted blocks."""
    order = F.sort_array(F.transform(b, lambda x: F.struct(x["cy"].alias("cy"), x["i"].alias("i"), x["x1"].alias("x"), x["t"].alias("t"))))
    item = lambda x: F.struct(x["x"].alias("x"), x["cy"].alias("y"), x["i"].alias("i"), x["t"].alias("t"))
    kind = f"array<{_LINE}>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        here = F.struct(x["cy"].alias("y"), F.array_append(last["items"], item(x)).alias("items"))
        new = F.array_append(done, F.struct(x["cy"].alias("y"), F.array(item(x)).alias("items")))
        return F.when((F.size(done) == 0) | (x["cy"] - F.try_element_at(done, F.lit(-1))["y"] > tolerance), new).otherwise(F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), here))

    return F.transform(F.aggregate(order, F.array().cast(kind), step), lambda line: F.array_join(F.transform(F.sort_array(line["items"]), lambda x: x["t"]), " "))


def _hp(b: Column) -> Column:
    """The most frequent horse power over the whole text and then the blocks; of equally frequent ones, the first."""
    seen = F.filter(F.concat(F.array(amounts.extract_hp(_full(b), False)), F.transform(b, lambda x: amounts.extract_hp(x["t"], False))), lambda v: v.isNotNull())

    def best(values: Column) -> Column:
        each = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("f"), v.alias("v")))
        top = F.array_max(each)
        return F.struct(top["v"].alias("value"), F.when(top.isNotNull(), F.least(F.lit(0.95), 0.6 + top["n"] * 0.15)).alias("confidence"))

    return _let(seen, best)


def _dealer(b: Column, h: Column) -> Column:
    """The longest candidate in the top three tenths of the page, or in its first eight blocks."""
    top = F.filter(b, lambda x: x["y2"] <= h * 0.3)
    first = F.slice(F.array_sort(b, lambda p, q: F.when(p["y1"] != q["y1"], F.when(p["y1"] < q["y1"], -1).otherwise(1)).when(p["i"] < q["i"], -1).when(p["i"] > q["i"], 1).otherwise(0)), 1, 8)
    chosen = F.filter(F.when(F.size(top) > 0, top).otherwise(first), lambda x: text.is_dealer_candidate(_raw(x)))
    pick = F.array_max(F.transform(chosen, lambda x: F.struct(F.length(_raw(x)).alias("n"), (-x["y1"]).alias("y"), (-x["i"]).alias("i"), x["t"].alias("t"), x["c"].alias("c"))))

    def named(p: Column) -> Column:
        return _let(text.normalise_dealer_name(p["t"], False), lambda name: F.when(F.length(name) >= 3, F.struct(name.alias("value"), F.least(F.lit(0.9), 0.5 + p["c"] * 0.4).alias("confidence"))))

    return _let(pick, named)


def _model(b: Column, lines: Column) -> Column:
    """A labelled name (.85), else the first short line with a brand (.75)."""

    def labelled(full: Column) -> Column:
        found = []
        for pattern in MODEL_LABELS:
            raw = text.strip(F.regexp_extract(full, f"(?iU){pattern}(.{{3,60}})", 1))
            found.append(F.nullif(text.strip(F.get(F.split(raw, r"[\n\r]"), F.lit(0))), F.lit("")))
        return text.clean_text(F.coalesce(*found), False)

    short = F.filter(F.transform(F.filter(lines, _has(text.BRANDS)), lambda t: text.clean_text(t, False)), lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != "")) <= 8)
    both = F.array(F.struct(_let(_full(b), labelled).alias("value"), F.lit(0.85).alias("confidence")), F.struct(F.get(short, F.lit(0)).alias("value"), F.lit(0.75).alias("confidence")))
    return F.get(F.filter(both, lambda m: m["value"].isNotNull()), F.lit(0))


def _cost(b: Column, lines: Column, h: Column) -> Column:
    """The first plausible amount of a row of totals (.90), the largest of the bottom half (.70), of the page (.55)."""
    total = F.filter(F.transform(F.filter(lines, _has(text.TOTAL_WORDS)), lambda t: F.get(F.filter(amounts.extract_all_amounts(t, False), amounts.plausible), F.lit(0))), lambda v: v.isNotNull())
    largest = lambda part: amounts.largest_plausible(amounts.extract_all_amounts(_full(part), False))
    tries = [(F.get(total, F.lit(0)), 0.90), (largest(F.filter(b, lambda x: x["y1"] >= h * 0.5)), 0.70), (largest(b), 0.55)]
    found = F.lit(None).cast("struct<value:bigint,confidence:double>")
    for value, confidence in reversed(tries):
        found = _let(value, _or(confidence, found))
    return found


def _or(confidence: float, rest: Column):
    return lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(confidence).alias("confidence"))).otherwise(rest)


def _field(pages: DataFrame, name: str, found: Column) -> DataFrame:
    df = pages.select("doc_id", found.alias("f")).where("f.value is not null")
    return df.select("doc_id", F.col("f.value").alias(name), F.col("f.confidence").alias(f"{name}_confidence"))


def hp_mode(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """(doc_id, hp, hp_confidence) of the documents that have one."""
    return _field(pages_of(blocks, compose), "hp", _hp(F.col("b")))


def dealer_names(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """(doc_id, dealer, dealer_confidence) of the documents that have one."""
    return _field(pages_of(blocks, compose), "dealer", _dealer(F.col("b"), F.col("h")))


def model_names(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """(doc_id, model, model_confidence) of the documents that have one."""
    pages = pages_of(blocks, compose).withColumn("l", _lines(F.col("b")))
    return _field(pages, "model", _model(F.col("b"), F.col("l")))


def asset_costs(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """(doc_id, cost, cost_confidence) of the documents that have one."""
    pages = pages_of(blocks, compose).withColumn("l", _lines(F.col("b")))
    return _field(pages, "cost", _cost(F.col("b"), F.col("l"), F.col("h")))


def parse_fields(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """One row per document with the four fields and their confidences; nothing found is null and 0."""
    b, lines, h = F.col("b"), F.col("l"), F.col("h")
    pages = pages_of(blocks, compose).withColumn("l", _lines(b))
    found = pages.select("doc_id", _dealer(b, h).alias("dealer"), _model(b, lines).alias("model"), _hp(b).alias("hp"), _cost(b, lines, h).alias("cost"))
    names = ("dealer", "model", "hp", "cost")
    return found.select("doc_id", *[F.col(n)["value"].alias(n) for n in names], *[F.coalesce(F.col(n)["confidence"], F.lit(0.0)).alias(f"{n}_confidence") for n in names])
