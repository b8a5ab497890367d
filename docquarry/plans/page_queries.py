"""Queries over page content: field parsing, boxes, names of files, raw recognition, signature zones, images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import amounts, coerce, geometry, text
from ..operators import blocks as block_ops
from ..operators import images, portfolio, records, signatures
from ..sources import documents, models
from .catalog import B, BLOCKS, DEALER_INPUT, HP_SQL, RESPONSE, STROKE_OK, STROKES, _blocks, _strokes, best_sql, star_sql
from .registry import derived, query, table

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"

# The field parser, part by part and whole.  Texts of the derived blocks are ASCII.

_FORMS = r"(?i)\b(?:pvt\.?\s*ltd\.?|ltd\.?|private\s+limited|limited|co\.?|company|enterprises?|traders?|agency|agencies|prop\.?)\b"
_TITLE = "list_aggregate(list_transform(regexp_extract_all({}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '')"
DEALERS = (
    r"""p1 as (select *, y2 <= 120 * 0.3 as top_, row_number() over (partition by doc_id order by y1, block_idx) as r_ from b),
  p2 as (select *, bool_or(top_) over (partition by doc_id) as any_ from p1),
  p3 as (select *, row_number() over (partition by doc_id order by length(text) desc, y1, block_idx) as pick from p2
    where (top_ or (not any_ and r_ <= 8)) and length(trim(text)) >= 3 and not regexp_matches(trim(text), '\b\d{15}\b|\d{10}|\d{2}[/-]\d{2}[/-]\d{2,4}|^\d+$')),
  p4 as (select doc_id, confidence, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.([A-Za-z])', '. \1', 'g'), '"""
    + _FORMS
    + r"""', '', 'g'), '\s+', ' ', 'g')), '[.,/\\\-]+$', '') as t from p3 where pick = 1),
  dealers as (select doc_id, """
    + _TITLE.format("t")
    + " as dealer, least(0.9, 0.5 + confidence * 0.4)::double as dealer_confidence from p4 where length(t) >= 3)"
)
LINES = """n as (select *, case when cy - lag(cy) over w > 12 then 1 else 0 end as new_ from b window w as (partition by doc_id order by cy, block_idx)),
  n2 as (select *, sum(new_) over (partition by doc_id order by cy, block_idx rows unbounded preceding) as line_no from n),
  lines as (select doc_id, line_no, string_agg(text, ' ' order by x1, cy, block_idx) as line from n2 group by 1, 2)"""
BRANDED = "(" + " or ".join(f"contains(lower(line), '{b}')" for b in text.BRANDS) + ")"
TOTALS = "(" + " or ".join(f"contains(lower(line), '{w}')" for w in text.TOTAL_WORDS) + ")"
# no text of the derived blocks has a label before a model name, so lines with a brand decide
MODELS = f"models as (select doc_id, arg_min(line, line_no) as model, 0.75::double as model_confidence from lines where {BRANDED} and len(string_split(line, ' ')) <= 8 group by 1)"
_AMOUNT = r"""try_cast(split_part(replace(regexp_replace(regexp_replace(regexp_replace(m, '[₹Rr][sS]\.?\s*', '', 'g'), '[^\d.,]', '', 'g'), '[,.\-/\\]+$', ''), ',', ''), '.', 1) as bigint)"""
_FOUND = r"regexp_extract_all({}, '\b\d{{1,3}}(?:[,\s]\d{{2,3}})*(?:\.\d{{1,2}})?/?\-?\b')"
COSTS = f"""t1 as (select doc_id, line_no, unnest({_FOUND.format("line")}) as m from lines where {TOTALS}),
  t2 as (select doc_id, line_no, max({_AMOUNT}) as v from (select * from t1) where {_AMOUNT} between 50000 and 50000000 group by 1, 2),
  t3 as (select doc_id, arg_min(v, line_no) as v1 from t2 group by 1),
  h1 as (select doc_id, string_agg(text, ' ' order by block_idx) filter (y1 >= 120 * 0.5) as low, string_agg(text, ' ' order by block_idx) as whole from b group by 1),
  h2 as (select doc_id, max({_AMOUNT}) as v2 from (select doc_id, unnest({_FOUND.format("low")}) as m from h1) where {_AMOUNT} between 50000 and 50000000 group by 1),
  h3 as (select doc_id, max({_AMOUNT}) as v3 from (select doc_id, unnest({_FOUND.format("whole")}) as m from h1) where {_AMOUNT} between 50000 and 50000000 group by 1),
  costs as (select doc_id, coalesce(v1, v2, v3) as cost, case when v1 is not null then 0.9 when v2 is not null then 0.7 else 0.55 end::double as cost_confidence
    from h1 left join t3 using (doc_id) left join h2 using (doc_id) left join h3 using (doc_id) where coalesce(v1, v2, v3) is not null)"""
POWERS = f"""f as (select doc_id, string_agg(text, ' ' order by block_idx) as t from b group by 1),
  v as (select doc_id, -1 as pos, {HP_SQL.format("t")} as v from f union all select doc_id, block_idx, {HP_SQL.format("text")} from b),
  g as (select doc_id, v, count(*) as n, min(pos) as first_ from v where v between 5 and 200 group by 1, 2),
  powers as (select doc_id, arg_max(v, (n, -first_)) as hp, least(0.95, 0.6 + max(n) * 0.15)::double as hp_confidence from g group by 1)"""
BB = B.rstrip() + ", "


def _sure(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(BB + DEALERS + " select doc_id, dealer, round(dealer_confidence, 9) as dealer_confidence from dealers")
def dealer_names(spark: SparkSession, sf: str) -> DataFrame:
    return _sure(block_ops.dealer_names(_blocks(spark, sf), compose=False), "dealer_confidence")


@query(BB + LINES + ", " + MODELS + " select * from models")
def model_names(spark, sf):
    return block_ops.model_names(_blocks(spark, sf), compose=False)


@query(BB + LINES + ", " + COSTS + " select * from costs")
def asset_costs(spark, sf):
    return block_ops.asset_costs(_blocks(spark, sf), compose=False)


@query(
    BB + DEALERS + ", " + LINES + ", " + MODELS + ", " + COSTS + ", " + POWERS
    + """ select d.doc_id, dealer, model, hp, cost, round(coalesce(dealer_confidence, 0), 9) as dealer_confidence, coalesce(model_confidence, 0) as model_confidence,
  round(coalesce(hp_confidence, 0), 9) as hp_confidence, coalesce(cost_confidence, 0) as cost_confidence
  from (select distinct doc_id from b) d left join dealers using (doc_id) left join models using (doc_id) left join powers using (doc_id) left join costs using (doc_id)"""
)
def parse_fields(spark, sf):
    return _sure(block_ops.parse_fields(_blocks(spark, sf), compose=False), "dealer_confidence", "hp_confidence")


@query(BB + LINES + f" select doc_id, line_no::bigint as line_no, {BRANDED} as brand, {TOTALS} as total from lines")
def marked_lines(spark, sf):
    """Brand lookup and rows of totals, line by line."""
    lines = block_ops.line_texts(_blocks(spark, sf))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.has_brand(F.col("line_text")).alias("brand"), text.is_total_row(F.col("line_text")).alias("total"))


@query(
    BB.rstrip(", ")
    + """ select doc_id, block_idx, [x1 - 30, y1 + 7, x2 - 30, y2 + 7]::int[] as moved, [greatest(0, x1 - 30), greatest(0, y1 + 7), least(60, x2 - 30), least(50, y2 + 7)]::int[] as clipped,
  [greatest(least(x1, x1 - 9) - 5, 0), greatest(least(y1, y1 + 3) - 5, 0), greatest(x2, x2 - 9) + 5, greatest(y2, y2 + 3) + 5]::int[] as around,
  [least(x1, x2 + 4), least(y1, y2 - 2), greatest(x1, x2 + 4), greatest(y1, y2 - 2)]::int[] as polygon from b"""
)
def box_helpers(spark, sf):
    """Shifted, clipped, padded and polygon boxes."""
    df = _blocks(spark, sf).select("doc_id", "block_idx", "bbox")
    b = F.col("bbox")
    moved = geometry.offset(b, -30, 7)
    around = geometry.padded_union(F.array(b, geometry.offset(b, -9, 3)), 5)
    corners = F.array(F.array(b[0], b[1]), F.array(b[2] + 4, b[3] - 2))
    out = {"moved": moved, "clipped": geometry.clamp(moved, 60, 50), "around": around, "polygon": geometry.polygon_box(corners)}
    return df.select("doc_id", "block_idx", *[c.cast("array<int>").alias(n) for n, c in out.items()])


POWER_TEXTS = """p_partkey, case p_partkey % 8 when 0 then concat('HP....', cast(p_size as varchar(10))) when 1 then concat('300 HP ', cast(p_size as varchar(10)), ' h.p.') when 2 then concat('Horse Power: ', cast(p_size * 7 as varchar(10)))
  when 3 then concat('हा. पा. - ', cast(p_size as varchar(10))) when 4 then concat('php ', cast(p_size as varchar(10))) when 5 then concat(cast(p_size as varchar(10)), '-hp, horse  power 60') when 6 then concat('40', cast(p_size as varchar(10)), 'HP') else 'no power' end as said"""
_POWER_PATTERNS = [r"(\d{1,3})\s*[-–]?\s*[Hh]\.?\s*[Pp]\.?", r"[Hh]\.?\s*[Pp]\.?\s*[-:.\s]*\s*(\d{1,3})", r"हा\.?\s*पा\.?\s*[-:.\s]*\s*(\d{1,3})", r"[Hh]orse\s+[Pp]ower\s*[-:.\s]*\s*(\d{1,3})"]


@query(
    f"with t as (select p_partkey, regexp_replace(said, '\\s+', ' ', 'g') as t from (select {POWER_TEXTS} from part)) select p_partkey, list_filter(["
    + ", ".join(f"try_cast(nullif(regexp_extract(t, '(?i){x}', 1), '') as int)" for x in _POWER_PATTERNS)
    + "], lambda v: v between 5 and 200)[1] as hp from t"
)
def extract_hp_patterns(spark, sf):
    """Every pattern of horse power, and which of them goes first."""
    return derived(spark, sf, "part", POWER_TEXTS).select("p_partkey", amounts.extract_hp(F.col("said"), compose=False).alias("hp"))


# Names of files, raw recognition, answers of the labeller.

PATHS = """o_orderkey, concat('/scans/', o_orderstatus, '/page ', cast(o_orderkey as varchar(20)), case o_orderkey % 6 when 0 then '.pdf' when 1 then '.PNG' when 2 then '.v2.Jpeg' when 3 then '.txt' when 4 then '' else '.webp' end) as path"""


@query(
    f"with p as (select {PATHS} from orders), "
    r"""s as (select *, lower(regexp_extract(path, '(\.[^./]*)$', 1)) as suffix from p)
  select o_orderkey, suffix, regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1) as doc_id, suffix in ('.pdf', '.png', '.jpg', '.jpeg', '.tiff') as in_batch, suffix in ('.jpg', '.jpeg', '.png', '.webp', '.bmp') as in_labels,
  case when suffix = '.pdf' then 'pdf' when suffix in ('.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp', '.webp') then 'image' else 'other' end as kind from s"""
)
def file_kinds(spark, sf):
    """Identifiers, suffix filters of both scans, and dispatch by kind."""
    files = derived(spark, sf, "orders", PATHS)
    kinds = documents.dispatch(files)
    tagged = [df.withColumn("kind", F.lit(k)) for df, k in zip(kinds, ("pdf", "image", "other"), strict=True)]
    df = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).withColumn("suffix", documents.suffix(F.col("path")))
    return df.select("o_orderkey", "suffix", text.doc_id_from_path(F.col("path")).alias("doc_id"), F.col("suffix").isin(documents.BATCH_SUFFIXES).alias("in_batch"), F.col("suffix").isin(documents.LABEL_SUFFIXES).alias("in_labels"), "kind")


@query("select page, o_orderkey, row_number() over (order by path) - 1 as pos from (select o_orderkey, concat('/in/', lpad((o_orderkey * 7919 % 1000003)::varchar, 7, '0'), '-', o_orderkey::varchar) as path, o_orderkey % 3 + 1 as page from orders) where page = 1")
def page_positions(spark, sf):
    """First pages of files, numbered in the order of their paths."""
    files = derived(spark, sf, "orders", "o_orderkey, concat('/in/', lpad(cast(o_orderkey * 7919 % 1000003 as varchar(20)), 7, '0'), '-', cast(o_orderkey as varchar(20))) as path, o_orderkey % 3 + 1 as page_no")
    return documents.positions(documents.first_pages(files)).select(F.col("page_no").alias("page"), "o_orderkey", "pos")


RAW = """cast(l_orderkey as varchar(20)) as doc_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) as block_idx, case when l_partkey % 5 = 0 then null when l_partkey % 5 = 1 then '  ' else concat(' word ', l_linestatus) end as text,
  case when l_partkey % 5 = 0 then 'rec ' || l_returnflag end as rec_text, case when l_suppkey % 4 = 0 then 'n/a' else cast(l_suppkey % 100 as varchar(10)) end as confidence, l_suppkey % 3 as kind, l_partkey % 300 as px, l_suppkey % 200 as py"""


@query(
    f"with r as (select {RAW} from lineitem) select doc_id, block_idx, trim(coalesce(rec_text, text)) as text, coalesce(try_cast(confidence as double), 0) as confidence, "
    "case when kind = 0 then [px, py, px + 9, py + 5] else [px - 2, py, px + 7, py + 6] end::int[] as bbox from r where kind < 2 and trim(coalesce(rec_text, text)) <> ''"
)
def raw_blocks(spark, sf):
    """Two raw layouts of recognised text to blocks; rows of neither have no box."""
    raw = derived(spark, sf, "lineitem", RAW)
    x, y = F.col("px"), F.col("py")
    points = F.array(F.array(x, y), F.array(x + 7, y + 1), F.array(x + 5, y + 6), F.array(x - 2, y + 4))
    raw = raw.withColumn("box", F.when(F.col("kind") == 0, F.array(x, y, x + 9, y + 5))).withColumn("polygon", F.when(F.col("kind") == 1, points))
    return models.normalise_raw(raw)


@query(
    f"with r as (select {RESPONSE} from orders), "
    r"""p as (select o_orderkey, raw, list_filter(list_transform(string_split(raw, '```'), lambda p: trim(regexp_replace(trim(p), '^json\s*', ''))), lambda p: starts_with(p, '{')) as parts from r)
  select o_orderkey, coalesce(parts[1], trim(raw)) as part, lower(case o_orderkey % 4 when 0 then 'True' when 1 then 'false' when 2 then 'yes' end) is not distinct from 'true' as flag from p"""
)
def labeller_answers(spark, sf):
    df = derived(spark, sf, "orders", RESPONSE + ", case o_orderkey % 4 when 0 then 'True' when 1 then 'false' when 2 then 'yes' end as said")
    return df.select("o_orderkey", coerce.fenced_part(F.col("raw")).alias("part"), coerce.safe_bool(F.col("said")).alias("flag"))


@query(f"with r as (select {RESPONSE} from orders) select count(*) filter (o_orderkey % 7 <> 3) as succeeded, count(*) filter (o_orderkey % 7 = 3) as failed from r")
def label_summary(spark, sf):
    """Every answer whose first {{...}} is no JSON failed: those with a brace too many."""
    df = derived(spark, sf, "orders", RESPONSE).select("o_orderkey", coerce.parse_json(F.col("raw")).alias("v"))
    return portfolio.label_summary(df.select(F.when(F.col("v").isNull(), "no JSON").alias("error")))


KEYS = """o_orderkey, concat('{', case when o_orderkey % 2 = 0 then '"doc_id": 1, ' else '' end, case when o_orderkey % 3 = 0 then '"fields": {"doc_id": 2}, ' else '' end, '"confidence": ', cast(o_orderkey % 5 as varchar(5)), case when o_orderkey % 7 = 0 then '' else '}' end) as json"""


@query(
    f"with k as (select {KEYS} from orders) select o_orderkey, list_aggregate(list_filter(['doc_id', 'fields', 'confidence', 'processing_time_sec', 'cost_estimate_usd'], "
    "lambda x: not coalesce(list_contains(json_keys(case when json_valid(json) then json end), x), false)), 'string_agg', ',') as missing from k"
)
def missing_keys(spark, sf):
    return derived(spark, sf, "orders", KEYS).select("o_orderkey", F.array_join(records.missing_in(F.col("json")), ",").alias("missing"))


# two names match whole where their keys hold one another or have the same words; the first dealer that does is taken
@query(
    f"with d as (select {DEALER_INPUT} from supplier), k0 as (select s_suppkey, raw, lower(raw) as k from d), "
    r"""k1 as (select *, trim(regexp_replace(k, '\s+', ' ', 'g')) as a1 from k0), k2 as (select *, trim(regexp_replace(a1, '\bpvt\.?\s*ltd\.?\b', '', 'g')) as a2 from k1),
  k3 as (select *, trim(regexp_replace(a2, '\bltd\.?\b', '', 'g')) as a3 from k2), k4 as (select *, trim(regexp_replace(a3, '\bco\.?\b', '', 'g')) as a4 from k3),
  k5 as (select *, trim(regexp_replace(a4, '\bprivate\s+limited\b', '', 'g')) as a5 from k4), k6 as (select *, trim(regexp_replace(a5, '\blimited\b', '', 'g')) as a6 from k5),
  k7 as (select *, trim(regexp_replace(a6, '\btraders?\b', '', 'g')) as a7 from k6), k8 as (select *, trim(regexp_replace(a7, '\bagenc(?:y|ies)\b', '', 'g')) as a8 from k7),
  keyed as (select s_suppkey, raw, trim(regexp_replace(regexp_replace(a8, '\benterprises?\b', '', 'g'), '\s+', ' ', 'g')) as key from k8),
  u as (select key, list_aggregate(list_sort(string_split(key, ' ')), 'string_agg', ' ') as words, min(struct_pack(pos := s_suppkey, key := key, raw := raw)) as m from keyed where key <> '' group by 1),
  n as (select distinct length(key) as n from u), parts as (select distinct key, substr(key, i, n) as part from (select key, n, unnest(generate_series(1, length(key) - n + 1)) as i from u, n where n <= length(key))),
  hits as (select part as key, m from parts join u using (key) where part in (select key from u) union all select parts.key, m from parts join u on part = u.key union all select a.key, b.m from u a join u b using (words)),
  best as (select key, min(m) as m from hits group by 1)
  select s_suppkey, upper(raw) as name, m.raw as matched, case when m is null then 0 else 100 end::double as score, coalesce(m.raw, upper(raw)) as resolved from keyed left join best using (key)"""
)
def resolve_names(spark, sf):
    """Names in capitals find themselves, or an earlier dealer with as much of a name, in the list of all dealers and are
    resolved to its spelling."""
    from ..operators import matching

    raw = derived(spark, sf, "supplier", DEALER_INPUT)
    names = raw.select("s_suppkey", F.upper("raw").alias("name"))
    master = raw.select(F.col("s_suppkey").alias("pos"), F.col("raw").alias("name"))
    return matching.resolve(names, master, "model").select("s_suppkey", "name", "matched", "score", "resolved")


# Signatures: words that announce them, zones, and the cascade over the ink in the zones.

SIGNED = BLOCKS[: BLOCKS.index("concat(case when l_partkey % 4 = 0")] + """case l_partkey % 9 when 0 then 'Authorised Signatory' when 1 then 'For Shop Motors' when 2 then 'Prop. Ram' when 3 then 'signed copy' when 4 then 'before tax'
    when 5 then 'Manager' else concat('Item ', cast(l_suppkey as varchar(20))) end as text,
  cast(1 as double) as confidence, l_suppkey % 80 * 4 as x1, l_partkey % 70 * 4 as y1, l_suppkey % 80 * 4 + 60 as x2, l_partkey % 70 * 4 + 14 as y2"""
PAGE_W, PAGE_H = 480, 380


def _any(words: list[str]) -> str:
    return "(" + " or ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in words) + ")"


ANCHORS = f"""with b as (select {SIGNED} from lineitem),
  k as (select *, {_any(signatures.PRIMARY_ANCHORS)} as p, {_any(signatures.SECONDARY_ANCHORS)} as s, {_any(signatures.FOR_ANCHORS)} as f from b),
  low as (select doc_id, coalesce(arg_max(block_idx, (y2, -block_idx)) filter (p), arg_max(block_idx, (y2, -block_idx)) filter (s)) as anchor, arg_max(block_idx, (y2, -block_idx)) filter (f) as for_anchor from k group by 1),
  anchors as (select a.doc_id, kind, b.block_idx, x1, y1, x2, y2 from (unpivot low on anchor, for_anchor into name kind value block_idx) a join b on a.doc_id = b.doc_id and a.block_idx = b.block_idx)"""
ZONES = ANCHORS + f""", d as (select distinct doc_id from b),
  zones as (select doc_id, 'anchor' as method, greatest(0, x1 - 100) as zx1, greatest(0, y1 - 220) as zy1, least({PAGE_W}, x2 + 100) as zx2, least({PAGE_H}, y2 + 20) as zy2 from anchors where kind = 'anchor'
    union all select doc_id, 'for_anchor', greatest(0, x1 - 20), greatest(0, y1 - 20), {PAGE_W}, least({PAGE_H}, y2 + 220) from anchors where kind = 'for_anchor'
    union all select doc_id, 'bottom_scan', 0, floor({PAGE_H} * 0.6)::bigint, {PAGE_W}, {PAGE_H} from d union all select doc_id, 'curvature', 0, floor({PAGE_H} * 0.55)::bigint, {PAGE_W}, {PAGE_H} from d)"""


def _signed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = derived(spark, sf, "lineitem", SIGNED)
    blocks = df.select("doc_id", "block_idx", "text", "confidence", F.array(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"))
    pages = blocks.select("doc_id").distinct().select("doc_id", F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"))
    return blocks, pages


@query(ANCHORS + " select doc_id, kind, block_idx, [x1, y1, x2, y2]::int[] as bbox from anchors")
def signature_anchors(spark, sf):
    return signatures.anchors(_signed(spark, sf)[0])


@query(ZONES + " select doc_id, method, [zx1, zy1, zx2, zy2]::int[] as zone from zones")
def signature_zones(spark, sf):
    blocks, pages = _signed(spark, sf)
    return signatures.zones(pages, blocks)


@query(
    ZONES
    + f""", q as (select *, floor(x + w / 2)::bigint as cx, floor(y + h / 2)::bigint as cy from (select {STROKES} from lineitem) where {STROKE_OK}),
  s as (select z.doc_id, z.method, case when z.method = 'bottom_scan' then 60 else 80 end as gap, q.* exclude (doc_id) from zones z join q using (doc_id) where x >= zx1 and y >= zy1 and x + w <= zx2 and y + h <= zy2), """
    + star_sql("s", "doc_id, method, gap", "gap") + ", " + best_sql("s", "doc_id, method")
    + f""", r2 as (select *, row_number() over (partition by doc_id order by list_position(['anchor', 'for_anchor', 'bottom_scan', 'curvature'], method)) as o from best)
  select d.doc_id, r2.doc_id is not null as present, case method when 'anchor' then 0.87 when 'for_anchor' then 0.82 when 'bottom_scan' then 0.7 when 'curvature' then 0.65 else 0.7 end::double as confidence, coalesce(method, 'none') as method,
  case when r2.doc_id is not null then [greatest(0, x1 - 14), greatest(0, y1 - 14), least({PAGE_W}, x2 + 14), least({PAGE_H}, y2 + 14)]::bigint[] end as bbox from d left join r2 on d.doc_id = r2.doc_id and o = 1"""
)
def signature_detection(spark, sf):
    """From words on the page to the first strategy that finds a signature: anchors, zones, strokes, clusters, cascade."""
    blocks, pages = _signed(spark, sf)
    ink = signatures.strokes_in(signatures.zones(pages, blocks), _strokes(spark, sf))
    return signatures.detect(pages, ink).withColumn("bbox", F.col("bbox").cast("array<bigint>"))


# Images: small pages whose pixels follow from the row.

SIDE = 12
_PIXEL = "(p_partkey * 37 + (i // 12) * (i // 12) * 11 + (i % 12) * (p_partkey % 7) * 5 + c * 83) % 256"


PAGES = 10_000  # pages that one task makes


@F.pandas_udf(BinaryType())
def _pixels(key: pd.Series) -> pd.Series:
    """The bytes of the page of each part: sums modulo 256, so bytes that wrap do."""
    y, x, c = np.mgrid[:SIDE, :SIDE, :3].reshape(3, -1)
    patterns = np.array([(y * y * 11 + x * k * 5 + c * 83) % 256 for k in range(7)], dtype=np.uint8)
    k = key.fillna(0).to_numpy(dtype=np.int64)
    data = ((k * 37 % 256).astype(np.uint8)[:, None] + patterns[k % 7]).tobytes()
    return pd.Series([data[i : i + len(y)] for i in range(0, len(data), len(y))], dtype=object).where(key.notna().to_numpy(), None)


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of SIDE by SIDE pixels in Spark's layout (BGR), one for each part.

    Keys are dealt over tasks by the number of pages: a small file of keys, which one task reads, makes many pages."""
    parts = table(spark, sf, "part").select("p_partkey")
    parts = parts.repartition(max(1, -(-parts.count() // PAGES)), "p_partkey")
    image = F.struct(F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(3).alias("nChannels"), _pixels("p_partkey").alias("data"))
    return parts.select(F.col("p_partkey").cast("string").alias("doc_id"), image.alias("image"))


@query(
    f"""with x as (select p_partkey, i, round_even({_PIXEL.replace("c * 83", "0")} * 0.114::double + {_PIXEL.replace("c * 83", "83")} * 0.587::double + {_PIXEL.replace("c * 83", "166")} * 0.299::double, 0)::int as g
    from part, (select unnest(generate_series(0, {SIDE * SIDE - 1})) as i)),
  e as (select p_partkey, v from (select distinct p_partkey from x), (select unnest(generate_series(0, 255)) as v)),
  h as (select p_partkey, v, coalesce(n, 0) as n from e left join (select p_partkey, g as v, count(*) as n from x group by 1, 2) using (p_partkey, v)),
  s as (select *, sum(n) over w as below, sum(n * v) over w as mass, sum(n * v) over (partition by p_partkey) as whole from h window w as (partition by p_partkey order by v)),
  o as (select p_partkey, arg_max(v, (case when below in (0, {SIDE * SIDE}) then 0 else (whole * below - mass * {SIDE * SIDE})::double ** 2 / (below * ({SIDE * SIDE} - below)) end, -v)) as threshold from s group by 1),
  d as (select p_partkey, i // {SIDE} as y, i % {SIDE} as x, (g <= threshold)::int as ink from x join o using (p_partkey)),
  r as (select p_partkey, var_pop(n) as v from (select p_partkey, y, sum(ink) as n from d group by 1, 2) group by 1), c as (select p_partkey, var_pop(n) as v from (select p_partkey, x, sum(ink) as n from d group by 1, 2) group by 1),
  t as (select p_partkey, sum(g)::bigint as gray_sum, avg((g < 200)::int) as density from x group by 1)
  select p_partkey::varchar as doc_id, gray_sum, threshold::int as threshold, round(density, 9) as density, case when c.v > r.v + 1e-9 then 90 else 0 end as turned from t join o using (p_partkey) join r using (p_partkey) join c using (p_partkey)"""
)
def page_measures(spark, sf):
    """Gray, Otsu's threshold, share of ink and rotation of small images."""
    return images.page_measures(page_images(spark, sf)).withColumn("density", F.round("density", 9))


@query(
    """with s as (select o_orderkey, (o_orderkey * 7919 % 4000 + 100)::int as w, (o_orderkey * 104729 % 3500 + 100)::int as h from orders),
  f as (select *, case when greatest(w, h) > 2048 then 2048::double / greatest(w, h) when least(w, h) < 800 then 800::double / least(w, h) else 1.0::double end as s1, case when greatest(w, h) <= 1024 then 1.0::double else 1024::double / greatest(w, h) end as s2 from s)
  select o_orderkey, greatest(1, floor(w * case when abs(s1 - 1) < 0.01 then 1 else s1 end))::int as work_w, greatest(1, floor(h * case when abs(s1 - 1) < 0.01 then 1 else s1 end))::int as work_h,
  greatest(1, round_even(w * s2, 0))::int as model_w, greatest(1, round_even(h * s2, 0))::int as model_h from f"""
)
def page_sizes(spark, sf):
    """Working size of a page, and its size for the model."""
    df = derived(spark, sf, "orders", "o_orderkey, cast(o_orderkey * 7919 % 4000 + 100 as int) as w, cast(o_orderkey * 104729 % 3500 + 100 as int) as h")
    df = df.select("o_orderkey", geometry.working_size(F.col("w"), F.col("h")).alias("a"), geometry.model_size(F.col("w"), F.col("h"), 1024).alias("b"))
    return df.select("o_orderkey", F.col("a.w").alias("work_w"), F.col("a.h").alias("work_h"), F.col("b.w").alias("model_w"), F.col("b.h").alias("model_h"))


_AT = f"(select unnest(generate_series(0, {SIDE * SIDE - 1})) as i), (select unnest([0, 1, 2]) as c)"
_BOXED = "p_partkey % 4 as x1, p_partkey % 3 as y1, 6 + p_partkey % 5 as x2, 7 + p_partkey % 4 as y2"


@query(
    f"""with v as (select p_partkey, x1, y1, x2, y2, i % {SIDE} as x, i // {SIDE} as y, c, {_PIXEL} as v from (select p_partkey, {_BOXED} from part), {_AT}),
  d as (select *, x between x1 and x2 and y between y1 and y2 and (x in (x1, x2) or y in (y1, y2)) as line from v)
  select p_partkey::varchar as doc_id, sum(case when line then case when c = 1 then 200 else 0 end else v end)::bigint as drawn, coalesce(sum(v) filter (x >= x1 and x < x2 and y >= y1 and y < y2), 0)::bigint as part from d group by 1"""
)
def drawn_pages(spark, sf):
    """Pages with the outline of a box, and its content, through PNG files; the sums of their pixels."""
    shots = page_images(spark, sf)
    boxes = derived(spark, sf, "part", "cast(p_partkey as varchar(20)) as doc_id, " + _BOXED)
    boxes = boxes.select("doc_id", F.array(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"))
    return images.png_sums(images.drawn_pages(shots, boxes, thickness=1))


@query(
    "select cast(o_orderkey as varchar) as doc_id, 'page ' || o_orderkey::varchar || '.PDF' as name, case when o_orderkey % 3 = 0 then null else 'Model ' || (o_orderkey % 7)::varchar end as model_name, "
    "'false' as signed, 5 as keys from orders"
)
def downloads(spark, sf):
    """Records as JSON text under the name of the file that they came from."""
    df = derived(spark, sf, "orders", "cast(o_orderkey as varchar(20)) as doc_id, o_orderkey as k")
    none = F.lit(None)
    model = F.when(F.col("k") % 3 != 0, F.concat(F.lit("Model "), (F.col("k") % 7).cast("string")))
    df = df.select("doc_id", F.concat(F.lit("page "), F.col("doc_id"), F.lit(".PDF")).alias("file"), *records.record(none, model, none, none, none, none, none, none, F.lit(0.5), F.lit(0.0), F.lit(0.0)))
    df = df.select("doc_id", records.as_download(F.col("file")).alias("json"))
    get = lambda path: F.get_json_object("json", path)
    return df.select("doc_id", get("$.doc_id").alias("name"), get("$.fields.model_name").alias("model_name"), get("$.fields.signature.present").alias("signed"), F.size(F.json_object_keys("json")).alias("keys"))


# Engines: functions that stand in for text recognition, a vision-language model and a PDF renderer.


def _reader():
    def engine(data, height, width, channels):
        total = sum(data)
        if total % 5 == 0:
            raise ValueError("unreadable")
        return [(f"sum {total}", 0.9, [0, 0, width, height]), ("faint", 0.1, [0, 0, 1, 1])]

    return engine


def _model():
    def answer(data, height, width, channels, prompt):
        if data[0] % 4 == 0:
            raise ValueError("no answer")
        return '{"horse_power": %d}' % data[0]

    return answer


def _render(content, dpi, first, last):
    return [(1, 1, 1, content[k : k + 1]) for k in range(first - 1, min(last, len(content)))]


_SUMS = f"with s as (select p_partkey, sum({_PIXEL}) as total, min({_PIXEL.replace('(i // 12) * (i // 12) * 11 + (i % 12) * (p_partkey % 7) * 5 + c * 83', '0')}) as first_ from part, {_AT} group by 1)"


@query(_SUMS + " select p_partkey::varchar as doc_id, 0::bigint as block_idx, 'sum ' || total::varchar as text, 0.9::double as confidence from s where total % 5 <> 0")
def recognised_pages(spark, sf):
    """Blocks of every page: pages that fail have none, faint ones go."""
    return models.recognise(page_images(spark, sf), _reader, "sums").select("doc_id", "block_idx", "text", "confidence")


@query(_SUMS + " select p_partkey::varchar as doc_id, case when first_ % 4 <> 0 then first_::int end as horse_power, case when first_ % 4 = 0 then 'no answer' end as error from s")
def model_answers(spark, sf):
    """Answers and errors of every page, parsed."""
    raw = models.ask(page_images(spark, sf), _model, "read", "first pixel")
    hp = coerce.coerce_int(coerce.json_field(coerce.parse_json(F.col("raw")), "horse_power")).cast("int")
    return raw.select("doc_id", hp.alias("horse_power"), "error")


@query("select s_suppkey::varchar as doc_id, p.page::int as page_no, s_name[p.page] as text from supplier, (select unnest([2, 3, 4]) as page) p where length(s_name) >= p.page")
def rendered_pages(spark, sf):
    """Pages 2 to 4 of files; a page here is one byte."""
    files = derived(spark, sf, "supplier", "cast(s_suppkey as varchar(20)) as doc_id, cast(s_name as binary) as content")
    pages = models.pdf_pages(files, _render, first=2, last=4)
    return pages.select("doc_id", "page_no", F.col("image.data").cast("string").alias("text"))
