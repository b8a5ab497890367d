"""The queries over the driver's tables, and the DuckDB SQL that each must equal.

The tables hold no quotations, so quotation-like inputs are derived from them by expressions that both engines
share (integer arithmetic and concatenation).  ``_df`` runs such an expression on a table; the operators under
test are then the DataFrame functions, and the SQL says the same in another engine's words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import amounts, coerce, geometry, rules, text
from ..operators import blocks as block_ops
from ..operators import consensus, matching, portfolio, records, strokes
from ..sources import tables
from ..streaming import ingest
from . import document_pipeline
from .registry import QUERIES, SQL, query
from .registry import derived as _df
from .registry import table as _table

# Derived inputs, the same text in both engines.
PORTFOLIO = """cast(o_orderkey as varchar(20)) as doc_id, o_orderkey as pos,
  case when o_orderkey % 11 = 0 then null else concat('Dealer ', cast(o_custkey % 97 as varchar(20))) end as dealer_name,
  concat('Model ', o_orderpriority) as model_name,
  case when o_orderkey % 13 = 0 then null else cast(floor(o_totalprice) as bigint) * 37 end as asset_cost,
  cast(o_orderkey % 101 as double) / 100 as confidence,
  case when o_orderkey % 7 = 0 then null else o_orderkey % 3 <> 0 end as signature_present,
  case when o_orderkey % 17 = 0 then null else o_orderkey % 5 <> 0 end as stamp_present"""
QUOTE = """p_partkey, concat(p_brand, ' Swaraj ', p_type, ' ', cast(p_size as varchar(10)), ' HP  Grand Total Rs. ',
  cast(cast(floor((p_partkey * 7919 % 9000000 + 100000) / 100000) as bigint) as varchar(10)), ',',
  lpad(cast(cast(floor((p_partkey * 7919 % 9000000 + 100000) / 1000) as bigint) % 100 as varchar(10)), 2, '0'), ',',
  lpad(cast((p_partkey * 7919 % 9000000 + 100000) % 1000 as varchar(10)), 3, '0'), '/-') as quote"""
BLOCKS = """cast(l_orderkey as varchar(20)) as doc_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) as block_idx,
  concat(case when l_partkey % 4 = 0 then concat(cast(l_partkey % 60 + 10 as varchar(10)), ' HP')
              when l_partkey % 4 = 1 then concat('Total ', cast(l_partkey % 9 + 1 as varchar(10)), ',', cast(l_suppkey % 90 + 10 as varchar(10)), ',', cast(l_partkey % 900 + 100 as varchar(10)))
              when l_partkey % 4 = 2 then concat('Mahindra ', cast(l_suppkey as varchar(10)), ' DI') else concat('Shop ', l_linestatus, ' Motors Ltd') end, '') as text,
  cast((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 1000 as double) / 1000 as confidence,
  l_suppkey % 100 as x1, l_partkey % 90 as y1, l_suppkey % 100 + 20 + l_partkey % 30 as x2, l_partkey % 90 + 10 + l_suppkey % 8 as y2"""


def _portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return _df(spark, sf, "orders", PORTFOLIO)


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    df = _df(spark, sf, "lineitem", BLOCKS)
    box = F.array(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")])
    return df.select("doc_id", "block_idx", "text", "confidence", box.alias("bbox"), F.lit(120).alias("image_h"), F.lit(200).alias("image_w"))


P = f"with p as (select {PORTFOLIO} from orders) "
B = f"with b as (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from (select {BLOCKS} from lineitem)) "
Q = f"with q as (select {QUOTE} from part) "


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# Portfolio analytics.


@query(
    P
    + """select count(*) as documents, coalesce(sum(asset_cost), 0)::bigint as total_cost, round(avg(confidence), 6) as mean_confidence,
  min(confidence) as least_confidence, max(confidence) as most_confidence, round(avg(signature_present::int), 6) as signed_rate,
  round(avg(stamp_present::int), 6) as stamped_rate, round(avg(coalesce(signature_present and stamp_present, false)::int), 6) as compliant_rate from p"""
)
def portfolio_kpis(spark, sf):
    rounded = {c: F.round(c, 6) for c in ("mean_confidence", "signed_rate", "stamped_rate", "compliant_rate")}
    return portfolio.kpis(_portfolio(spark, sf)).withColumns(rounded)


@query(
    P
    + """select count(*) as documents, round(sum(confidence) / greatest(count(*), 1), 6) as mean_confidence,
  round(sum(seconds) / greatest(count(*), 1), 6) as mean_seconds, count(*) filter (error is not null) as failed
  from (select *, cast(pos % 50 as double) / 10 as seconds, case when pos % 29 = 0 then 'failed' end as error from p)"""
)
def run_summary(spark, sf):
    df = _portfolio(spark, sf).selectExpr("*", "cast(pos % 50 as double) / 10 as seconds", "case when pos % 29 = 0 then 'failed' end as error")
    return portfolio.run_summary(df).select("documents", *_r("mean_confidence", "mean_seconds"), "failed")


@query(
    P
    + """select round(avg(confidence) * 100, 6) as confidence_pct, round(avg(signature_present::int) * 100, 6) as signed_pct,
  round(avg(stamp_present::int) * 100, 6) as stamped_pct, coalesce(sum(asset_cost), 0)::bigint as total_cost from p"""
)
def sidebar_stats(spark, sf):
    return portfolio.sidebar(_portfolio(spark, sf)).select(*_r("confidence_pct", "signed_pct", "stamped_pct"), "total_cost")


@query(P + "select dealer_name, coalesce(sum(asset_cost), 0)::bigint as total_cost from p where dealer_name is not null group by 1 order by 2 desc, 1 limit 12")
def top_dealers(spark, sf):
    return portfolio.top_dealers(_portfolio(spark, sf))


@query("""select s_name as dealer_name, sum(floor(l_extendedprice)::bigint)::bigint as total_cost from lineitem join supplier on l_suppkey = s_suppkey group by 1 order by 2 desc, 1 limit 12""")
def top_suppliers(spark, sf):
    supplier = _table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("dealer_name"))
    priced = _table(spark, sf, "lineitem").select("l_suppkey", F.floor("l_extendedprice").alias("asset_cost"))
    # aggregating by key before the join shrinks what is joined to one row a supplier
    sums = priced.groupBy("l_suppkey").agg(F.sum("asset_cost").alias("asset_cost"))
    return portfolio.top_dealers(sums.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))


@query("select p_name as model_name, count(*) as n, min(p_partkey) as first_pos from part group by 1 order by 2 desc, 3 limit 10")
def model_counts(spark, sf):
    return portfolio.model_counts(_df(spark, sf, "part", "p_name as model_name, p_partkey as pos"))


@query(
    """select count(*) filter (quality = 1 and toxic = 1) as both, count(*) filter (quality = 1 and toxic = 0) as signature_only,
  count(*) filter (quality = 0 and toxic = 1) as stamp_only, count(*) filter (quality = 0 and toxic = 0) as neither from labels"""
)
def compliance_matrix(spark, sf):
    return portfolio.compliance_matrix(_df(spark, sf, "labels", "quality = 1 as signature_present, toxic = 1 as stamp_present"))


@query("select least(floor(l_discount * 10 * 30), 29)::int as bin, count(*) as n from lineitem where l_discount * 10 between 0 and 1 group by 1")
def confidence_hist(spark, sf):
    return portfolio.confidence_histogram(_df(spark, sf, "lineitem", "l_discount * 10 as confidence"))


RISKY = "(confidence < 0.75 or not signature_present or not stamp_present)"


@query(
    P
    + f"""select doc_id, dealer_name, model_name, asset_cost, confidence, signature_present, stamp_present,
  greatest((select count(*) from p where {RISKY}) - 20, 0)::bigint as more from p where {RISKY} order by pos limit 20"""
)
def risk_flags(spark, sf):
    return portfolio.risk_flags(_portfolio(spark, sf))


@query(
    P
    + """, v as (select doc_id, case when coalesce(signature_present, false) then '' else 'Missing signature;' end || case when coalesce(stamp_present, false) then '' else 'Missing stamp;' end
  || case when confidence < 0.75 then 'Low confidence;' else '' end || case when asset_cost > 5000000 then 'High asset cost;' else '' end as issues from p)
  select doc_id, issues, case when issues = '' then 'CLEAR' else 'REVIEW' end as verdict from v"""
)
def verdict(spark, sf):
    df = portfolio.verdicts(_portfolio(spark, sf))
    return df.select("doc_id", F.array_join(F.transform("issues", lambda x: F.concat(x, F.lit(";"))), "").alias("issues"), "verdict")


@query(
    """select o_orderkey, case when v is null then '—' when v >= 10000000 then printf('₹%.2f Cr', v / 10000000) when v >= 100000 then printf('₹%.1f L', v / 100000)
    else format('₹{:,}', v) end as rupees,
  case when v is null then '—' when v >= 1000000 then printf('₹ %.2fL  (', v / 1000000) || format('{:,}', v) || ')' when v >= 1000 then format('₹ {:,}', v) else '₹ ' || v::varchar end as web,
  case when pct >= 85 then 'High' when pct >= 65 then 'Medium' else 'Low' end as band,
  case when flag is null then 'Unknown' when flag then 'Present' else 'Absent' end as badge
  from (select o_orderkey, case when o_orderkey % 10 = 0 then null when o_orderkey % 10 < 4 then o_orderkey % 997 else (o_orderkey * 7919) % 30000000 end as v,
    o_orderkey % 101 as pct, case when o_orderkey % 3 = 0 then null else o_orderkey % 3 = 1 end as flag from orders)"""
)
def currency_format(spark, sf):
    df = _df(
        spark, sf, "orders",
        "o_orderkey, case when o_orderkey % 10 = 0 then null when o_orderkey % 10 < 4 then o_orderkey % 997 else (o_orderkey * 7919) % 30000000 end as v, "
        "o_orderkey % 101 as pct, case when o_orderkey % 3 = 0 then null else o_orderkey % 3 = 1 end as flag",
    )
    v = F.col("v")
    # the band truncates score * 100; a half-step keeps the product away from integers
    band = rules.confidence_band((F.col("pct") + F.lit(0.5)) / 100)
    return df.select("o_orderkey", rules.format_rupees(v).alias("rupees"), rules.format_currency(v).alias("web"), band.alias("band"), rules.compliance_badge(F.col("flag")).alias("badge"))


# Text and amounts.


@query(
    Q
    + r"""select p_partkey, case when h between 5 and 200 then h end as hp from
  (select p_partkey, try_cast(nullif(regexp_extract(quote, '(?i)(\d{1,3})\s*[-–]?\s*h\.?\s*p\.?', 1), '') as int) as h from q)"""
)
def extract_hp(spark, sf):
    return _df(spark, sf, "part", QUOTE).select("p_partkey", amounts.extract_hp(F.col("quote"), compose=False).alias("hp"))


AMOUNT_SQL = r"""try_cast(split_part(replace(regexp_replace(regexp_replace(regexp_replace(%s, '[₹Rr][sS]\.?\s*', '', 'g'), '[^\d.,]', '', 'g'), '[,.\-/\\]+$', ''), ',', ''), '.', 1) as bigint)"""


@query(Q + "select p_partkey, case when a > 0 then a end as amount from (select p_partkey, " + AMOUNT_SQL % r"regexp_extract(quote, 'Rs\..*')" + " as a from q)")
def extract_amount(spark, sf):
    df = _df(spark, sf, "part", QUOTE)
    return df.select("p_partkey", amounts.extract_amount(F.regexp_extract("quote", r"Rs\..*", 0), compose=False).alias("amount"))


@query(
    Q
    + r", m as (select p_partkey, unnest(regexp_extract_all(quote, '\b\d{1,3}(?:[,\s]\d{2,3})*(?:\.\d{1,2})?/?\-?\b')) as m from q), a as (select p_partkey, "
    + AMOUNT_SQL % "m"
    + " as a from m) select q.p_partkey, coalesce(string_agg(distinct a::varchar, ',' order by a::varchar), '') as amounts, max(a) filter (a between 50000 and 50000000) as cost, "
    "regexp_matches(lower(any_value(quote)), 'total|amount|grand|sum') as total_row from q left join a on q.p_partkey = a.p_partkey and a >= 1000 group by 1"
)
def extract_amounts(spark, sf):
    df = _df(spark, sf, "part", QUOTE)
    found = amounts.extract_all_amounts(F.col("quote"), compose=False)
    return df.select(
        "p_partkey",
        F.array_join(F.array_sort(F.transform(found, lambda a: a.cast("string"))), ",").alias("amounts"),
        amounts.largest_plausible(found).alias("cost"),
        text.is_total_row(F.col("quote")).alias("total_row"),
    )


@query("select c_custkey, translate(concat(c_name, ' ', c_phone_), '०१२३४५६७८९', '0123456789') as digits from (select c_custkey, c_name, translate(c_custkey::varchar, '0123456789', '०१२३४५६७८९') as c_phone_ from customer)")
def normalise_digits(spark, sf):
    native = F.translate(F.col("c_custkey").cast("string"), "0123456789", "०१२३४५६७८९")
    return _table(spark, sf, "customer").select("c_custkey", text.normalise_digits(F.concat("c_name", F.lit(" "), native)).alias("digits"))


DEALER_INPUT = """s_suppkey, concat(s_name, case s_suppkey % 6 when 0 then ' TRACTORS PVT. LTD.' when 1 then '  Traders' when 2 then '.MOTORS' when 3 then ' private  limited' when 4 then ' Agencies' else ' & Sons Co.' end) as raw"""


@query(
    f"with d as (select {DEALER_INPUT} from supplier), "
    r"""a as (select s_suppkey, raw, regexp_replace(raw, '\.([A-Za-z])', '. \1', 'g') as t from d),
  b as (select s_suppkey, raw, regexp_replace(trim(regexp_replace(regexp_replace(t, '(?i)\b(?:pvt\.?\s*ltd\.?|ltd\.?|private\s+limited|limited|co\.?|company|enterprises?|traders?|agency|agencies|prop\.?)\b', '', 'g'), '\s+', ' ', 'g')), '[.,/\\\-]+$', '') as t from a),
  k0 as (select *, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) as k from b),
  k1 as (select *, trim(regexp_replace(k, '\bpvt\.?\s*ltd\.?\b', '', 'g')) as k2 from k0), k2 as (select *, trim(regexp_replace(k2, '\bltd\.?\b', '', 'g')) as k3 from k1),
  k3 as (select *, trim(regexp_replace(k3, '\bco\.?\b', '', 'g')) as k4 from k2), k4 as (select *, trim(regexp_replace(k4, '\bprivate\s+limited\b', '', 'g')) as k5 from k3),
  k5 as (select *, trim(regexp_replace(k5, '\blimited\b', '', 'g')) as k6 from k4), k6 as (select *, trim(regexp_replace(k6, '\btraders?\b', '', 'g')) as k7 from k5),
  k7 as (select *, trim(regexp_replace(k7, '\bagenc(?:y|ies)\b', '', 'g')) as k8 from k6)
  select s_suppkey, list_aggregate(list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '') as dealer,
    trim(regexp_replace(regexp_replace(k8, '\benterprises?\b', '', 'g'), '\s+', ' ', 'g')) as match_key from k7"""
)
def normalise_dealer(spark, sf):
    df = _df(spark, sf, "supplier", DEALER_INPUT)
    return df.select("s_suppkey", text.normalise_dealer_name(F.col("raw"), compose=False).alias("dealer"), text.match_key(F.col("raw")).alias("match_key"))


@query(
    r"""select doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g')) as cleaned from documents"""
)
def clean_documents(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.clean_text(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query(r"select p_partkey, upper(trim(regexp_replace(regexp_replace(concat(p_name, ' #', p_size::varchar, '  X*T'), '[^\p{L}\p{N}_\s\-.]', '', 'g'), '\s+', ' ', 'g'))) as model from part")
def normalise_model(spark, sf):
    raw = F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"), F.lit("  X*T"))
    return _table(spark, sf, "part").select("p_partkey", text.normalise_model_name(raw, compose=False).alias("model"))


@query(
    r"""select doc_id, len(list_filter(regexp_split_to_array(text, '[\n\r]+'), lambda x: trim(x) <> ''))::int as n_lines,
  round(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1), 9) as foreign_share,
  case when length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1) > 0.3 then 'hi' else 'en' end as script,
  contains(lower(text), 'idfc') or (contains(lower(text), 'first') and contains(lower(text), 'bank')) as idfc from documents where text is not null"""
)
def document_lines(spark, sf):
    df, t = _table(spark, sf, "documents").where("text is not null"), F.col("text")
    return df.select("doc_id", F.size(text.split_lines(t)).alias("n_lines"), F.round(text.non_ascii_share(t), 9).alias("foreign_share"), text.script_hint(t).alias("script"), text.contains_idfc(t).alias("idfc"))


@query(
    r"""with t as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '(?s).') as c from documents),
  u as (select rid, unnest(c) as c, generate_subscripts(c, 1) as i from t), n as (select *, (c is distinct from lag(c) over w)::int as new_ from u window w as (partition by rid order by i)),
  g as (select *, sum(new_) over (partition by rid order by i rows unbounded preceding) as run from n), s as (select *, count(*) over (partition by rid, run) as size from g),
  k as (select rid, i, c, regexp_matches(c, '[\p{L}\p{N}_]') as word, regexp_matches(c, '[A-Za-z0-9ऀ-ॿ઀-૿]') as known from s where size < 5 or c in (chr(10), chr(13), chr(133), chr(8232), chr(8233))),
  m as (select rid, i, case when known or coalesce(lag(word) over w, false) or coalesce(lead(word) over w, false) then c else ' ' end as c from k window w as (partition by rid order by i)),
  j as (select rid, string_agg(c, '' order by i) as t from m group by 1)
  select doc_id, regexp_replace(regexp_replace(coalesce(j.t, ''), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') as clean from t left join j using (rid)"""
)
def noise_removal(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.remove_noise(F.coalesce("text", F.lit(""))).alias("clean"))


@query(
    r"""with l as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\n\r]+'), lambda x: regexp_replace(x, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '')) as line from documents)
  select doc_id, line, length(line) >= 3 and not regexp_matches(line, '\b\d{15}\b|\d{10}|\d{2}[/-]\d{2}[/-]\d{2,4}|^\d+$') as candidate from l"""
)
def dealer_candidates(spark, sf):
    """Every line of every text is judged; null texts have none."""
    lines = _table(spark, sf, "documents").select("doc_id", F.explode(text.split_lines(F.col("text"))).alias("line"))
    return lines.withColumn("candidate", text.is_dealer_candidate(F.col("line")))


# Model responses.

RESPONSE = """o_orderkey, concat(case when o_orderkey % 5 = 0 then 'Sure: ' when o_orderkey % 5 = 1 then '```json ' else '' end,
  '{"dealer_name": "', case when o_orderkey % 9 = 0 then 'N/A' else concat('Dealer ', cast(o_custkey as varchar(20))) end, '", "model_name": ',
  case when o_orderkey % 8 = 0 then 'null' else concat('"', o_orderpriority, '"') end, ', "horse_power": ', case when o_orderkey % 4 = 0 then concat('"', cast(o_orderkey % 60 as varchar(10)), ' HP"') else cast(o_orderkey % 60 + 10 as varchar(10)) end,
  ', "asset_cost": "Rs. ', cast(o_orderkey % 9 + 1 as varchar(10)), ',00,0', cast(o_orderkey % 90 + 10 as varchar(10)), '/-", "signature_present": ', case o_orderkey % 3 when 0 then 'true' when 1 then '"absent"' else '"maybe"' end,
  ', "stamp_present": "', case o_orderkey % 2 when 0 then 'Yes' else 'no' end, '"}', case when o_orderkey % 5 = 1 then ' ```' else '' end, case when o_orderkey % 7 = 3 then '}' else '' end) as raw"""


RESPONSE_SQL = (
    f"with r as (select {RESPONSE} from orders), "
    r"""s as (select o_orderkey, trim(regexp_replace(raw, '```(?:json)?\s*|\s*```', '', 'g')) as t from r),
  i as (select o_orderkey, t, regexp_extract(t, '(?s)\{.*\}') as inner_ from s),
  j as (select o_orderkey, case when json_valid(t) then t when json_valid(inner_) then inner_ end as j from i),
  f as (select o_orderkey, j ->> '$.dealer_name' as d, j ->> '$.model_name' as m, j ->> '$.horse_power' as h, j ->> '$.asset_cost' as c, j ->> '$.signature_present' as sg, j ->> '$.stamp_present' as st from j),
  n as (select *, regexp_replace(h, '[,₹Rs.\s\-/]', '', 'g') as hn, regexp_replace(c, '[,₹Rs.\s\-/]', '', 'g') as cn from f) """
)
RESPONSE_FIELDS = """case when lower(d) in ('null', 'none', 'n/a', '') then null else trim(d) end as dealer_name, case when lower(m) in ('null', 'none', 'n/a', '') then null else trim(m) end as model_name,
    case when regexp_full_match(hn, '[0-9]+') then hn::int end as horse_power, case when regexp_full_match(cn, '[0-9]+') then cn::bigint end as asset_cost,
    case when lower(trim(sg)) in ('true', 'yes', '1', 'present') then true when lower(trim(sg)) in ('false', 'no', '0', 'absent', 'not present') then false end as signature_present,
    case when lower(trim(st)) in ('true', 'yes', '1', 'present') then true when lower(trim(st)) in ('false', 'no', '0', 'absent', 'not present') then false end as stamp_present"""


@query(RESPONSE_SQL + "select o_orderkey, " + RESPONSE_FIELDS + " from n")
def coerce_fields(spark, sf):
    df = _df(spark, sf, "orders", RESPONSE).select("o_orderkey", coerce.parse_json(F.col("raw")).alias("v"))
    return df.select("o_orderkey", coerce.coerce_fields(F.col("v")).alias("f")).select("o_orderkey", "f.*")


@query("select event_id, (props ->> '$.k')::bigint as k from events")
def event_props(spark, sf):
    return _table(spark, sf, "events").select("event_id", coerce.coerce_int(coerce.json_field(coerce.parse_json(F.col("props")), "k")).alias("k"))


@query(
    RESPONSE_SQL
    + """select *, ((dealer_name is not null)::int + (model_name is not null)::int + (horse_power is not null)::int + (asset_cost is not null)::int
  + (signature_present is not null)::int + (stamp_present is not null)::int) as found from (select o_orderkey as doc_id, """
    + RESPONSE_FIELDS
    + " from n)"
)
def response_cascade(spark, sf):
    df = _df(spark, sf, "orders", RESPONSE).withColumn("primary", F.when(F.col("o_orderkey") % 6 != 0, F.col("raw")).otherwise("[1]")).withColumnRenamed("raw", "fallback")
    fields = document_pipeline.vlm_fields(df.withColumnRenamed("o_orderkey", "doc_id"))
    return fields.withColumn("found", coerce.fields_found(F.struct(*coerce.FIELDS)))


# Consensus and scoring.

SOURCES = """cast(o_orderkey as varchar(20)) as doc_id,
  case when o_orderkey % 10 = 0 then null when o_orderkey % 10 < 5 then concat('Dealer ', cast(o_custkey as varchar(20)), ' Motors') else concat('Motors Dealer ', cast(o_custkey % 50 as varchar(20))) end as ocr_name,
  case when o_orderkey % 12 = 0 then null else concat('dealer ', cast(o_custkey as varchar(20)), ' motors') end as vlm_name,
  case when o_orderkey % 9 = 0 then null else o_orderkey % 95 + 5 end as ocr_hp, case when o_orderkey % 8 = 0 then null else o_orderkey % 95 + 5 + (case when o_orderkey % 4 = 1 then 3 else 0 end) end as vlm_hp,
  case when o_orderkey % 7 = 0 then null else o_orderkey * 7919 % 900000 + 90000 end as ocr_cost, case when o_orderkey % 11 = 0 then null else o_orderkey * 7919 % 900000 + 90000 + (o_orderkey % 13) * 5001 end as vlm_cost,
  cast(o_orderkey % 41 as double) / 40 as c, case when o_orderkey % 6 = 0 then null else o_orderkey % 6 < 3 end as det, case when o_orderkey % 5 = 0 then null else o_orderkey % 5 < 3 end as vlm_flag"""


def _sources(spark, sf):
    df = _df(spark, sf, "orders", SOURCES)
    c = F.col("c")
    ocr = df.select("doc_id", F.col("ocr_name").alias("dealer_name"), F.col("ocr_name").alias("model_name"), F.col("ocr_hp").cast("int").alias("horse_power"), F.col("ocr_cost").alias("asset_cost"), *[c.alias(f"{f}_conf") for f in ("dealer_name", "model_name", "horse_power", "asset_cost")])
    vlm = df.select("doc_id", F.col("vlm_name").alias("dealer_name"), F.col("vlm_name").alias("model_name"), F.col("vlm_hp").cast("int").alias("horse_power"), F.col("vlm_cost").alias("asset_cost"), F.col("vlm_flag").alias("signature_present"), F.col("vlm_flag").alias("stamp_present"))
    found = df.select("doc_id", F.col("det").alias("signature_present"), F.col("det").alias("stamp_present"), c.alias("signature_present_conf"), c.alias("stamp_present_conf"))
    return ocr, vlm, found


def _merge_sql(a: str, b: str, agree: str, both: str, damp: str, names: str, tie: str) -> dict[str, str]:
    """SQL for value, confidence, source and conflicted of a merge of a (confidence c) with b (.75)."""
    n1, n2 = names.split()
    wins = f"c {tie} 0.75"
    value = f"case when {a} is null then {b} when {b} is null then {a} when {agree} then {both} when {wins} then {a} else {b} end"
    conf = f"case when {a} is null and {b} is null then 0 when {a} is null then 0.75::double when {b} is null then c when {agree} then least(1, (c + 0.75) / 2 + 0.1) when {wins} then c * {damp} else 0.75 * {damp} end"
    source = f"case when {a} is null and {b} is null then 'none' when {a} is null then '{n2}' when {b} is null then '{n1}' when {agree} then 'both' when {wins} then '{n1}' else '{n2}' end"
    return {"value": value, "confidence": f"round({conf}, 9)", "source": source, "conflicted": f"coalesce({a} is not null and {b} is not null and not ({agree}), false)"}


_TOKENS = "list_filter(string_split(lower({}), ' '), lambda x: x <> '')"
_NAME_AGREE = f"(lower(ocr_name) = lower(vlm_name) or len(list_intersect({_TOKENS.format('ocr_name')}, {_TOKENS.format('vlm_name')})) / greatest(len(list_distinct({_TOKENS.format('ocr_name')})), len(list_distinct({_TOKENS.format('vlm_name')}))) >= 0.8)"
_MERGES = {
    "text": _merge_sql("ocr_name", "vlm_name", _NAME_AGREE, "vlm_name", "0.9::double", "ocr vlm", ">"),
    "hp": _merge_sql("ocr_hp", "vlm_hp", "ocr_hp = vlm_hp", "vlm_hp", "0.85::double", "ocr vlm", ">"),
    "cost": _merge_sql("ocr_cost", "vlm_cost", "(ocr_cost = vlm_cost or abs(ocr_cost - vlm_cost) / greatest(ocr_cost, vlm_cost, 1) <= 0.05)", "round_even((ocr_cost + vlm_cost) / 2, 0)::bigint", "0.85::double", "ocr vlm", ">"),
    "flag": _merge_sql("det", "vlm_flag", "det = vlm_flag", "det", "0.9::double", "detection vlm", ">="),
}
_MERGES["flag"]["value"] = f"coalesce({_MERGES['flag']['value']}, false)"
_MERGES["flag"]["confidence"] = f"case when det is null and vlm_flag is null then 0.5 else {_MERGES['flag']['confidence']} end"
_S = f"with s as (select {SOURCES} from orders) "


def _merged(spark, sf, field):
    df = consensus.build_consensus(*_sources(spark, sf))
    c = F.col(field)
    return df.select("doc_id", c["value"].alias("value"), F.round(c["confidence"], 9).alias("confidence"), c["source"].alias("source"), c["conflicted"].alias("conflicted"))


def _merge_query(name, kind, field):
    def run(spark, sf):
        return _merged(spark, sf, field)

    run.__name__ = name
    query(_S + "select doc_id, " + ", ".join(f"{e} as {k}" for k, e in _MERGES[kind].items()) + " from s")(run)


for _name, _kind, _field in (("consensus_text", "text", "dealer_name"), ("consensus_hp", "hp", "horse_power"), ("consensus_cost", "cost", "asset_cost"), ("consensus_flag", "flag", "signature_present")):
    _merge_query(_name, _kind, _field)


@query(
    _S
    + ", m as (select doc_id, "
    + ", ".join(f"{e} as {kind}_{k}" for kind, parts in _MERGES.items() for k, e in parts.items() if k in ("value", "confidence", "conflicted"))
    + """ from s), b as (select *, greatest(0, least(1, text_confidence + case when text_value is null or text_value = '' then 0 when length(text_value) < 3 or length(text_value) > 120 then -0.1 when regexp_matches(text_value, '^\\d+$') then -0.3 else 0.05 end)) as s1,
  greatest(0, least(1, text_confidence + case when regexp_matches(text_value, '[A-Za-z]') and regexp_matches(text_value, '\\d') then 0.1 else 0 end)) as s2,
  greatest(0, least(1, hp_confidence + case when hp_value is null then 0 when hp_value between 15 and 100 then 0.1 else -0.2 end)) as s3,
  greatest(0, least(1, cost_confidence + case when cost_value is null then 0 when cost_value between 100000 and 30000000 then 0.1 else -0.2 end)) as s4, greatest(0, least(1, flag_confidence)) as s5 from m)
  select doc_id, round(greatest(0, least(1, (s1 + s2 + s3 + s4 + s5 + s5) / 6 - (case when text_value is null then 0.1 else 0 end) - (case when hp_value is null then 0.05 else 0 end) - (case when cost_value is null then 0.05 else 0 end)))::double, 6) as score,
  text_conflicted or hp_conflicted or cost_conflicted as conflicts from b""".replace("\\\\", "\\")
)
def score(spark, sf):
    df = consensus.build_consensus(*_sources(spark, sf))
    scored = df.select("doc_id", *consensus.score_report(), consensus.has_conflicts().alias("conflicts"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "conflicts")


@query(
    _S
    + ", m as (select doc_id, "
    + ", ".join(f"{_MERGES[kind][k].replace('round(', '(').replace(', 9)', ')')} as {kind}_{k}" if k == "confidence" else f"{_MERGES[kind][k]} as {kind}_{k}" for kind in _MERGES for k in ("value", "confidence"))
    + """ from s), n as (select *, 2 * (text_value is not null)::int + (hp_value is not null)::int + (cost_value is not null)::int + 2 as filled,
    case when text_value is null then 0 else text_confidence end::double as t, case when hp_value is null then 0 else hp_confidence end::double as h, case when cost_value is null then 0 else cost_confidence end::double as k from m)
  select doc_id, round(((t + t + h + k + flag_confidence + flag_confidence) / filled)::varchar::decimal(38, 20), 4)::double as overall from n"""
)
def overall_confidence(spark, sf):
    return consensus.build_consensus(*_sources(spark, sf)).select("doc_id", consensus.overall_confidence().alias("overall"))


# Blocks.


@query(
    B
    + """, n as (select *, case when cy - lag(cy) over w > 12 then 1 else 0 end as new_ from b window w as (partition by doc_id order by cy, block_idx))
  select doc_id, block_idx, (sum(new_) over (partition by doc_id order by cy, block_idx rows unbounded preceding))::bigint as line_no from n"""
)
def line_groups(spark, sf):
    return block_ops.line_groups(_blocks(spark, sf)).select("doc_id", "block_idx", F.col("line_no").cast("long").alias("line_no"))


@query(
    B
    + """, n as (select *, case when cy - lag(cy) over w > 12 then 1 else 0 end as new_ from b window w as (partition by doc_id order by cy, block_idx)),
  l as (select *, sum(new_) over (partition by doc_id order by cy, block_idx rows unbounded preceding) as line_no from n)
  select doc_id, line_no::bigint as line_no, string_agg(text, ' ' order by x1, cy, block_idx) as line_text from l group by 1, 2"""
)
def line_texts(spark, sf):
    return block_ops.line_texts(_blocks(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line_text")


@query(
    B
    + """select a.doc_id, a.block_idx as i, c.block_idx as j, round(case when least(a.x2, c.x2) <= greatest(a.x1, c.x1) or least(a.y2, c.y2) <= greatest(a.y1, c.y1) then 0 else
  ((least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1)))::double / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1))) end, 9) as iou
  from b a join b c on a.doc_id = c.doc_id and a.block_idx < c.block_idx"""
)
def iou_pairs(spark, sf):
    b = _blocks(spark, sf).select("doc_id", "block_idx", "bbox")
    other = b.select("doc_id", F.col("block_idx").alias("j"), F.col("bbox").alias("other"))
    pairs = b.join(other, "doc_id").where("block_idx < j")
    return pairs.select("doc_id", F.col("block_idx").alias("i"), "j", F.round(geometry.iou(F.col("bbox"), F.col("other")), 9).alias("iou"))


def _nms_sql(blocks: str, threshold: float) -> str:
    """Greedy suppression as a fold over each document's blocks, best first; what stays is numbered by (y1, x1)."""
    overlap = "(least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * (least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1))"
    apart = "least(k.x2, x[1].x2) <= greatest(k.x1, x[1].x1) or least(k.y2, x[1].y2) <= greatest(k.y1, x[1].y1)"
    areas = "(k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1)"
    return f"""l as (select doc_id, list([struct_pack(c := -confidence, i := block_idx, x1 := x1, y1 := y1, x2 := x2, y2 := y2, t := text)] order by -confidence, block_idx) as l from {blocks} group by 1),
  r as (select doc_id, list_reduce(l, lambda acc, x: case when len(list_filter(acc, lambda k: not ({apart}) and ({overlap})::double / ({areas} - {overlap}) >= {threshold})) > 0 then acc else list_concat(acc, x) end) as kept from l),
  k as (select doc_id, unnest(kept) as b from r)
  select doc_id, (row_number() over (partition by doc_id order by b.y1, b.x1, b.i) - 1)::int as pos, b.i::bigint as block_idx, b.t as text, -b.c as confidence, [b.x1, b.y1, b.x2, b.y2]::int[] as bbox from k"""


@query(B.rstrip() + ", " + _nms_sql("b", 0.2))
def nms_blocks(spark, sf):
    return block_ops.suppress_overlaps(_blocks(spark, sf), 0.2)


@query(
    B.rstrip()
    + """, u as (select doc_id, row_number() over (partition by doc_id order by block_idx % 2 <> 0, block_idx) - 1 as block_idx, text, confidence, x1, y1, x2, y2 from b), """
    + _nms_sql("u", 0.5)
)
def merge_languages(spark, sf):
    b = _blocks(spark, sf).select("doc_id", "block_idx", "text", "confidence", "bbox")
    return block_ops.merge_languages(b.where("block_idx % 2 = 0"), b.where("block_idx % 2 <> 0"))


@query(
    B
    + """select a.doc_id, a.block_idx as anchor_idx, n.block_idx, n.text from b a join b n on a.doc_id = n.doc_id and a.block_idx <> n.block_idx
  where contains(lower(a.text), 'total') and abs(a.cx - n.cx) <= 30 and abs(a.cy - n.cy) <= 30"""
)
def text_near(spark, sf):
    return block_ops.text_near(_blocks(spark, sf), "total", 30)


@query(B + "select doc_id, string_agg(text, ' ' order by block_idx) as region_text from b where cx between 20 and 90 and cy between 10 and 70 group by 1")
def region_text(spark, sf):
    return block_ops.region_text(_blocks(spark, sf), 20, 10, 90, 70)


@query(B + "select doc_id, count(*) as n from b where confidence >= 0.3 group by 1")
def confident_blocks(spark, sf):
    return block_ops.confident(_blocks(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


HP_SQL = r"try_cast(nullif(regexp_extract({}, '(?i)(\d{{1,3}})\s*[-–]?\s*h\.?\s*p\.?', 1), '') as int)"


@query(
    B
    + f""", f as (select doc_id, string_agg(text, ' ' order by block_idx) as t from b group by 1),
  v as (select doc_id, -1 as pos, {HP_SQL.format("t")} as v from f union all select doc_id, block_idx, {HP_SQL.format("text")} from b),
  g as (select doc_id, v, count(*) as n, min(pos) as first_ from v where v between 5 and 200 group by 1, 2),
  r as (select *, row_number() over (partition by doc_id order by n desc, first_) as r from g)
  select doc_id, v as hp, least(0.95, round(0.6 + n * 0.15, 6))::double as hp_confidence from r where r = 1"""
)
def hp_mode(spark, sf):
    df = block_ops.hp_mode(_blocks(spark, sf), compose=False)
    return df.select("doc_id", "hp", F.round("hp_confidence", 6).alias("hp_confidence"))


# Matching.


@query()
def fuzzy_dealers(spark, sf):
    names = _df(spark, sf, "supplier", DEALER_INPUT).select("s_suppkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in tables.DEALERS]), (F.col("s_suppkey") % 9 + 1).cast("int")), F.lit(" "), F.substring("raw", -6, 6)).alias("name"))
    return matching.resolve(names, tables.built_in(spark, tables.DEALERS), "dealer")


@query()
def fuzzy_models(spark, sf):
    names = _table(spark, sf, "part").select(F.col("p_name").alias("name"))
    # positions without gaps: the master list is cut into chunks by them
    master = names.distinct().select((F.row_number().over(Window.orderBy("name")) - 1).alias("pos"), "name")
    return matching.resolve(names.distinct(), master, "model")


@query(
    "select s_suppkey, case when s_suppkey % 3 = 0 then null when s_suppkey % 3 = 1 then s_name else lower(s_name) end as name, case when s_suppkey % 3 = 0 then null else s_name end as matched, "
    "case when s_suppkey % 3 = 0 then 0.0 else 100.0 end::double as score from supplier"
)
def match_exact_names(spark, sf):
    s = _table(spark, sf, "supplier")
    names = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, None).when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).otherwise(F.lower("s_name")).alias("name"))
    master = s.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return matching.match_names(names, master, "model").select("s_suppkey", "name", "matched", "score")


# Records, detection and streams.

RECORDS = """cast(o_orderkey as varchar(20)) as doc_id, o_orderkey as k, cast(o_orderkey % 120 as double) / 100 as confidence,
  case o_orderkey % 4 when 0 then null when 1 then 3 else 4 end as n_box"""


@query(
    f"with r as (select {RECORDS} from orders) select doc_id, case when n_box = 3 then 'signature bbox must have 4 numbers;' else '' end || case when confidence > 1 then 'confidence out of range;' else '' end as errors, "
    "coalesce(n_box, 4) = 4 and confidence <= 1 as valid from r"
)
def validate_output(spark, sf):
    df = _df(spark, sf, "orders", RECORDS)
    box = F.when(F.col("n_box").isNotNull(), F.slice(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]), 1, F.col("n_box")))
    none = F.lit(None)
    nested = records.record(none, none, none, none, F.lit(True), box, none, none, F.col("confidence"), F.lit(0.0), F.lit(0.0))
    df = records.validate(df.select("doc_id", *nested))
    return df.select("doc_id", F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(";"))), "").alias("errors"), "valid")


@query("select p_partkey, (p_size * 3 / 1000.0 * 500)::double as raw_, floor((p_size * 3)::double / 1000 * 500)::int as x1, floor(p_size::double * 2 / 1000 * 1000)::int as y1, floor((p_size * 9)::double / 1000 * 500)::int as x2, floor(p_size::double * 7 / 1000 * 1000)::int as y2 from part".replace("(p_size * 3 / 1000.0 * 500)::double as raw_, ", ""))
def bbox_denorm(spark, sf):
    s = F.col("p_size").cast("double")
    box = geometry.denormalise(F.array(s * 2, s * 3, s * 7, s * 9), F.lit(500), F.lit(1000))
    return _table(spark, sf, "part").withColumn("b", box).select("p_partkey", *[F.col("b")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


STROKES = "cast(l_orderkey as varchar(20)) as doc_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) as stroke_idx, cast(l_partkey % 3000 + 20 as double) as area, l_suppkey % 400 as x, l_partkey % 300 as y, l_partkey % 90 + 1 as w, l_suppkey % 70 + 1 as h"


def _strokes(spark, sf):
    return _df(spark, sf, "lineitem", STROKES).withColumn("cx", F.floor(F.col("x") + F.col("w") / 2)).withColumn("cy", F.floor(F.col("y") + F.col("h") / 2))


@query(
    f"select doc_id, stroke_idx from (select {STROKES} from lineitem) where area between 80 and 120000 and not (w < 8 and h < 8) and not (h <= 6 and w > 80) and not (w <= 4 and h > 60) "
    "and w::double / greatest(h, 1) between 0.15 and 20 and sqrt(w * w + h * h) >= 15 and not (area / greatest(w * h, 1) > 0.95 and area > 2000)"
)
def stroke_filter(spark, sf):
    return strokes.filter_strokes(_strokes(spark, sf)).select("doc_id", "stroke_idx")


STROKE_OK = "area between 80 and 120000 and not (w < 8 and h < 8) and not (h <= 6 and w > 80) and not (w <= 4 and h > 60) and w::double / greatest(h, 1) between 0.15 and 20 and sqrt(w * w + h * h) >= 15 and not (area / greatest(w * h, 1) > 0.95 and area > 2000)"


def star_sql(strokes: str, keys: str, gap: str) -> str:
    """Clusters as a fold over each page's strokes: d has (keys, i, seed)."""
    near = f"list_filter(acc, lambda d: d.seed = d.i and sqrt((d.cx - x[1].cx) ** 2 + (d.cy - x[1].cy) ** 2) <= {gap})"
    return f"""l as (select {keys}, list([struct_pack(i := stroke_idx, cx := cx::double, cy := cy::double, seed := stroke_idx)] order by stroke_idx, cx, cy) as l from {strokes} group by all),
  c as (select {keys}, unnest(list_reduce(l, lambda acc, x: list_concat(acc, [struct_pack(i := x[1].i, cx := x[1].cx, cy := x[1].cy, seed := coalesce({near}[1].i, x[1].i))]))) as d from l)"""


def best_sql(strokes: str, keys: str, pad: int = 14) -> str:
    """The best cluster of each page, from ``star_sql``."""
    using = ", ".join(keys.split(", "))
    return f"""a as (select {", ".join("c." + k for k in keys.split(", "))}, c.d.seed as cluster, count(*) as n, sum(area) as area, min(x) as x1, min(y) as y1, max(x + w) as x2, max(y + h) as y2
    from c join {strokes} s on s.stroke_idx = c.d.i and {" and ".join(f"s.{k} = c.{k}" for k in keys.split(", "))} group by all having count(*) >= 2 and sum(area) >= 160),
  z as (select *, (case when (x2 - x1)::double / greatest(y2 - y1, 1) between 1 and 8 then 1.0 else 0.5 end)::double * least(n / 10, 1) * ln(area + 1) as score from a),
  best as (select * from (select *, row_number() over (partition by {using} order by score desc, cluster) as r from z) where r = 1)"""


STROKE_ROWS = f"with s as (select *, floor(x + w / 2)::bigint as cx, floor(y + h / 2)::bigint as cy from (select {STROKES} from lineitem) where {STROKE_OK}), "


@query(STROKE_ROWS + star_sql("s", "doc_id", "60") + " select doc_id, d.i as stroke_idx, d.seed as cluster from c")
def star_clusters(spark, sf):
    return strokes.star_clusters(strokes.filter_strokes(_strokes(spark, sf)), 60)


@query(
    STROKE_ROWS + star_sql("s", "doc_id", "80") + ", " + best_sql("s", "doc_id")
    + " select doc_id, cluster::bigint as cluster, round(score, 6) as score, n as n_strokes, [greatest(x1 - 14, 0), greatest(y1 - 14, 0), x2 + 14, y2 + 14]::bigint[] as bbox from best"
)
def signature_clusters(spark, sf):
    s = strokes.filter_strokes(_strokes(spark, sf))
    best = strokes.best_cluster(s, strokes.star_clusters(s))
    return best.withColumn("score", F.round("score", 6)).withColumn("bbox", F.col("bbox").cast("array<bigint>"))


def _hits(spark, sf):
    return _df(spark, sf, "lineitem", BLOCKS + ", l_linenumber as k, l_partkey as pk").withColumn("bbox", F.array("x1", "y1", "x2", "y2")).withColumn("present", F.col("pk") % 3 == 0)


@query(
    """with h as (select l_orderkey::varchar as doc_id, min(case when l_partkey % 3 = 0 and l_linenumber <= 4 then l_linenumber end) as k from lineitem group by 1)
  select doc_id, k is not null as present, case k when 1 then 0.87 when 2 then 0.82 when 3 then 0.70 when 4 then 0.65 else 0.70 end::double as confidence,
  case k when 1 then 'anchor' when 2 then 'for_anchor' when 3 then 'bottom_scan' when 4 then 'curvature' else 'none' end as method from h"""
)
def signature_cascade(spark, sf):
    names = F.array(*[F.lit(m) for m, _ in strokes.SIGNATURE_ORDER])
    hits = _hits(spark, sf).withColumn("method", F.try_element_at(names, F.col("k").cast("int")))
    return strokes.first_success(hits, hits).select("doc_id", "present", "confidence", "method")


@query(
    """with h as (select l_orderkey::varchar as doc_id, case when l_linenumber <= 4 then 'likely' else 'full' end as region, (l_linenumber - 1) % 4 as m from lineitem where l_partkey % 3 = 0),
  c as (select *, case m when 0 then 0.90 when 1 then 0.80 when 2 then 0.82 else 0.78 end as conf, case m when 0 then 'hough_circle' when 1 then 'contour_circularity' when 2 then 'dark_blob' else 'text_density' end as method from h),
  g as (select doc_id, region, count(*) as n, max(conf) as conf, arg_max(method, conf) as method from c group by 1, 2),
  f as (select *, row_number() over (partition by doc_id order by region desc) as r from g), d as (select distinct l_orderkey::varchar as doc_id from lineitem)
  select d.doc_id, f.doc_id is not null as present, round(case when f.doc_id is null then 0.75 when region = 'likely' then least(0.95, conf + 0.05 * n) else conf * 0.85 end::double, 6) as confidence,
  coalesce(case when region = 'full' then 'full_' else '' end || method, 'none') as method from d left join f on d.doc_id = f.doc_id and r = 1"""
)
def stamp_vote(spark, sf):
    names, confs = (F.array(*[F.lit(x[k]) for x in strokes.STAMP_ORDER]) for k in (0, 1))
    at = ((F.col("k") - 1) % 4 + 1).cast("int")
    hits = _hits(spark, sf).withColumn("region", F.when(F.col("k") <= 4, "likely").otherwise("full")).withColumn("method", F.element_at(names, at)).withColumn("confidence", F.element_at(confs, at))
    return strokes.vote(hits, hits).select("doc_id", "present", F.round("confidence", 6).alias("confidence"), "method")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def windowed_events(spark, sf):
    df = ingest.windowed_counts(_table(spark, sf, "events"))
    return df.select(F.col("w.start").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query()
def document_records(spark, sf):
    """Responses, blocks and ink to validated records: the whole path after the models."""
    from . import page_queries

    orders = _table(spark, sf, "orders").select("o_orderkey")
    vlm = document_pipeline.vlm_fields(_df(spark, sf, "orders", RESPONSE + ", cast(o_orderkey as varchar(20)) as doc_id").withColumnRenamed("raw", "primary"))
    ocr = document_pipeline.ocr_fields(_blocks(spark, sf), document_pipeline.Config(compose=False))
    docs = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"))
    hits = _hits(spark, sf)
    stamp = strokes.vote(hits.withColumn("region", F.lit("likely")).withColumn("method", F.lit("dark_blob")).withColumn("confidence", F.lit(0.82)), docs)
    dealers, models = tables.masters(spark)
    return document_pipeline.build_records(ocr, vlm, document_pipeline.detections(page_queries.signature_detection(spark, sf), stamp), dealers, models)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import page_queries, source_queries  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import page_queries, source_queries  # noqa: F401

    return dict(SQL)
