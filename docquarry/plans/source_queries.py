"""Queries through sources and sinks: what is written to the shared folder is read back by the matching source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio, records
from ..scratch import keep, scratch_path
from ..sources import documents, tables
from ..streaming import ingest
from .catalog import P, _portfolio
from .registry import derived, query, table


def _folder(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    keep(spark, path)
    return path


def _records(spark: SparkSession, sf: str) -> DataFrame:
    df = _portfolio(spark, sf)
    c = F.col
    box = F.when(c("pos") % 2 == 0, F.array(*[(c("pos") % 100 + k).cast("int") for k in (0, 1, 20, 30)]))
    none = F.lit(None)
    return df.select("doc_id", *records.record(c("dealer_name"), c("model_name"), (c("pos") % 90).cast("int"), c("asset_cost"), c("signature_present"), box, c("stamp_present"), none, c("confidence"), F.lit(1.5), F.lit(0.0)))


@query(
    P + """select doc_id, dealer_name, model_name, (pos % 90)::int as horse_power, asset_cost, round(confidence, 4) as confidence, coalesce(signature_present, false) as signature_present,
  coalesce(stamp_present, false) as stamp_present from p"""
)
def results_round_trip(spark, sf):
    """Records to JSON lines, read back as results and made flat."""
    path = _folder(spark, "results")
    records.write_json_lines(_records(spark, sf), path)
    return portfolio.flatten(tables.results(spark, path + "/part-*.json"))


@query(
    "with f as (select cast(o_orderkey as varchar) as doc_id, o_orderkey as k from orders) select doc_id, case when k % 5 = 0 then null else 'Model ' || (k % 7)::varchar end as model_name, "
    "case when k % 5 = 0 then 0 else (k % 101)::double / 100 end as confidence, false as signed from f"
)
def failed_records(spark, sf):
    """Files without a result get the empty record."""
    files = derived(spark, sf, "orders", "cast(o_orderkey as varchar(20)) as doc_id, o_orderkey as k")
    none = F.lit(None)
    model = F.concat(F.lit("Model "), (F.col("k") % 7).cast("string"))
    done = files.where("k % 5 <> 0").select("doc_id", *records.record(none, model, none, none, none, none, none, none, (F.col("k") % 101) / 100, F.lit(0.0), F.lit(0.0)))
    out = records.with_failures(files, done)
    return out.select("doc_id", F.col("fields.model_name").alias("model_name"), "confidence", F.col("fields.signature.present").alias("signed"))


LABELLED = """cast(o_orderkey as varchar(20)) as doc_id, concat('page, ', cast(o_orderkey as varchar(20)), '.png') as image_name, case when o_orderkey % 4 = 0 then 'says "no", here' end as notes,
  cast(o_orderkey % 60 as int) as horse_power, o_orderkey * 37 as asset_cost, o_orderkey % 3 = 0 as sig_present"""


@query(f"select doc_id, image_name, notes, horse_power, asset_cost, sig_present, case when horse_power % 2 = 0 then [1, 2, horse_power, 4]::int[] end as sig_bbox from (select {LABELLED} from orders)")
def labels_round_trip(spark, sf):
    """Labels to CSV and back: quotes, commas, nulls, and arrays as JSON text."""
    path = _folder(spark, "labels")
    df = derived(spark, sf, "orders", LABELLED).withColumn("sig_bbox", F.when(F.col("horse_power") % 2 == 0, F.array(F.lit(1), F.lit(2), F.col("horse_power"), F.lit(4))))
    names = [x.split()[0] for x in tables.LABELS.split(", ")]
    kinds = dict(x.split(" ", 1) for x in tables.LABELS.split(", "))
    whole = df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names])
    records.write_labels(whole, path)
    return tables.labels_csv(spark, path).select("doc_id", "image_name", "notes", "horse_power", "asset_cost", "sig_present", "sig_bbox")


@query("select cast(n_nationkey as varchar) as doc_id, n_name as dealer_name, (n_nationkey % 5)::double / 4 as confidence from nation")
def records_by_document(spark, sf):
    """A folder of JSON for each document."""
    path = _folder(spark, "by-document")
    none = F.lit(None)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), *records.record(F.col("n_name"), none, none, none, none, none, none, none, (F.col("n_nationkey") % 5) / 4, F.lit(0.0), F.lit(0.0)))
    records.write_per_document(nations, path)
    return portfolio.flatten(tables.results(spark, path + "/doc=*/part-*.json")).select("doc_id", "dealer_name", "confidence")


@query("select trim(s_name) as name, row_number() over (order by s_suppkey) as place from supplier")
def master_csv(spark, sf):
    """A master list from a CSV column that is found by its header, in the order of its lines."""
    path = _folder(spark, "masters")
    lines = table(spark, sf, "supplier").orderBy("s_suppkey").select(F.col("s_suppkey").alias("Key"), F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("Dealer_Name"))
    lines.coalesce(1).sortWithinPartitions("Key").write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    listed = tables.master_list(spark, path, "dealer_name")
    return listed.select("name", F.col("pos").alias("place"))


FLAGS = """case when o_orderkey % 9 = 0 then null else cast(o_orderkey as varchar(20)) end as doc_id, case o_orderkey % 5 when 0 then 'TRUE' when 1 then '0' when 2 then '1.0' when 3 then 'False' end as Signature_Present,
  case o_orderkey % 3 when 0 then '1' when 1 then 'no' end as Stamp_Present"""


@query(
    f"""select doc_id, case when lower(Signature_Present) in ('true', '1') then true when lower(Signature_Present) in ('false', '0') then false end as signature_present,
  case when lower(Stamp_Present) in ('true', '1') then true when lower(Stamp_Present) in ('false', '0') then false end as stamp_present from (select {FLAGS} from orders) where doc_id is not null"""
)
def cumulative_flags(spark, sf):
    return tables.cumulative(derived(spark, sf, "orders", FLAGS)).select("doc_id", "signature_present", "stamp_present")


@query("select unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) as doc_id, generate_subscripts(range(14), 1) - 1 as pos")
def scan_tables(spark, sf):
    """The tables of a folder by suffix, of one file or a folder of files, in path order, without reading them."""
    return documents.positions(documents.scan_entries(spark, sf, [".parquet"])).select("doc_id", "pos")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def streamed_events(spark, sf):
    """The events as a stream of files: micro-batches written whole, then counted by window."""
    path = _folder(spark, "stream")
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*")
    ingest.run_stream(stream, lambda batch: batch.select("ts", "event_type", "value"), path + "/out", path + "/checkpoint").awaitTermination()
    df = ingest.windowed_counts(spark.read.parquet(path + "/out"))
    return df.select(F.col("w.start").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def _values(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


@query(
    f"select 'dealer' as kind, unnest({_values(tables.DEALERS)}) as name, generate_subscripts({_values(tables.DEALERS)}, 1) - 1 as pos union all "
    f"select 'model', unnest({_values(tables.MODELS)}), generate_subscripts({_values(tables.MODELS)}, 1) - 1"
)
def built_in_masters(spark, sf):
    """The lists that stand in where no file is given, or none is found."""
    dealers, models = tables.masters(spark, f"{scratch_path(spark, 'absent')}.csv")
    return dealers.withColumn("kind", F.lit("dealer")).unionByName(models.withColumn("kind", F.lit("model")))
