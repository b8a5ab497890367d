"""Every query with SQL equals DuckDB; the others run and are held to properties."""

import pytest

from docquarry.plans import catalog

from oracle import assert_same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, data, duck):
    assert_same(QUERIES[name](spark, data), duck, SQL[name])


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: max((x[2] - x[0]) * (x[3] - x[1]), 1)
    return w * h / (area(a) + area(b) - w * h)


def test_nms_equals_brute_force(spark, data):
    blocks = {}
    for r in catalog._blocks(spark, data).collect():
        blocks.setdefault(r["doc_id"], []).append(r)
    got = {}
    for r in QUERIES["nms_blocks"](spark, data).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["block_idx"])
    assert set(got) == set(blocks)
    for doc, rows in blocks.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r["confidence"], r["block_idx"])):
            if all(_iou(r["bbox"], k["bbox"]) < 0.2 for k in kept):
                kept.append(r)
        want = [r["block_idx"] for r in sorted(kept, key=lambda r: (r["bbox"][1], r["bbox"][0], r["block_idx"]))]
        assert got[doc] == want


def test_star_clusters_equal_brute_force(spark, data):
    from docquarry.operators import strokes

    rows = {}
    for r in strokes.filter_strokes(catalog._strokes(spark, data)).orderBy("doc_id", "stroke_idx", "cx", "cy").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    want = set()
    for doc, items in rows.items():
        free = list(items)
        while free:
            seed = free.pop(0)
            near = [s for s in free if ((s["cx"] - seed["cx"]) ** 2 + (s["cy"] - seed["cy"]) ** 2) ** 0.5 <= 60]
            want |= {(doc, s["stroke_idx"], seed["stroke_idx"]) for s in [seed, *near]}
            free = [s for s in free if s not in near]
    assert {tuple(r) for r in QUERIES["star_clusters"](spark, data).collect()} == want


def test_dealers_equal_brute_force(spark, data):
    from docquarry.functions import fuzzy
    from docquarry.functions.text import match_key
    from docquarry.sources import tables

    rows = QUERIES["fuzzy_dealers"](spark, data).withColumn("key", match_key("name")).collect()
    master = tables.built_in(spark, tables.DEALERS).withColumn("key", match_key("name")).orderBy("pos").collect()
    assert len(rows) == spark.read.parquet(f"{data}/supplier.parquet").count()
    for r in rows:
        score, pos = max((fuzzy.best("dealer", r["key"], m["key"]), -m["pos"]) for m in master)
        matched = master[-pos]["name"]
        assert (r["matched"], round(r["score"], 6)) == (matched, round(score, 6))
        assert r["resolved"] == (matched if score >= 80 else r["name"])


def test_models_meet_the_whole_list(spark, data):
    from docquarry.functions import fuzzy
    from docquarry.functions.text import match_key

    names = spark.read.parquet(f"{data}/part.parquet").select("p_name").distinct().withColumn("key", match_key("p_name"))
    master = sorted((r["p_name"], r["key"]) for r in names.collect())
    rows = QUERIES["fuzzy_models"](spark, data).collect()
    assert sorted(r["name"] for r in rows) == [name for name, _ in master]
    keys = dict(master)
    for r in rows:
        score, _, name = max((fuzzy.best("model", keys[r["name"]], key), -pos, name) for pos, (name, key) in enumerate(master))
        assert (r["matched"], round(r["score"], 6)) == (name, round(score, 6))


def test_every_dealer_is_resolved(spark, data):
    rows = QUERIES["resolve_names"](spark, data).collect()
    assert sorted(r["s_suppkey"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{data}/supplier.parquet").select("s_suppkey").collect())
    assert any(r["name"].endswith(".MOTORS") for r in rows) and any(r["name"].endswith("& SONS CO.") for r in rows)


def test_records_equal_brute_force(spark, data):
    """The whole path, stage outputs joined and merged in plain Python."""
    from docquarry.functions import fuzzy
    from docquarry.functions.text import match_key
    from docquarry.plans import document_pipeline
    from docquarry.sources import tables
    from pyspark.sql import functions as F

    rows = {r["doc_id"]: r for r in QUERIES["document_records"](spark, data).collect()}
    ocr = {r["doc_id"]: r for r in QUERIES["parse_fields"](spark, data).collect()}
    df = catalog._df(spark, data, "orders", catalog.RESPONSE + ", cast(o_orderkey as varchar(20)) as doc_id").withColumnRenamed("raw", "primary")
    vlm = {r["doc_id"]: r for r in document_pipeline.vlm_fields(df).collect()}
    assert set(rows) == set(ocr) | set(vlm) and len(rows) == QUERIES["document_records"](spark, data).count()
    masters = {"dealer": tables.DEALERS, "model": tables.MODELS}
    names = sorted({(r["dealer"] if k == 0 else r["model"]) for r in ocr.values() for k in (0, 1)} | {r[f] for r in vlm.values() for f in ("dealer_name", "model_name")} | set(tables.DEALERS) | set(tables.MODELS), key=str)
    keys = {r["name"]: r["k"] for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", match_key(F.col("name")).alias("k")).collect()}

    def tokens(t):
        return set(t.strip().lower().split())

    def merged(a, b, ca):
        """Value and confidence of recognised text against the model's answer."""
        if a is None or b is None:
            return (a, ca) if b is None and a is not None else (b, 0.75 if b is not None else 0.0)
        x, y = tokens(a), tokens(b)
        if a.strip().lower() == b.strip().lower() or (x and y and len(x & y) / max(len(x), len(y)) >= 0.8):
            return b, min(1.0, (ca + 0.75) / 2 + 0.1)
        return (a, ca * 0.9) if ca > 0.75 else (b, 0.75 * 0.9)

    def resolved(kind, name, least):
        if not name or not keys[name]:
            return name
        score, pos = max((fuzzy.best(kind, keys[name], keys[m]), -k) for k, m in enumerate(masters[kind]))
        return masters[kind][-pos] if score >= least and score > 0 else name

    for doc, r in rows.items():
        o, v = ocr.get(doc), vlm.get(doc)
        dealer, _ = merged(o and o["dealer"], v and v["dealer_name"], o["dealer_confidence"] if o else 0.0)
        model, _ = merged(o and o["model"], v and v["model_name"], o["model_confidence"] if o else 0.0)
        assert r["fields"]["dealer_name"] == resolved("dealer", dealer, 80)
        assert r["fields"]["model_name"] == resolved("model", model, 85)
        hp = [x for x in (o and o["hp"], v and v["horse_power"]) if x is not None]
        assert (r["fields"]["horse_power"] is None) == (not hp) and (not hp or r["fields"]["horse_power"] in hp)
        assert r["valid"] and 0 <= r["confidence"] <= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
