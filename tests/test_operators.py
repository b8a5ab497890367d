"""Operators on small hand-made tables."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import blocks, consensus, images, matching, portfolio, records, signatures, strokes
from docquarry.sources import documents, models, tables
from docquarry.streaming import ingest


def make_blocks(spark, rows):
    return spark.createDataFrame([(d, i, t, float(c), b, 100, 100) for d, i, t, c, b in rows], "doc_id string, block_idx long, text string, confidence double, bbox array<int>, image_h int, image_w int")


def test_lines_split_on_gaps_over_tolerance(spark):
    at = [100, 110, 122, 135]
    df = make_blocks(spark, [("d", i, str(y), 1, [0, y - 5, 10, y + 5]) for i, y in enumerate(at)])
    assert {r["block_idx"]: r["line_no"] for r in blocks.line_groups(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_hp_mode_counts_the_whole_text_first(spark):
    df = make_blocks(spark, [("d", 0, "45 HP", 1, [0, 0, 5, 5]), ("d", 1, "50 HP", 1, [0, 20, 5, 25])])
    row = blocks.hp_mode(df).first()
    assert row["hp"] == 45 and row["hp_confidence"] == pytest.approx(0.9)


def test_near_excludes_the_anchor_and_keeps_duplicates(spark):
    df = make_blocks(spark, [("d", 0, "Total", 1, [0, 0, 10, 10]), ("d", 1, "5", 1, [15, 0, 25, 10]), ("d", 2, "total", 1, [30, 0, 40, 10]), ("d", 3, "far", 1, [300, 0, 310, 10])])
    got = sorted((r["anchor_idx"], r["block_idx"]) for r in blocks.text_near(df, "TOTAL", 40).collect())
    assert got == [(0, 1), (0, 2), (2, 0), (2, 1)]


def test_cost_prefers_rows_of_totals(spark):
    df = make_blocks(spark, [("d", 0, "9,00,000", 1, [0, 60, 5, 65]), ("d", 1, "Total 7,00,000", 1, [0, 90, 5, 95]), ("e", 0, "8,00,000", 1, [0, 5, 5, 10])])
    got = {r["doc_id"]: (r["cost"], r["cost_confidence"]) for r in blocks.asset_costs(df).collect()}
    assert got == {"d": (700000, 0.9), "e": (800000, 0.55)}


def test_models_by_label_go_before_brands(spark):
    df = make_blocks(spark, [("d", 0, "Mahindra 575 DI", 1, [0, 0, 50, 5]), ("d", 1, "Model:  Swaraj ७४४ FE", 1, [0, 40, 50, 45]), ("e", 0, "Mahindra 575 DI", 1, [0, 0, 50, 5]), ("f", 0, "none", 1, [0, 0, 5, 5])])
    got = {r["doc_id"]: (r["model"], r["model_confidence"]) for r in blocks.model_names(df).collect()}
    assert got == {"d": ("Swaraj 744 FE", 0.85), "e": ("Mahindra 575 DI", 0.75)}
    whole = {r["doc_id"]: (r["model"], r["hp"], r["cost_confidence"]) for r in blocks.parse_fields(df).collect()}
    assert whole["d"][0] == "Swaraj 744 FE" and whole["f"] == (None, None, 0.0)


def merge(spark, f, a, b, ca, cb, kind):
    df = spark.createDataFrame([(a, b, ca, cb)], f"a {kind}, b {kind}, ca double, cb double")
    r = df.select(f(*(F.col(c) for c in ("a", "b", "ca", "cb"))).alias("m")).first()["m"]
    return r["value"], round(r["confidence"], 9), r["source"], r["conflicted"]


def test_consensus_values(spark):
    assert merge(spark, consensus.merge_text, "Swaraj 742 XT", "742 XT Swaraj", 0.85, 0.75, "string") == ("742 XT Swaraj", 0.9, "both", False)
    assert merge(spark, consensus.merge_text, "A", "B", 0.9, 0.75, "string") == ("A", 0.81, "ocr", True)
    assert merge(spark, consensus.merge_text, None, None, 0.9, 0.75, "string") == (None, 0, "none", False)
    cost = lambda a, b, c, d: consensus.merge_number(a, b, c, d, 0.05)
    hp = lambda a, b, c, d: consensus.merge_number(a, b, c, d, 0.0)
    assert merge(spark, cost, 700000, 720000, 0.9, 0.75, "long")[0] == 710000
    assert merge(spark, cost, 700001, 700000, 0.9, 0.75, "long")[0] == 700000
    assert merge(spark, hp, 45, 50, 0.9, 0.75, "long") == (45, 0.765, "ocr", True)
    assert merge(spark, consensus.merge_flag, False, True, 0.7, 0.75, "boolean") == (True, 0.675, "vlm", True)
    assert merge(spark, consensus.merge_flag, None, None, 0.7, 0.75, "boolean") == (False, 0.5, "none", False)


def test_matching_ties_and_nulls(spark):
    master = spark.createDataFrame([(0, "Sai Wheels"), (1, "Sai  Wheels"), (2, "MK Motors")], "pos long, name string")
    names = spark.createDataFrame([(1, "sai wheels"), (2, None), (3, ""), (4, "MK Motor"), (5, "Traders")], "id int, name string")
    got = {r["id"]: (r["matched"], round(r["score"]), r["matched_above_threshold"]) for r in matching.match_names(names, master, "dealer").collect()}
    assert got[1] == ("Sai Wheels", 100, True)
    assert got[2] == got[3] == got[5] == (None, 0, False)
    assert got[4][0] == "MK Motors" and got[4][2]
    empty = matching.match_names(names, master.limit(0), "dealer")
    assert {r["score"] for r in empty.collect()} == {0.0}


def test_failures_get_an_empty_record(spark):
    files = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    none = F.lit(None)
    done = files.where("doc_id = 'a'").select("doc_id", *records.record(F.lit("D"), none, none, none, F.lit(True), none, none, none, F.lit(0.5), F.lit(1.0), F.lit(0.0)))
    got = {r["doc_id"]: r for r in records.with_failures(files, done).collect()}
    assert got["a"]["fields"]["dealer_name"] == "D" and got["b"]["fields"]["dealer_name"] is None
    assert got["b"]["fields"]["signature"]["present"] is False and got["b"]["confidence"] == 0
    assert records.missing_keys(["doc_id", "fields"]) == ["confidence", "processing_time_sec", "cost_estimate_usd"]


def test_records_round_trip(spark, tmp_path):
    none = F.lit(None)
    df = spark.createDataFrame([("a",)], "doc_id string").select("doc_id", *records.record(F.lit("é"), none, none, none, F.lit(True), F.array(*map(F.lit, (1, 2, 3, 4))), none, none, F.lit(0.5), F.lit(1.0), F.lit(0.0)))
    records.write_json_lines(df, str(tmp_path / "out"))
    back = tables.results(spark, str(tmp_path / "out" / "part-*.json"))
    assert back.collect() == df.collect()
    (tmp_path / "array.json").write_text(json.dumps([{"doc_id": "x", "confidence": 1.0}, {"doc_id": "y"}]))
    assert [r["doc_id"] for r in tables.results(spark, str(tmp_path / "array.json")).collect()] == ["x", "y"]
    flat = portfolio.flatten(back).first()
    assert flat["dealer_name"] == "é" and flat["signature_present"] is True


def test_portfolio_without_rows(spark):
    df = spark.createDataFrame([], "doc_id string, dealer_name string, model_name string, asset_cost long, confidence double, signature_present boolean, stamp_present boolean, pos long")
    row = portfolio.kpis(df).first()
    assert row["documents"] == 0 and row["total_cost"] == 0
    assert portfolio.top_dealers(df).count() == 0 and portfolio.risk_flags(df).count() == 0


def test_master_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Dealer_Name,city\nA,x\n,y\n B ,z\n", encoding="utf-8")
    names = lambda *a: [r["name"] for r in tables.master_list(spark, str(tmp_path / a[0]), *a[1:]).orderBy("pos").collect()]
    assert names("a.csv", "dealer_name") == ["A", "B"]
    assert names("a.csv", "other") == ["Dealer_Name", "A", "B"]
    assert names("missing.csv", "dealer_name") == []
    dealers, models_ = tables.masters(spark, str(tmp_path / "missing.csv"))
    assert dealers.count() == 9 and models_.count() == 10


def test_cumulative_flags(spark):
    raw = spark.createDataFrame([("a", "TRUE", "0"), ("b", "1.0", "x"), (None, "1", "1")], "doc_id string, Signature_Present string, Stamp_Present string")
    got = {r["doc_id"]: (r["signature_present"], r["stamp_present"]) for r in tables.cumulative(raw).collect()}
    assert got == {"a": (True, False), "b": (None, None)}


def png(path, image):
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + image[y, :, ::-1].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def page(h=300, w=300):
    return np.full((h, w, 3), 255, dtype=np.uint8)


def test_scan_and_stamps(spark, tmp_path):
    y, x = np.mgrid[:300, :300]
    stamped = page()
    stamped[(y - 230) ** 2 + (x - 230) ** 2 <= 40**2] = (200, 30, 30)  # a blue disc
    png(tmp_path / "a b+c.png", stamped)
    png(tmp_path / "blank.PNG", page())
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    files = documents.scan_files(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in files.select("doc_id").collect()) == ["a b+c", "bad", "blank"]
    assert [r["doc_id"] for r in documents.positions(files).orderBy("pos").collect()] == ["a b+c", "bad", "blank"]
    assert [d.count() for d in documents.dispatch(files)] == [0, 3, 0]
    (tmp_path / "notes.txt").unlink()
    good, bad = documents.load_images(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in good.collect()) == ["a b+c", "blank"] and [r["doc_id"] for r in bad.collect()] == ["bad"]
    hits = images.page_stamps(documents.first_pages(good))
    got = {r["doc_id"]: r for r in strokes.vote(hits, good).collect()}
    assert got["a b+c"]["present"] and not got["blank"]["present"] and got["blank"]["confidence"] == 0.75
    x1, y1, x2, y2 = got["a b+c"]["bbox"]
    assert x1 <= 195 and y1 <= 195 and x2 >= 265 and y2 >= 265
    clean = {r["doc_id"]: r for r in images.preprocess(good).collect()}
    assert clean["blank"]["final_width"] == 800 and clean["blank"]["rotation_applied"] == 0


def test_strokes_from_images(spark):
    image = page()
    for k in range(4):
        yy = 240 + 4 * k
        image[yy : yy + 3, 40 + 30 * k : 65 + 30 * k] = 0
        image[yy : yy + 20, 50 + 30 * k : 54 + 30 * k] = 0
    rows = [(a, x, y, w, h) for a, x, y, w, h, *_ in images.strokes(image)]
    assert len(rows) == 4 and all(y >= 180 for _, _, y, _, _ in rows)
    text = np.zeros((60, 200), dtype=np.uint8) + 255
    text[10:14], text[30:34] = 0, 0
    assert images.rotation(text) == 0 and images.rotation(np.rot90(text)) in (90, 270)


def test_image_arithmetic():
    g = np.zeros((40, 50), dtype=np.uint8)
    g[:, 25:] = 200
    assert 0 <= images.otsu(g) < 200
    assert images.resize(g, 25, 20).shape == (20, 25)
    assert images.working_scale(4096, 2000) == 0.5 and images.working_scale(400, 300) == pytest.approx(800 / 300) and images.working_scale(1000, 900) == 1.0
    assert set(np.unique(images.binarise(g))) <= {0, 255}
    assert images.equalise(g).shape == g.shape and images.deskew(g, 3.0).shape != g.shape
    flat = np.full((30, 30), 90, dtype=np.uint8)
    assert (images.denoise(flat) == 90).all()
    assert images.skew(flat) == 0.0
    assert images.gray(np.array([[[0, 0, 255]]], dtype=np.uint8))[0, 0] == 76


def test_interfaces(spark):
    pages = spark.createDataFrame([("a", (1, 1, 1, bytearray(b"\x05"))), ("b", (1, 1, 1, bytearray(b"\x00")))], "doc_id string, image struct<height:int,width:int,nChannels:int,data:binary>")

    def load():
        def engine(data, h, w, c):
            if data == b"\0":
                raise ValueError("unreadable")
            return [("Total", 0.9, [0, 0, 1, 1]), ("faint", 0.1, [0, 0, 1, 1])]

        return engine

    assert [(r["doc_id"], r["text"]) for r in models.recognise(pages, load, "t1").collect()] == [("a", "Total")]

    def model():
        def answer(data, h, w, c, prompt):
            if data == b"\0":
                raise ValueError("unreadable")
            return "{}"

        return answer

    got = {r["doc_id"]: (r["raw"], r["error"]) for r in models.ask(pages, model, "p", "t2").collect()}
    assert got == {"a": ("{}", None), "b": (None, "unreadable")}


def test_raw_blocks(spark):
    raw = spark.createDataFrame(
        [("d", 0, "a", None, "x", [[1, 2], [5, 2], [5, 9], [1, 9]], None), ("d", 1, " ", None, "0.5", None, [1, 2, 3, 4]), ("d", 2, None, "b", "0.5", None, [1, 2, 3, 4])],
        "doc_id string, block_idx long, text string, rec_text string, confidence string, polygon array<array<int>>, box array<int>",
    )
    got = [tuple(r) for r in models.normalise_raw(raw).orderBy("block_idx").collect()]
    assert got == [("d", 0, "a", 0.0, [1, 2, 5, 9]), ("d", 2, "b", 0.5, [1, 2, 3, 4])]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"doc_id": d, "raw": '{"horse_power": 45}', "arrived": "2024-01-01T00:00:00Z"} for d in ("a", "a", "b")]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = ingest.stream_responses(spark, str(tmp_path / "in"))

    def transform(df):
        from docquarry.plans.document_pipeline import vlm_fields

        return vlm_fields(df.withColumnRenamed("raw", "primary"))

    query = ingest.run_stream(stream, transform, str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*"))
    assert sorted((r["doc_id"], r["horse_power"]) for r in got.collect()) == [("a", 45), ("b", 45)]


def test_master_in_chunks_and_names_in_slices(spark):
    master = spark.createDataFrame([(k, f"name {k:02d}") for k in range(25)] + [(25, "name 03")], "pos long, name string")
    names = spark.createDataFrame([(f"name {k:02d}",) for k in range(25)] + [(None,)], "name string")
    got = {r["name"]: (r["matched"], r["score"]) for r in matching.match_names(names, master, "model", chunk=7, slice_=4).collect()}
    assert got == {f"name {k:02d}": (f"name {k:02d}", 100.0) for k in range(25)} | {None: (None, 0.0)}


def test_whole_matches_equal_comparisons(spark):
    """Keys that hold one another, words in another order, ties and positions with gaps, against the plain loop."""
    from docquarry.functions import fuzzy
    from docquarry.functions.text import match_key

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "a", "xt", "742", "xt 7", "b a", "é"], int(rng.integers(1, 4)))) for _ in range(60)]
    master = spark.createDataFrame([(int(k) * 10**9, t) for k, t in zip(rng.permutation(40), texts[:40])] + [(3, None), (4, "Traders")], "pos long, name string")
    names = spark.createDataFrame([(t.upper(),) for t in texts] + [("zz",), ("ztt",)], "name string").distinct()
    keyed = lambda df: df.where("name is not null").withColumn("k", match_key("name")).collect()
    options = sorted((r["pos"], r["k"], r["name"]) for r in keyed(master))
    want = {}
    for r in keyed(names):
        score, neg, matched = max((fuzzy.best("model", r["k"], k), -pos, name) for pos, k, name in options)
        want[r["name"]] = (matched, round(score, 6)) if score > 0 else (None, 0.0)
    got = {r["name"]: (r["matched"], round(r["score"], 6)) for r in matching.match_names(names, master, "model", chunk=7, slice_=4).collect()}
    assert got == want and sum(s == 100 for _, s in want.values()) > 20 and any(0 < s < 100 for _, s in want.values())


def test_exact_names_are_not_compared(spark, monkeypatch):
    master = spark.range(4000).selectExpr("id * 1000000000 as pos", "concat('name ', id) as name")
    monkeypatch.setattr(matching, "_compared", lambda *a: pytest.fail("every name equals a row of the list"), raising=False)
    rows = matching.match_names(master.selectExpr("upper(name) as name", "pos as p"), master, "model")
    # 'name 12' is a part of 'name 120', which comes later
    assert rows.where("score <> 100").count() == 0 and rows.where("name = 'NAME 12'").first()["matched"] == "name 1"


def test_pages_of_one_file_spread_over_tasks(spark, tmp_path):
    from docquarry.plans import page_queries

    keys = spark.range(25000).selectExpr("case when id = 7 then null else id end as p_partkey")
    keys.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = page_queries.page_images(spark, str(tmp_path)).select("doc_id", F.spark_partition_id().alias("task"), "image.data").collect()
    sizes = [sum(r["task"] == k for r in rows) for k in {r["task"] for r in rows}]
    assert len(rows) == 25000 and len(sizes) == 3 and max(sizes) < 10000
    data = {r["doc_id"]: r["data"] for r in rows}
    want = bytes((12345 * 37 + y * y * 11 + x * (12345 % 7) * 5 + c * 83) % 256 for y in range(12) for x in range(12) for c in range(3))
    assert bytes(data["12345"]) == want and data[None] is None


def test_tables_of_one_file_and_of_several(spark, tmp_path):
    from docquarry.plans import catalog

    root = tmp_path / "a b+%41"
    for name in ("beta.parquet", "delta.parquet/part-0.parquet", "delta.parquet/part-1.parquet", "gamma.parquet/x=1/part-0.parquet", "alpha.PARQUET", "notes.txt", "other/part-0.parquet"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    rows = catalog.queries()["scan_tables"](spark, str(root)).orderBy("pos").collect()
    assert [(r["doc_id"], r["pos"]) for r in rows] == [("alpha", 0), ("beta", 1), ("delta", 2), ("gamma", 3)]


def test_positions_of_many_files(spark):
    """Enough rows that two sorts of them are cut into different partitions."""
    files = spark.range(300000).selectExpr("concat('/in/', lpad(cast(id * 7919 % 1000003 as string), 7, '0')) as path", "repeat(md5(cast(id as string)), 8) as note")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        got = documents.positions(files).selectExpr("count(*) n", "count(distinct pos) d", "min(pos) a", "max(pos) z", "sum(pos * (cast(substr(path, 5) as long) % 1000)) s", "max(note) m").first()[:5]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    numbers = sorted(k * 7919 % 1000003 for k in range(300000))
    assert tuple(got) == (300000, 300000, 0, 299999, sum(pos * (v % 1000) for pos, v in enumerate(numbers)))


def test_circles():
    y, x = np.mgrid[:200, :240]
    ring = np.abs(np.hypot(y - 90, x - 130) - 50) < 3
    cx, cy, r = images.circle(ring)
    assert abs(cx - 130) <= 2 and abs(cy - 90) <= 2 and 45 <= r <= 56
    square = np.zeros((200, 240), dtype=bool)
    square[40:150, 50:160] = True
    assert images.circle(square) is None and images.circle(np.zeros((50, 50), dtype=bool)) is None


def test_outlines_and_corners():
    y, x = np.mgrid[:120, :120]
    masks = {"square": ((x > 20) & (x < 100) & (y > 30) & (y < 90), 4), "triangle": ((y > 20) & (y < 100) & (x > 20) & (x - 20 < y - 20), 3), "disc": (np.hypot(x - 60, y - 60) < 40, 8)}
    for mask, n in masks.values():
        (runs,) = images.regions(mask)
        walk = images.outline(runs)
        steps = np.abs(np.diff(np.vstack([walk, walk[:1]]), axis=0))
        assert steps.max() == 1 and mask[walk[:, 1], walk[:, 0]].all() and images.corners(walk) == n
    dot = np.zeros((4, 4), dtype=bool)
    dot[2, 1] = True
    assert images.outline(images.regions(dot)[0]).tolist() == [[1, 2]]


def scribble(image, top, left):
    rows = np.arange(top, top + 60)
    for k in range(4):
        for d in range(3):
            image[rows, (left + 40 * k + d + 15 * np.sin(rows / 6)).astype(int)] = 0


def test_signatures_from_page_to_verdict(spark):
    """A signature above the words that announce it is found there; one at the bottom by place; none on a blank page."""
    announced, low = page(600, 400), page(600, 400)
    scribble(announced, 100, 60)
    scribble(low, 500, 60)
    shots = {"announced": announced, "low": low, "blank": page(600, 400)}
    rows = [(n, (h.shape[0], h.shape[1], 3, bytearray(h.tobytes()))) for n, h in shots.items()]
    shot = spark.createDataFrame(rows, "doc_id string, image struct<height:int,width:int,nChannels:int,data:binary>")
    pages = shot.select("doc_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    words = spark.createDataFrame([("announced", 0, "Authorised Signatory", [60, 180, 220, 200]), ("blank", 0, "Manager", [60, 180, 220, 200])], "doc_id string, block_idx long, text string, bbox array<int>")
    ink = images.page_zone_strokes(shot, signatures.zones(pages, words))
    got = {r["doc_id"]: r for r in signatures.detect(pages, ink).collect()}
    assert (got["announced"]["method"], got["announced"]["confidence"]) == ("anchor", 0.87)
    assert (got["low"]["method"], got["blank"]["method"]) == ("bottom_scan", "none")
    x1, y1, x2, y2 = got["announced"]["bbox"]
    assert x1 <= 50 and 80 <= y1 <= 100 and x2 >= 160 and 160 <= y2 <= 180
    curved = images.zone_strokes(images.gray(low), "curvature", [0, 330, 400, 600])
    assert len(curved) == 4 and all(y >= 480 for _, _, y, *_ in curved)


def test_colour_survives_clean_pages():
    image = np.random.default_rng(0).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    assert np.abs(images.from_lab(images.lab(image)).astype(int) - image).max() <= 1
    assert images.lab(np.array([[[255, 255, 255], [0, 0, 0]]], dtype=np.uint8))[0, :, 0] == pytest.approx([100, 0], abs=0.01)
    colour, gray, binary, angle, lean = images.clean(page(60, 90), denoised=False)
    assert colour.shape[:2] == gray.shape == binary.shape and min(gray.shape) == 800 and set(np.unique(binary)) <= {0, 255} and (angle, lean) == (0, 0.0)


def test_pdf_pages(spark):
    files = spark.createDataFrame([("a", bytearray(b"12"))], "doc_id string, content binary")

    def render(content, dpi, first, last):
        return [(1, 1, 1, bytes([k])) for k in range(first, min(last, len(content)) + 1)]

    got = models.pdf_pages(files, render, first=2, last=5).collect()
    assert [(r["doc_id"], r["page_no"], bytes(r["image"]["data"])) for r in got] == [("a", 2, b"\x02")]


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("a:\n  b: 3\n")
    (tmp_path / "b.yaml").write_text("a: [")
    found = tables.settings(str(tmp_path / "a.yaml"))
    assert tables.setting(found, "a", "b") == 3 and tables.setting(found, "a", "c", default=5) == 5 and tables.setting(found, "a", "b", "c") is None
    assert tables.settings(str(tmp_path / "b.yaml")) == {} == tables.settings(str(tmp_path / "none.yaml"))


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.PDF", "b.png", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    stream = ingest.stream_files(spark, str(tmp_path / "in")).select("doc_id", "length")
    assert ingest.run_stream(stream, lambda batch: batch, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*"))
    assert sorted(tuple(r)[:2] for r in got.select("doc_id", "length").collect()) == [("a", 1), ("b", 1)]


def test_labels_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": "a", "image_path": "/x", "sig_bbox": [1, 2, 3, 4], "horse_power": None}, indent=1))
    (row,) = tables.labels(spark, str(tmp_path)).collect()
    assert row["doc_id"] == "a" and row["sig_bbox"] == [1, 2, 3, 4] and row["horse_power"] is None and "image_path" not in row.asDict()


def test_intermediate_tables(spark):
    from docquarry import scratch

    class Unset:
        def __init__(self, master):
            self.conf, self.sparkContext = {}, type("Context", (), {"master": master})()

    assert scratch.scratch_dir(Unset("local[2]")) == scratch.scratch_dir(Unset("local[4]"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.scratch_dir(Unset("yarn"))
    first, mark = scratch.materialise(spark.range(3)), scratch.scratch_mark()
    second = scratch.materialise(spark.range(4))
    scratch.release(mark)
    assert first.count() == 3
    with pytest.raises(Exception):  # noqa: B017  what a missing file raises is the file system's business
        second.count()


def test_png_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for shape in ((5, 7, 3), (4, 9)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.from_png(images.png(image)) == image).all()
    box = images.draw_box(page(20, 30), [5, 4, 12, 10])
    assert (box[4, 5] == (0, 200, 0)).all() and (box[7, 8] == 255).all() and (box[3, 4] == (0, 200, 0)).all() and (box[12, 14] == 255).all()
    assert images.crop(page(20, 30), [-3, 2, 10, 50]).shape == (18, 10, 3)
    shot = spark.createDataFrame([("a", (30, 40, 3, bytearray(page(30, 40).tobytes())))], "doc_id string, image struct<height:int,width:int,nChannels:int,data:binary>")
    images.write_debug_pages(shot, str(tmp_path / "debug"), denoised=False)
    (row,) = spark.read.parquet(str(tmp_path / "debug")).collect()
    assert images.from_png(bytes(row["colour"])).shape[2] == 3 and set(np.unique(images.from_png(bytes(row["binary"])))) <= {0, 255}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.png").write_bytes(images.png(box))
    good, _ = documents.load_images(spark, str(tmp_path / "files"))
    (read,) = good.collect()
    assert (images.decode(bytes(read["image"]["data"]), 20, 30, 3) == box).all()
