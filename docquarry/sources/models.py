"""Interfaces to what runs outside Spark: text recognition, vision-language models, PDF rendering.

An engine is a function on one image; it is loaded once for each Python worker.  Everything after the engine
works on its raw output as a table, so it can be tested and re-run without it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "doc_id string, block_idx long, text string, confidence double, bbox array<int>, image_h int, image_w int"
_loaded: dict[str, object] = {}


def once(name: str, load: Callable[[], object]) -> object:
    """The engine called ``name``, loaded at most once in a Python worker."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Rows (doc_id, block_idx, text or rec_text, confidence as text, polygon or 4 numbers) to blocks: empty texts
    go, unreadable confidences are 0, boxes are drawn around polygons, and blocks with neither go."""
    points = F.col("polygon")
    box = F.when(F.size("box") == 4, F.col("box")).when(
        F.size(points) > 0,
        F.array(
            F.array_min(F.transform(points, lambda p: p[0])), F.array_min(F.transform(points, lambda p: p[1])),
            F.array_max(F.transform(points, lambda p: p[0])), F.array_max(F.transform(points, lambda p: p[1])),
        )
    )
    df = raw.withColumn("bbox", box.cast("array<int>"))
    text = F.trim(F.coalesce("rec_text", "text"))
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    return df.where((text != "") & F.col("bbox").isNotNull()).select("doc_id", "block_idx", text.alias("text"), conf.alias("confidence"), "bbox")


def recognise(pages: DataFrame, load: Callable[[], Callable], name: str = "ocr", threshold: float = 0.3) -> DataFrame:
    """Blocks of every page: ``load()`` returns engine(data, height, width, channels) -> [(text, confidence, box)]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            engine = once(name, load)
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    found = engine(bytes(r.data), r.height, r.width, r.nChannels)
                except Exception:  # noqa: BLE001  a page that fails has no blocks
                    found = []
                rows += [(r.doc_id, k, t, float(c), list(b), r.height, r.width) for k, (t, c, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "text", "confidence", "bbox", "image_h", "image_w"])

    cols = pages.select("doc_id", "image.height", "image.width", "image.nChannels", "image.data")
    return cols.mapInPandas(run, BLOCKS).where(F.col("confidence") >= threshold)


def ask(pages: DataFrame, load: Callable[[], Callable], prompt: str, name: str = "vlm") -> DataFrame:
    """(doc_id, raw, error, latency_sec): ``load()`` returns model(data, height, width, channels, prompt) -> text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            model = once(name, load)
            rows = []
            for r in batch.itertuples(index=False):
                began, raw, error = time.monotonic(), None, None
                try:
                    raw = model(bytes(r.data), r.height, r.width, r.nChannels, prompt)
                except Exception as e:  # noqa: BLE001
                    error = str(e)
                rows.append((r.doc_id, raw, error, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["doc_id", "raw", "error", "latency_sec"])

    cols = pages.select("doc_id", "image.height", "image.width", "image.nChannels", "image.data")
    return cols.mapInPandas(run, "doc_id string, raw string, error string, latency_sec double")


def prompt(kind: str, previous: Column | None = None) -> Column:
    """The text that goes with a page: extraction, verification of an earlier answer, fallback, confidence."""
    fields = "dealer_name, model_name, horse_power, asset_cost, signature_present, stamp_present"
    texts = {
        "extraction": f"Read this quotation and answer with one JSON object with the fields {fields}. Use null for what cannot be read.",
        "verification": f"Compare this JSON with the page and answer with the corrected JSON, fields {fields}: ",
        "fallback": f"List what can be read of {fields} as JSON.",
        "confidence": f"For each of {fields}, answer with a number from 0 to 1 that says how sure you are of this JSON: ",
    }
    text = F.lit(texts[kind])
    return F.concat(text, previous) if previous is not None else text


def pdf_pages(files: DataFrame, render: Callable[[bytes, int, int, int], list], dpi: int = 200, first: int = 1, last: int = 1) -> DataFrame:
    """Pages first..last of PDF files: ``render(content, dpi, first, last)`` -> [(height, width, channels, data)].

    The page range is part of the call, so pages that nobody asks for are never rendered."""
    kind = "doc_id string, page_no int, image struct<height:int,width:int,nChannels:int,data:binary>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for k, (h, w, c, data) in enumerate(render(bytes(r.content), dpi, first, last)):
                    rows.append((r.doc_id, first + k, {"height": h, "width": w, "nChannels": c, "data": data}))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "image"])

    return files.select("doc_id", "content").mapInPandas(run, kind)
