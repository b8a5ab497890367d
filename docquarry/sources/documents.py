"""Document scans: files and images as DataFrames, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_id_from_path
from ..scratch import materialise

#: Suffixes of the batch scan, of decodable images, and of the labeller's scan.
BATCH_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".tiff"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"]
LABEL_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _no_hidden(path: Column) -> Column:
    return ~F.regexp_extract(path, r"([^/]*)$", 1).startswith(".")


def scan_files(spark: SparkSession, path: str, suffixes: list[str] | None = None, single: bool = False) -> DataFrame:
    """doc_id, path, length, content of a folder's files, not recursive, suffixes in any case.  ``single`` takes
    exactly one file whatever its suffix.  Without ``content`` selected, files are listed and not read."""
    files = spark.read.format("binaryFile").load(path)
    if not single:
        files = files.where(suffix(F.col("path")).isin(suffixes or BATCH_SUFFIXES))
    return files.select(doc_id_from_path(F.col("path")).alias("doc_id"), "path", "length", "content")


def scan_entries(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """doc_id, path of the files of a folder, and of its folders with such a suffix: a table in several files is one entry.
    Listed and not read; a folder without files is no entry."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    entry = F.concat(F.lit(base), F.substring_index(F.substring("path", len(base) + 1, 1 << 30), "/", 1))
    entries = files.select(entry.alias("path")).where(suffix(F.col("path")).isin(suffixes)).distinct()
    return entries.select(doc_id_from_path(F.col("path")).alias("doc_id"), "path")


def positions(files: DataFrame) -> DataFrame:
    """``files`` with ``pos``, the place in path order: a range sort, numbered by partition.

    The sorted rows are written once: sorted twice, they could be cut into other partitions the second time, and
    places would be lost or given twice."""
    from pyspark.sql import Window

    ordered = files.drop("content") if "content" in files.columns else files
    ordered = materialise(ordered.orderBy("path").withColumn("m_", F.monotonically_increasing_id()))
    part = F.shiftright("m_", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.col("m_").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(base), part == F.col("part")).withColumn("pos", F.col("base") + local).drop("m_", "part", "base")


def load_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded pages (doc_id, page_no, image) and the origins of files that did not decode.

    The image source percent-encodes origins; a literal plus is kept."""
    raw = spark.read.format("image").load(path)
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    named = raw.withColumn("origin", origin).withColumn("doc_id", doc_id_from_path(F.col("origin")))
    good = named.where("image.height > 0").select("doc_id", F.lit(1).alias("page_no"), "image")
    return good, named.where("image.height <= 0").select("doc_id", "origin")


def first_pages(pages: DataFrame) -> DataFrame:
    return pages.where("page_no = 1")


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PDF files, image files, and files of no known kind."""
    s = suffix(F.col("path"))
    return files.where(s == ".pdf"), files.where(s.isin(IMAGE_SUFFIXES)), files.where((s != ".pdf") & ~s.isin(IMAGE_SUFFIXES))
