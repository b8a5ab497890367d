"""What the operators of this subpackage share: words, scratch tables, row identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, materialise_by, release, release_at, release_but_last, release_kinds, scratch_dir, scratch_mark  # noqa: F401  the operators' one place for them

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words as long, without building them: each run of word characters becomes one ``x``."""
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACE, "")
    return F.length(squeezed).cast("long")


SCALE = 1 << 52


def hash_of(key: Column) -> Column:
    """A hash below SCALE."""
    return F.pmod(F.xxhash64(key), F.lit(SCALE))


def smallest_hashes(rows: DataFrame, group: str, key: Column, want: int) -> DataFrame:
    """A few more than ``want`` rows of each group of ``rows``, those with the smallest hashes of ``key``.

    A group's limit follows from its number of rows and is nine standard deviations or more above what is wanted, so
    no task ranks a whole group.  One row for each group goes to the driver: groups must be few, as languages are."""
    name = F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("-"))
    counts = rows.groupBy(name.alias("g")).count().collect()
    if not counts:
        return rows
    more = want + 10 * math.isqrt(want) + 50
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r["g"], max(1, SCALE * min(r["count"], more) // r["count"]))])
    return rows.where(hash_of(key) < F.element_at(limits, name))


SIEVE_BITS = 1 << 25  # 4 MB at most, whatever the corpus


def _place(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))


def sieve(rows: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of the hashes of ``columns``: (bucket, bits), rows of 4 kB, at most SIEVE_BITS in all.  Its bound
    lets it be broadcast: rows elsewhere that can't match are known where they lie and need no shuffle."""
    at = _place(*columns)
    return materialise(rows.groupBy(F.shiftright(at, 15).alias("sv_bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("sv_bits")))


def sifted(rows: DataFrame, bitmap: DataFrame, *columns: Column | str) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash of ``columns`` is in the bitmap (all that match, and few others), and the rest."""
    at = _place(*columns)
    both = rows.join(F.broadcast(bitmap), F.shiftright(at, 15) == F.col("sv_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("sv_bits"), (at.bitwiseAND(F.lit(32767)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)
    found = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    return both.where(found).select(*keep), both.where(~found).select(*keep)


def without(docs: DataFrame, gone: DataFrame, digest: Column) -> DataFrame:
    """``docs`` less the rows whose (doc_id, digest) is in ``gone`` (columns gone_id, gone_digest).

    Only rows that the bitmap of ``gone`` lets through meet it in a join; all others stay where they are."""
    name = free_name(docs.columns, "digest_")
    maybe, sure = sifted(docs.withColumn(name, digest), sieve(gone, "gone_id", "gone_digest"), F.col("doc_id").cast(gone.schema["gone_id"].dataType), F.col(name))
    match = maybe["doc_id"].eqNullSafe(gone["gone_id"]) & (maybe[name] == gone["gone_digest"])
    return sure.unionByName(maybe.join(gone.hint("merge"), match, "left_anti")).drop(name)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, lengthened by underscores until no column of ``taken`` has it (case-insensitively)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted
