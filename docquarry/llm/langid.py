"""Language identification by compression.

For each language, pieces of labelled texts make a raw-content zstandard dictionary.  A text is cut into pieces
of bounded size, every piece of it is compressed with each language's dictionary, and the language with the
smallest sum wins; a narrow margin between the two smallest is a rejection.  Pieces keep the dictionary in
reach of a long text's end and bound memory.  Texts are compared as lower-case letters with their combining marks,
composed: what is between words is one space.

The dictionaries are fitted on a bounded sample: at most SAMPLE_DOCS texts of each language, those with the
smallest hash of doc_id (found among those under a limit that the language's count sets, so no task ranks a whole
language), and PIECE code points of each, DICTIONARY bytes in all.  A text's share comes from SPREAD
places, one at a hash-chosen point of each part of the whole text.  So what is broadcast has a fixed size for each
language.  Everything else reads all texts whole.

Defined results: null, empty and letterless texts are ``und``, score 0; with no labelled text everything is
``und``; equal sizes are decided by the order of language codes; rows with a null lang are predicted and never
learnt from; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hash_of, materialise, smallest_hashes

SAMPLE_DOCS = 400
PIECE = 1200
SPREAD = 4
DICTIONARY = 110_000
CHUNK = 4096  # bytes compressed at once
LEVEL = 11  # its matches tell short texts apart best; the optimal parsers above it fit sizes to literals, not to the dictionary
MARGIN = 0.01  # of the smallest size
UND = "und"

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def letters(text: str) -> bytes:
    """What is compared: the words of a text, lower-case."""
    composed = text if text.isascii() else unicodedata.normalize("NFC", text)
    return (" " + " ".join(_LETTERS.findall(composed.lower())) + " ").encode("utf-8", "replace")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def _places(text: Column, key: Column) -> Column:
    """SPREAD pieces of a text, PIECE code points in all: one from each of SPREAD equal parts, where ``key`` says."""
    n, size = F.length(text), PIECE // SPREAD

    def one(k: int) -> Column:
        begin, end = F.floor(n * k / SPREAD), F.floor(n * (k + 1) / SPREAD)
        room = F.greatest(end - begin - size, F.lit(0))
        at = begin + F.pmod(F.xxhash64(key, F.lit(k)), room + 1)
        return F.substring(text, (at + 1).cast("int"), F.least(end - begin, F.lit(size)).cast("int"))

    return F.array(*[one(k) for k in range(SPREAD)])


def _share(places: tuple[str, ...], size: int) -> bytes:
    """``size`` bytes of letters from all places alike; what one lacks, the next ones may add."""
    out = b""
    for k, piece in enumerate(places):
        out += letters(piece)[: (size - len(out)) // (len(places) - k)].decode("utf-8", "ignore").encode()
    return out


def dictionaries(docs: DataFrame, learn: Column, sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw dictionary content of each language among the rows where ``learn`` holds."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UND))
    few = smallest_hashes(labelled.select("doc_id", "lang"), "lang", F.col("doc_id"), sample)
    order = Window.partitionBy("lang").orderBy("k", "doc_id")
    ids = few.withColumn("k", hash_of(F.col("doc_id"))).withColumn("r", F.row_number().over(order))
    ids = materialise(ids.where(F.col("r") <= sample).select("doc_id", F.col("lang").alias("l")))
    texts = labelled.join(ids, (labelled["doc_id"] == ids["doc_id"]) & (labelled["lang"] == ids["l"]), "left_semi")
    found: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
    for row in texts.select("doc_id", "lang", _places(F.col("text"), F.col("doc_id")).alias("t")).collect():
        found.setdefault(row["lang"], []).append((row["doc_id"], tuple(row["t"])))
    out = {}
    for lang, rows in sorted(found.items()):
        pieces = list(dict.fromkeys(t for _, t in sorted(rows)))
        share = max(64, DICTIONARY // max(1, len(pieces)))
        out[lang] = b"".join(_share(p, share) for p in pieces)[:DICTIONARY]
    return out


class Judge:
    """Compressed sizes under each language's dictionary."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.langs = sorted(content)
        self.tools = [self._tool(zstandard, content[lang], level) for lang in self.langs]

    @staticmethod
    def _tool(zstandard, content: bytes, level: int):
        raw = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level)
        return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and margin (share of the smallest size)."""
        data = letters(text or "")
        if not self.langs or not data.strip():
            return UND, 0.0, 0.0
        sizes = []
        for tool in self.tools:
            sizes.append(sum(len(tool.compress(data[k : k + CHUNK])) for k in range(0, len(data), CHUNK)))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        # code lengths as log likelihoods, tempered by the square root of the length
        scale = 8 * math.log(2) / math.sqrt(8 * best)
        score = 1 / sum(math.exp(-min(700.0, (s - best) * scale)) for s in sizes)
        return self.langs[order[0]], score, margin


def predict(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected (the margin is narrow, or there is nothing to judge)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(content)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(1)]
            lang, score, gap = (pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64())))
            narrow = pa.array([g[0] == UND or g[2] < margin for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, score, gap, narrow], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
