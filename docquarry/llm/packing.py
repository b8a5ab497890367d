"""Best-two-fit packing of tokenised documents into sequences.

How documents fit together depends on their lengths only, and there are at most ``capacity`` lengths.  So one
aggregation counts documents by length, the driver packs that histogram (bounded by the capacity, whatever
the corpus), and the plan is a list of bin patterns with multiplicities.  A bin is filled greedily with the
longest remaining document that fits its gap; then its smallest document is replaced by two unpacked ones that
fit the expanded gap more tightly, if there are any.  Documents take their places by their rank among those
of equal length; ranks come from counts by (length, hash bucket), so a length that a third of all documents
share is numbered in many tasks.

Defined results: null and empty texts are one end token; a document longer than the capacity is cut into full
pieces and a shorter last one; rows that repeat a doc_id are packed like others; an empty table gives an
empty table; other columns are not read.  A word of any length is one entry of the cache, which holds whole words; a
tokenizer file whose steps aren't those of ``BY_WORD`` is applied to whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

CAPACITY = 4096
END_ID = 1
BUCKET = 100_000  # pieces of all lengths for each hash bucket of a length, so that no bucket of a hot length holds more
LEAST_BUCKETS = 256
CACHE = 800_000  # words whose ids a Python worker remembers

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A point or comma between an ASCII letter or digit and white space: there the tokenizer always cuts.
_STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[\x20\x09-\x0D]|$)")


#: Lower-case Latin words: one letter run for the tokenizer, composed already, and unchanged by lower-casing.
_LATIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for 256 and on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class WordIds:
    """Token ids of whole texts through a cache of words.

    The tokenizer never joins characters across ASCII white space (it splits on all white space and
    normalises nothing across it), so a text's ids are those of its white-space words in turn.  It lower-cases
    and cuts between letters and marks, so capitals and a closing point or comma need no entry of their own;
    texts with combining marks are left as they are, since composing comes before lower-casing.
    """

    def __init__(self, path: str, limit: int = CACHE):
        # one task is one core: the tokenizer's own threads would only fight over it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
            data = _STOP.sub(rb" \1", data.lower())
        return data.split()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without the end token."""
        parts = self.words(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            return b"".join(map(self.known.__getitem__, parts))

    def learn(self, parts: list[bytes]) -> None:
        """Enter all of ``parts``.  When the cache is half full it becomes the older half, and what is met
        again comes back from there, so frequent words are never learnt twice."""
        missing = set(parts).difference(self.known)
        if len(self.known) + len(missing) > self.limit // 2:
            self.older, self.known = self.known, {}
            missing = set(parts)
        new = []
        for word in missing:
            if (ids := self.older.get(word)) is None:
                new.append(word)
            else:
                self.known[word] = ids
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        merge, rest = self.tokenizer.model.tokenize, []
        for word in new:
            if _LATIN.fullmatch(text := word.decode("utf-8")):
                # the merges alone, without the steps that leave such a word as it is
                self.known[word] = _packed([t.id for t in merge(word.decode("latin-1").translate(_LETTERS))])
            else:
                rest.append((word, text))
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for (word, _), got in zip(some, encode([t for _, t in some], add_special_tokens=False), strict=True):
                self.known[word] = _packed(got.ids)


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: The steps of a tokenizer file before its merges that let words be looked up one by one.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TextIds:
    """Token ids of whole texts by the tokenizer itself, for files whose steps aren't known to work word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()

    def __call__(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


_tools: dict[str, WordIds | TextIds] = {}


def word_ids(path: str) -> WordIds | TextIds:
    """What turns texts into ids for a tokenizer file, one for each Python worker, kept from task to task."""
    if path not in _tools:
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        by_word = all(steps.get(k) == v for k, v in BY_WORD.items()) and (steps.get("model") or {}).get("type") == "BPE"
        _tools[path] = WordIds(path) if by_word else TextIds(path)
    return _tools[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a histogram length -> count.  Rows (length, first rank, documents, uses in each bin, first bin,
    offset of the first use): the document of rank r is use (r - first) % uses of bin (r - first) // uses."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    given = np.zeros(capacity + 1, dtype=np.int64)
    rows, bins = [], 0
    places = np.arange(capacity + 1)

    def floor_of(there: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(there, places, 0))

    def pair(budget: int, least: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is the largest of those in (least, budget]."""
        free = left.copy()
        for length, n in used.items():
            free[length] -= n
        free[0] = 0
        low = floor_of(free > 0)
        first = np.flatnonzero(free[:budget] > 0)
        second = np.minimum(low[budget - first], first) if len(first) else first
        second = np.where((second == first) & (free[first] < 2), low[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        if not len(total) or total.max() <= least:
            return None
        k = int(total.argmax())
        return int(first[k]), int(second[k])

    highest = capacity
    while True:
        while highest and not left[highest]:
            highest -= 1
        if not highest:
            return rows
        low = floor_of(left > 0)
        used = {highest: 1}
        gap = capacity - highest
        while gap:
            pick = int(low[gap])
            while pick and left[pick] <= used.get(pick, 0):
                pick = int(low[pick - 1])
            if not pick:
                break
            # as many of this length as fit keeps the number of steps small for tiny documents
            n = int(min(gap // pick, left[pick] - used.get(pick, 0)))
            used[pick] = used.get(pick, 0) + n
            gap -= n * pick
        smallest = min(used)
        if gap and sum(used.values()) > 1:
            used[smallest] -= 1
            better = pair(gap + smallest, smallest, used)
            if better:
                for length in better:
                    used[length] = used.get(length, 0) + 1
            else:
                used[smallest] += 1
            used = {length: n for length, n in used.items() if n}
        times = int(min(left[length] // n for length, n in used.items()))
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, int(given[length]), times * n, n, bins, offset))
            given[length] += times * n
            left[length] -= times * n
            offset += n * length
        bins += times


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with sequence_id and offset."""
    cut = materialise(pieces(docs, path, capacity))
    buckets = max(LEAST_BUCKETS, -(-cut.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    cut = cut.withColumn("bucket", bucket)
    sizes = materialise(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    # at most `capacity` rows
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = sorted(plan(counts, capacity))
    wide = 1 << 48
    starts = np.array([a * wide + b for a, b, *_ in rows], dtype=np.int64)
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            row = table[np.searchsorted(starts, length * wide + rank, "right") - 1].reshape(-1, 6)
            k = rank - row[:, 1]
            sequence, offset = row[:, 4] + k // np.maximum(row[:, 3], 1), row[:, 5] + k % np.maximum(row[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
