"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

All trusted documents train the model, but the fifth that is held back for the thresholds (``most`` is for callers
who want a bounded sample).  Counts are kept in buckets, by ranges of the hash of the n-gram; a bucket's n-grams are
one packed row, so what Spark shuffles are few rows of arrays:

1. Trigrams are counted in portions of text, then in their bucket.  A trigram bucket gives each bigram its number of
   left contexts and each context its total and how many of its trigrams occur once, twice and more often; bigram
   buckets do the same for words.  Whatever a frequent word or context has is summed in every bucket before it moves,
   so no task gathers its n-grams.
2. Every whole document is scored.  Models of up to MODEL_ROWS n-grams are broadcast.  For larger ones, portions of
   documents ask the buckets for their distinct n-grams, and the counts come back to the portion.  The results are
   the same.

Both steps go in turns, so that shuffles hold one turn's share: trigrams in up to SLICES turns, bigrams in up to
PART_TURNS, whose parts are deleted turn by turn, documents in up to SCORE_SLICES, and the buckets that each of these
asks in up to ASK_TURNS.

The threshold of each language is a quantile of the perplexities of all trusted documents of that language that
the model has not seen; its rank is exact to one in ACCURACY.

Defined results: null and blank texts have no words and are not kept, their perplexity is null; a language
without held-back trusted documents (or null) takes the quantile over all of them; without any trusted text
everything with words is kept; rows that repeat a doc_id are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_of, materialise, materialise_by, release_at, release_but_last, release_kinds, scratch_mark, sieve, sifted, smallest_hashes
from .langid import fold
from .ngram_join import BASE, Shingler, _mix, _portions

HELD_BACK = 5  # every fifth trusted document trains nothing, however few there are
QUANTILE = 0.995
ACCURACY = 100_000
MODEL_ROWS = 8_000_000
BUCKET_BYTES = 12 << 20  # of training text for each bucket
SLICE_BYTES = 32 << 20  # of text in a turn at least
SLICES = 12
PART_TURNS = 4
SCORE_SLICES = 6
ASK_TURNS = 3
PORTION = 6 << 20  # bytes of text that ask for their n-grams together

START, END = np.uint64(1), np.uint64(2)
_A, _B = np.uint64(BASE), np.uint64(0xD6E8FEB86659FD93)


def _key2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _A + b * _B)


STARTS = _key2(np.array([START]), np.array([START]))


def _key3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mix(_key2(a, b) * _A + c)


def _words(texts: list[bytes], shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text."""
    word, start = shingler.words(b"\n".join(t.lower() for t in texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, ends)
    return word, np.diff(np.concatenate([[0], last]))


def _lines(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each predicted token (words and one end a text): text number, two tokens before it, itself."""
    # each text becomes START START words END
    offset = np.concatenate([[0], np.cumsum(n + 3)])
    line = np.zeros(offset[-1], dtype=np.uint64)
    line[offset[:-1]] = line[offset[:-1] + 1] = START
    line[offset[1:] - 1] = END
    owner = np.repeat(np.arange(len(n)), n + 1)
    at = np.arange(len(owner)) + 2 * (owner + 1)
    inner = np.repeat(offset[:-1] + 2 - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    line[np.arange(len(word)) + inner] = word
    return owner, line[at - 2], line[at - 1], line[at]


def _tokens(texts: list[bytes], shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _lines(*_words(texts, shingler))


def _pack(how: str, *columns: np.ndarray) -> bytes:
    """Columns of 64 bits as bytes: ``d`` sorted (differences by byte plane), ``p`` by byte plane, ``r`` as they are."""
    parts = [np.array([len(columns[0])], dtype="<u8").tobytes()]
    for kind, x in zip(how, columns, strict=True):
        x = x.astype("<u8")
        if kind == "d":
            x = np.diff(x, prepend=np.uint64(0))
        parts.append(x.tobytes() if kind == "r" else np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(how: str, data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, out = int(np.frombuffer(raw, "<u8", 1)[0]), []
    for k, kind in enumerate(how):
        x = np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * k)
        x = x.view("<u8") if kind == "r" else np.ascontiguousarray(x.reshape(8, n).T).view("<u8").reshape(-1)
        out.append(np.cumsum(x, dtype=np.uint64) if kind == "d" else x)
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted ``keys``, and the end."""
    return np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted.  np.unique would hash them first, which takes many times as long."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]])]


def _sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, a place of each, and sums of ``columns``."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    return keys[first], order[first], *(np.add.reduceat(x[order], first) if len(first) else x[:0] for x in columns)


# Packed rows: trigrams on their way to a bucket, a bucket's trigrams, parts of bigrams and of contexts, and what
# is known of bigrams or words: key, count, and as a context: total, what follows once, twice, more often.
# Kinds of rows: 0 trigrams, 3 bigrams, 4 parts of words, 5 words; parts of bigrams and of contexts have one for each turn.
BI_TURN, CONTEXT_TURN = 100, 200
TRI_PART, TRI, BI_PART, CONTEXT_PART, KNOWN = "drrp", "dp", "drp", "dpppp", "dppppp"
_ROWS = "kind int, bucket int, data binary, rows long, total long, c1 long, c2 long, c3 long, c4 long"


def _row(kind: int, bucket: int, data: bytes, counts: np.ndarray) -> tuple:
    """A packed row, with its number of n-grams, the sum of ``counts`` and counts of counts."""
    return (kind, bucket, data, int(np.count_nonzero(counts)), int(counts.sum()), *(int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)))


def _arrow(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _ROWS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 6]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _all(table: pa.Table, how: str, kind: int | None = None) -> list[np.ndarray]:
    """The columns of all packed rows of ``table`` (of one kind)."""
    found = [x.as_py() for x in table.column("data")]
    if kind is not None:
        found = [x for x, k in zip(found, table.column("kind").to_pylist(), strict=True) if k == kind]
    parts = [_unpack(how, x) for x in found]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.uint64) for k in range(len(how))]


def _followed(n: np.ndarray) -> list[np.ndarray]:
    """1 where ``n`` is 1, is 2, is more."""
    return [(n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n > 2).astype(np.uint64)]


def _joint(keys: np.ndarray, count: np.ndarray, context: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """KNOWN from distinct keys with counts and rows of contexts."""
    none, nothing = np.zeros(len(context), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
    both = _sums(np.concatenate([keys, context]), np.concatenate([count, none]), *(np.concatenate([nothing, x]) for x in columns))
    return [both[0], *both[2:]]


def _trigram_parts(texts: DataFrame, buckets: int, turn: int, turns: int) -> DataFrame:
    """TRI_PART rows (bucket, data) of the column ``text``, for every ``turns``-th bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for _, portion in _portions(batches, 0, PORTION):
            _, a, b, c = _tokens(portion, shingler)
            keys = _key3(a, b, c)
            if turns > 1:
                own = np.flatnonzero(_bucket(keys, buckets) % np.uint64(turns) == turn)
                keys, a, b, c = keys[own], a[own], b[own], c[own]
            keys, at, n = _sums(keys, np.ones(len(a), dtype=np.uint64))
            edges, out = _edges(keys, buckets), []
            for k in range(turn, buckets, turns):
                here, m = at[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]
                if len(here):
                    order = np.argsort(b[here], kind="stable")  # so that they pack well
                    here = here[order]
                    out.append((k, _pack(TRI_PART, b[here], a[here], c[here], m[order])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "data"])

    return texts.select("text").mapInArrow(run, "bucket int, data binary")


def _trigram_bucket(buckets: int, part_turns: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        b, a, c, n = _all(table, TRI_PART)
        keys, at, n = _sums(_key3(a, b, c), n)
        a, b, c = a[at], b[at], c[at]
        out = [_row(0, table.column("bucket")[0].as_py(), _pack(TRI, keys, n), n)]
        # a text's first word has one left context only, so there occurrences count, not contexts
        bigram, at, left = _sums(_key2(b, c), np.where(b == START, n, np.uint64(1)))
        x, y = b[at], c[at]
        context, _, *follow = _sums(_key2(a, b), n, *_followed(n))
        none = np.zeros(0, dtype=np.uint64)
        for k, (i, j) in enumerate(zip(*_pairs(_edges(bigram, buckets)), strict=True)):
            if i < j:
                order = np.argsort(x[i:j], kind="stable")
                out.append(_row(BI_TURN + k % part_turns, k, _pack(BI_PART, x[i:j][order], y[i:j][order], left[i:j][order]), none))
        for k, (i, j) in enumerate(zip(*_pairs(_edges(context, buckets)), strict=True)):
            if i < j:
                out.append(_row(CONTEXT_TURN + k % part_turns, k, _pack(CONTEXT_PART, context[i:j], *(f[i:j] for f in follow)), none))
        return _arrow(out)

    return run


def _pairs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return edges[:-1], edges[1:]


def _bigram_bucket(buckets: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        x, y, left = _all(table, BI_PART, BI_TURN + turn)
        keys, at, left = _sums(_key2(x, y), left)
        x, y = x[at], y[at]
        known = _joint(keys, left, *_all(table, CONTEXT_PART, CONTEXT_TURN + turn))
        out = [_row(3, table.column("bucket")[0].as_py(), _pack(KNOWN, *known), known[1])]
        words, _, before = _sums(y, np.ones(len(y), dtype=np.uint64))
        context, _, *follow = _sums(x, left, *_followed(left))
        known = _joint(words, before, context, *follow)
        for k, (i, j) in enumerate(zip(*_pairs(_edges(known[0], buckets)), strict=True)):
            if i < j:
                out.append(_row(4, k, _pack(KNOWN, *(f[i:j] for f in known)), np.zeros(0, dtype=np.uint64)))
        return _arrow(out)

    return run


def _word_bucket(table: pa.Table) -> pa.Table:
    keys, *columns = _all(table, KNOWN)
    words, _, *known = _sums(keys, *columns)
    return _arrow([_row(5, table.column("bucket")[0].as_py(), _pack(KNOWN, words, *known), known[0])])


def _discounts(row) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from counts of counts; 0 for none."""
    n1, n2, n3, n4 = (max(1, row[f"c{k}"] or 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


@dataclass
class Model:
    """Packed buckets (kind 0: TRI, 3 and 5: KNOWN of bigrams and words), the discounts of the three orders, the sum of
    the words' counts, what any word has, rows of all tables and the number of buckets."""

    tables: DataFrame
    discounts: tuple[np.ndarray, np.ndarray, np.ndarray]
    total: int
    base: float
    rows: int
    buckets: int

    def scorer(self) -> Scorer:
        return Scorer(self.discounts, self.total, self.base)


@dataclass
class Scorer:
    discounts: tuple[np.ndarray, np.ndarray, np.ndarray]
    total: int
    base: float

    def term(self, order: int, n: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return n - self.discounts[order][np.minimum(n, np.uint64(3)).astype(np.intp)]

    def context(self, order: int, total: np.ndarray, *follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and back-off weights of contexts; 1 and 1 for one never seen."""
        freed = sum(d * f for d, f in zip(self.discounts[order][1:], follow, strict=True))
        seen = np.maximum(total, np.uint64(1)).astype(np.float64)
        return seen, np.where(total > 0, freed / seen, 1.0)

    def log10(self, tri, total2, weight2, bi, total1, weight1, uni) -> np.ndarray:
        """log10 P(c | a b) from the terms of (a, b, c), (b, c), c and the contexts (a, b), b."""
        return np.log10(tri / total2 + weight2 * (bi / total1 + weight1 * (uni / self.total + self.base)))


class Tables:
    """Sorted keys of trigrams, bigrams and words with their values."""

    def __init__(self, model: Model):
        self.scorer = s = model.scorer()
        got = model.tables.where("kind in (0, 3, 5)").orderBy("kind", "bucket").select("kind", "data").toArrow()
        keys, n = _all(got, TRI, 0)
        small = lambda *x: [v.astype(np.float32) for v in x]
        self.tri = keys, small(s.term(0, n))
        keys, n, *rest = _all(got, KNOWN, 3)
        self.bi = keys, small(s.term(1, n), *s.context(0, *rest))
        keys, n, *rest = _all(got, KNOWN, 5)
        self.uni = keys, small(s.term(2, n), *s.context(1, *rest))

    @staticmethod
    def look(table: tuple[np.ndarray, list[np.ndarray]], keys: np.ndarray, which: tuple[int, ...]) -> list[np.ndarray]:
        names, values = table
        if not len(names):
            return [np.full(len(keys), float(k > 0)) for k in which]
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        found = names[at] == keys
        return [np.where(found, values[k][at], float(k > 0)) for k in which]

    def log10(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(c | a b)."""
        return self.scorer.log10(
            *self.look(self.tri, _key3(a, b, c), (0,)),
            *self.look(self.bi, _key2(a, b), (1, 2)),
            *self.look(self.bi, _key2(b, c), (0,)),
            *self.look(self.uni, b, (1, 2)),
            *self.look(self.uni, c, (0,)),
        )


def _forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files of a plan when the driver's JVM has collected it; nothing else frees that disk."""
    gc.collect()
    spark._jvm.System.gc()


def _grouped(rows: DataFrame, run: Callable[[pa.Table], pa.Table], *kinds: int) -> list[DataFrame]:
    """The rows that ``run`` makes of each bucket, a table for each kind, so that each can go by itself."""
    out = rows.groupBy("bucket").applyInArrow(run, _ROWS)
    return materialise_by(out, "kind", kinds)


def fit(texts: DataFrame) -> Model | None:
    """The model of the column ``text``, or None if there is no text."""
    spark = texts.sparkSession
    mark = scratch_mark()
    texts = materialise(texts.select("text"))
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    if not size["n"]:
        release_at(mark)
        return None
    buckets = -(-(size["b"] or 1) // BUCKET_BYTES)
    turns = min(SLICES, -(-(size["b"] or 1) // SLICE_BYTES))
    part_turns = min(PART_TURNS, turns)
    kinds = [(BI_TURN + k, CONTEXT_TURN + k) for k in range(part_turns)]
    tri, parts = [], [[] for _ in kinds]
    for turn in range(turns):
        done, *more = _grouped(_trigram_parts(texts, buckets, turn, turns), _trigram_bucket(buckets, part_turns), 0, *sum(kinds, ()))
        tri.append(done)
        for k in range(part_turns):
            parts[k].extend(more[2 * k : 2 * k + 2])
        _forget_shuffles(spark)
    release_at(mark)  # the texts; what came after begins at the mark now
    bi, words = [], []
    for turn in range(part_turns):
        done, more = _grouped(reduce(DataFrame.union, parts[turn]), _bigram_bucket(buckets, turn), 3, 4)
        bi.append(done)
        words.append(more)
        release_kinds(mark, "kind", kinds[turn])
        _forget_shuffles(spark)
    (uni,) = _grouped(reduce(DataFrame.union, words), _word_bucket, 5)
    release_kinds(mark, "kind", (4,))
    tables = reduce(DataFrame.union, [*tri, *bi, uni])
    found = tables.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("rows", "total", "c1", "c2", "c3", "c4")]).collect()
    three, two, one = sorted(found, key=lambda r: r["kind"])
    discounts = tuple(_discounts(r) for r in (three, two, one))
    d = discounts[2]
    freed = one["c1"] * d[1] + one["c2"] * d[2] + (one["rows"] - one["c1"] - one["c2"]) * d[3]
    # what the unigram discounts free is spread over the vocabulary and one unseen word
    base = freed / one["total"] / (one["rows"] + 1)
    return Model(tables, discounts, one["total"], base, three["rows"] + two["rows"] + one["rows"], buckets)


def trusted(labels: DataFrame) -> DataFrame:
    """good_id of every trusted document: quality 1, not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()


def sample(docs: DataFrame, good: DataFrame, most: int) -> DataFrame:
    """good_id of at most ``most`` trusted documents that train: each language's smallest hashes first, language by language."""
    ids = docs.select(F.col("doc_id").cast("long").alias("good_id"), F.col("lang").cast("string").alias("lang"))
    known = ids.join(good.where(fold(F.col("good_id"), HELD_BACK) != 0), "good_id", "left_semi").groupBy("good_id").agg(F.min("lang").alias("lang"))
    known = smallest_hashes(materialise(known), "lang", F.col("good_id"), most).withColumn("k", hash_of(F.col("good_id")))
    known = known.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k", "good_id"))).where(F.col("r") <= most)
    return materialise(known.orderBy("r", "k", "good_id").limit(most).select("good_id"))


def _perplexity(total: Column, n: Column) -> Column:
    """From the sum of log10 probabilities of ``n`` words and an end; null without words."""
    return F.when(n > 0, F.pow(F.lit(10.0), F.least(-total / (n + 1), F.lit(300.0))))


def scored(docs: DataFrame, model: Model | None, most: int = MODEL_ROWS) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity (null without words) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    if model is not None and model.rows > most:
        out = _scored_by_buckets(rows, model)
    else:
        out = _scored_by_tables(rows, model)
    return out.select("doc_id", "lang", "n_tokens", _perplexity(F.col("total"), F.col("n_tokens")).alias("perplexity"))


_SCORES = "doc_id long, lang string, n_tokens long, total double"


def _scores(ids: pa.Array, langs: pa.Array, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, langs, pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "lang", "n_tokens", "total"])


def _scored_by_tables(rows: DataFrame, model: Model | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(Tables(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, tables = Shingler(), sent.value
        for batch, texts in _portions(batches, 2):
            owner, a, b, c = _tokens(texts, shingler)
            n = np.bincount(owner, minlength=len(texts))
            total = np.bincount(owner, tables.log10(a, b, c) if tables else np.zeros(len(owner)), minlength=len(texts))
            yield _scores(*batch.columns[:2], n - 1, total)

    return rows.mapInArrow(run, _SCORES)


def _encoded(rows: DataFrame) -> DataFrame:
    """Portions of documents, once: portion, ids, langs, codes (the numbers of words, then words as places in the
    sorted distinct words), names (those words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, part, count = Shingler(), TaskContext.get().partitionId(), 0
        for batch, texts in _portions(batches, 2, PORTION):
            word, n = _words(texts, shingler)
            names, place = np.unique(word, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + count], pa.int64()),
                    *(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), column) for column in batch.columns[:2]),
                    pa.array([_pack("p", np.concatenate([n, place]))], pa.binary()),
                    pa.array([_pack("d", names)], pa.binary()),
                ],
                ["portion", "ids", "langs", "codes", "names"],
            )
            count += 1

    return materialise(rows.mapInArrow(run, "portion long, ids array<long>, langs array<string>, codes binary, names binary"))


@dataclass
class Portion:
    """The tokens of a portion's texts: text number, place of the word and of the one before it in ``every``, keys of
    the trigram and the bigram that end there, which tokens begin a text; all words, sorted, with START and END."""

    owner: np.ndarray
    word: np.ndarray
    before: np.ndarray
    tri: np.ndarray
    bi: np.ndarray
    first: np.ndarray
    every: np.ndarray

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All trigram, bigram and word keys that the tokens need, the bigram of two STARTs last."""
        return self.tri, np.append(self.bi, STARTS), self.every


def _shifted(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """For each token what ``x`` has for the one before it, ``start`` at the beginning of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def _decoded(size: int, codes: bytes, names: bytes) -> Portion:
    (codes,), (names,) = _unpack("p", codes), _unpack("d", names)
    n = codes[:size].astype(np.intp) + 1
    every = _distinct(np.append(names, [START, END]))
    start, end = np.searchsorted(every, np.array([START, END]))
    last = np.cumsum(n) - 1
    first = last + 1 - n
    word = np.empty(n.sum(), dtype=np.intp)
    inner = np.ones(len(word), dtype=bool)
    inner[last] = False
    word[last], word[inner] = end, np.searchsorted(every, names)[codes[size:].astype(np.intp)]
    before = _shifted(word, first, start)
    token = every[word]
    bi = _key2(every[before], token)
    tri = _mix(_shifted(bi, first, STARTS) * _A + token)
    return Portion(np.repeat(np.arange(size), n), word, before, tri, bi, first, every)


def _questions(encoded: DataFrame, buckets: int, turn: int, turns: int) -> DataFrame:
    """(bucket, portion, tri, bi, uni): distinct keys that a portion asks every ``turns``-th bucket for."""
    own = range(turn, buckets, turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion, size, codes, names in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                keys = _decoded(size, codes, names).asked()
                keys = [_distinct(k[_bucket(k, buckets) % np.uint64(turns) == turn]) for k in keys]
                edges = [_edges(k, buckets) for k in keys]
                packed = [[_pack("d", k[e[i] : e[i + 1]]) for i in own] for k, e in zip(keys, edges, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([portion] * len(own), pa.int64()), *(pa.array(x, pa.binary()) for x in packed)],
                    ["bucket", "portion", "tri", "bi", "uni"],
                )

    rows = encoded.select("portion", F.size("ids").alias("size"), "codes", "names")
    return rows.mapInArrow(run, "bucket int, portion long, tri binary, bi binary, uni binary")


def _answer(questions: pa.Table, tables: pa.Table) -> pa.Table:
    """What a bucket knows of the keys that it is asked for."""
    known = [_all(tables, TRI, 0), _all(tables, KNOWN, 3), _all(tables, KNOWN, 5)]
    out = []
    for column, (names, *values) in zip(("tri", "bi", "uni"), known, strict=True):
        found = []
        for data in questions.column(column):
            (keys,) = _unpack("d", data.as_py())
            if not len(names):
                found.append(_pack("p" * len(values), *[np.zeros(len(keys), dtype=np.uint64)] * len(values)))
                continue
            at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            hit = names[at] == keys
            found.append(_pack("p" * len(values), *(np.where(hit, v[at], np.uint64(0)) for v in values)))
        out.append(pa.array(found, pa.binary()))
    return pa.Table.from_arrays([questions.column("bucket").combine_chunks(), questions.column("portion").combine_chunks(), *out], ["bucket", "portion", "tri", "bi", "uni"])


def _scored_by_buckets(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_tokens, total of every text, by portions that ask the model's buckets."""
    spark, scorer, buckets = rows.sparkSession, model.scorer(), model.buckets
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = max(1, min(SCORE_SLICES, -(-size // SLICE_BYTES)))
    asks = min(ASK_TURNS, buckets)

    def finish(portions: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        known = [_all(answers.select([c]).rename_columns(["data"]), how) for c, how in (("tri", "p"), ("bi", "ppppp"), ("uni", "ppppp"))]
        out = []
        for _, ids, langs, codes, names in zip(*portions.columns, strict=True):
            got = _decoded(len(ids), codes.as_py(), names.as_py())
            owner, (three, two, _) = got.owner, got.asked()
            three, two = (np.unique(k, return_inverse=True)[1] for k in (three, two))
            tri = scorer.term(0, known[0][0])[three]
            context2 = _shifted(two[:-1], got.first, two[-1])
            total2, weight2 = (x[context2] for x in scorer.context(0, *known[1][1:]))
            total1, weight1 = (x[got.before] for x in scorer.context(1, *known[2][1:]))
            bi, uni = scorer.term(1, known[1][0])[two[:-1]], scorer.term(2, known[2][0])[got.word]
            total = np.bincount(owner, scorer.log10(tri, total2, weight2, bi, total1, weight1, uni), minlength=len(ids))
            out.append(_scores(pa.array(ids.values), pa.array(langs.values), np.bincount(owner, minlength=len(ids)) - 1, total))
        return pa.Table.from_batches(out)

    parts = []
    for turn in range(turns):
        mark = scratch_mark()
        encoded = _encoded(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(turns)) == turn))
        _forget_shuffles(spark)  # once more: until another job ran, the JVM holds on to the last one's plan
        answers = []
        for ask in range(asks):
            questions = _questions(encoded, buckets, ask, asks)
            tables = model.tables.where(F.col("bucket") % asks == ask).select("kind", "bucket", "data")
            found = questions.groupBy("bucket").cogroup(tables.groupBy("bucket"))
            answers.append(materialise(found.applyInArrow(_answer, "bucket int, portion long, tri binary, bi binary, uni binary")))
            _forget_shuffles(spark)
        answers = reduce(DataFrame.union, answers)
        parts.append(materialise(encoded.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(finish, _SCORES)))
        release_but_last(mark)
        _forget_shuffles(spark)
    return reduce(DataFrame.union, parts)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_tokens, perplexity, threshold, kept.

    The model learns from all trusted documents that are not held back, or from a sample of ``most``."""
    good = materialise(trusted(labels))
    learnt = good.where(fold(F.col("good_id"), HELD_BACK) != 0) if most is None else sample(docs, good, most)
    # only texts that the bitmap lets through move
    text, _ = sifted(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), sieve(learnt, "good_id"), "id")
    model = fit(text.join(learnt, F.col("id") == F.col("good_id"), "left_semi").select("text"))
    _forget_shuffles(docs.sparkSession)
    df = materialise(scored(docs, model))
    unseen = good.join(learnt, "good_id", "left_anti")
    seen = df.join(unseen, F.col("doc_id") == F.col("good_id"), "left_semi").where("perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, ACCURACY)
    limits = materialise(seen.groupBy("lang").agg(limit.alias("own")))
    overall = materialise(seen.agg(limit.alias("all")))
    limits = limits.where("lang is not null").select(F.col("lang").alias("l"), "own")
    df = df.join(limits, F.col("lang") == F.col("l"), "left").withColumn("all", overall.select("all").scalar())
    df = df.withColumn("threshold", F.coalesce("own", "all"))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return df.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", kept.alias("kept"))
