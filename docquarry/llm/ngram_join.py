"""Similarity join on word n-grams: MinHash banding, then verification on full n-gram sets.

1. Each whole text becomes its set of five-word shingles (64-bit hashes) and a MinHash signature of one byte a
   hash; bands and rows are chosen for a target recall at the threshold.
2. Texts with equal sets are one node, so groups of copies cost nothing further.
3. Nodes that share a band key meet in that key's task, a hot key's in several tasks for pairs of its blocks.
   Only signatures travel.  A pair whose set sizes allow the threshold and whose signatures agree in at least
   ``least_agreement`` places (which loses AGREEMENT_LOSS of the pairs at the threshold) is a candidate; a task
   returns a star for each group that candidates connect, never pairs.
4. Texts of nodes with a candidate are picked by a bitmap of fixed size where they lie.  Connected groups of
   candidates are verified on full shingle sets: a small group in one task, a larger one cut by set size and
   into blocks, where each two blocks near enough in size meet.  A text travels once, or in a group of m nodes at
   most 3 sqrt(m) times (3 m / MOST_BLOCK beyond MOST_BLOCK squared).  A task returns one row for each node that
   has a link (the number of documents linked, and its class within the task).
5. Components of the verified links are the classes.

Worst case: every node's number of links is exact, so a group of m different near copies costs m^2 / 2 set
comparisons, spread over about m / 2 tasks; so does a chain of texts whose neighbours lie between the agreement
limit (a similarity of about 0.68) and the threshold.  Texts that share less, such as a site's boilerplate, meet
by chance in some bands and cost a comparison of signatures for each such meeting.

Defined results: words are runs of non-white-space, compared as they are; texts of one to four words are one
shingle of all their words; null, empty and blank texts have no shingle, are linked to nothing and are classes
of their own; equal texts are linked to one another; rows that repeat a doc_id are separate rows; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sieve, sifted, without
from .components import components

N = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that comparisons are exact
RECALL = 0.9999  # of pairs at the threshold
MAX_HASHES = 192
AGREEMENT_LOSS = 1e-5  # of pairs at the threshold, by comparing signatures before sets
BLOCK, MOST_BLOCK = 32, 256  # nodes of a group that meet those of another block in one task: its square root, between these
KEY_BLOCK, MOST_KEY_BLOCK = 64, 1024  # signatures of a band key: four times the square root, between these

#: Odd multipliers of the hash functions.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SEED = 20240229

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def bands_and_rows(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) within ``most`` hashes that reach ``recall`` at ``threshold``."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if bands and 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return most, 1


def least_agreement(threshold: float, hashes: int, loss: float = AGREEMENT_LOSS) -> int:
    """The largest number of places in which all but ``loss`` of the pairs at ``threshold`` agree."""
    below, chance = 0.0, [math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k) for k in range(hashes + 1)]
    for k in range(hashes + 1):
        below += chance[k]
        if below > loss:
            return k
    return hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of many texts at once: words are hashed by differences of a running polynomial sum."""

    def __init__(self, n: int = N):
        self.n = n
        self.power = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)
        self.factor = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, 1 << 20)
            back = np.uint64(pow(BASE, -1, 1 << 64))
            for name, base in (("power", np.uint64(BASE)), ("inverse", back)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every white-space-delimited word of ``data``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        white = np.ones(len(raw) + 2, dtype=bool)
        white[1:-1] = _WHITE[raw]
        edge = np.flatnonzero(white[1:] != white[:-1])
        start, stop = edge[0::2], edge[1::2]
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=total[1:])
        return _mix((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64)), start

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        word, start = self.words(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(start, ends)
        first = np.concatenate([[0], last[:-1]])
        n = self.n
        grams = np.zeros(0, dtype=np.uint64)
        if len(word) >= n:
            grams = np.zeros(len(word) - n + 1, dtype=np.uint64)
            for k in range(n):
                grams += word[k : len(word) - n + 1 + k] * self.factor[k]
            grams = _mix(grams)
        out = []
        for a, b in zip(first, last, strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(_mix(np.add.reduce(word[a:b] * self.factor[: b - a], keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


class Signer:
    """One byte for each hash function: the least hash of the set, scrambled."""

    def __init__(self, hashes: int):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(1, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)

    def __call__(self, grams: np.ndarray) -> bytes:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(0, len(short), 2048):
            np.minimum(low, (short[k : k + 2048, None] * self.a + self.b).min(axis=0), out=low)
        return (_mix(low.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in portions of about ``size`` bytes of text, so that memory doesn't depend on the batch."""
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(column).cast(pa.binary())]
        begin = held = 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= size or k == len(texts) - 1:
                yield batch.slice(begin, k + 1 - begin), texts[begin : k + 1]
                begin, held = k + 1, 0


def signatures(docs: DataFrame, n: int, hashes: int) -> DataFrame:
    """doc_id, h (a hash of the text as it is), n (shingles), f1 and f2 (128 bits that stand for the set), sig (one
    byte for each hash function)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(n), Signer(hashes)
        for batch, texts in _portions(batches, 2):
            sets = shingler.sets(texts)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            f2 = np.array([_mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            sig = pa.array([signer(s) if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size), pa.array(f1), pa.array(f2), sig], ["doc_id", "h", "n", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text")).mapInArrow(run, "doc_id long, h long, n long, f1 long, f2 long, sig binary")


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """One key for each band of a signature."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring(sig, k * rows + 1, rows)) for k in range(bands)])


def _block(size: Column, factor: int, least: int, most: int) -> Column:
    """Number of blocks in which a group of ``size`` is cut."""
    return F.ceil(size / F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(factor * F.sqrt(size))))).cast("int")


def _meetings(own: Column, blocks: Column) -> Column:
    """Array of (low, high, side) for a row of block ``own``: every pair of blocks that it is in."""
    each = F.sequence(F.lit(0), blocks - 1)
    side = lambda x: F.when(own == x, 0).when(own < x, 1).otherwise(2).cast("int")
    return F.transform(each, lambda x: F.struct(F.least(own, x).cast("int").alias("low"), F.greatest(own, x).cast("int").alias("high"), side(x).alias("side")))


def groups(sig: np.ndarray, size: np.ndarray, agreement: int, threshold: tuple[int, int]) -> np.ndarray:
    """For each row of ``sig`` the first row of its group: rows that candidate pairs connect.

    Each row found is compared with the rows not found yet only, so a group of near copies costs its size and not its
    square."""
    m = len(sig)
    above, below = threshold
    root = np.full(m, -1)
    left = np.arange(m)
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        found = [first]
        while found and len(left):
            at = found.pop()
            near = (size[left] * below >= size[at] * above) & (size[at] * below >= size[left] * above)
            near[near] = (sig[left[near]] == sig[at]).sum(axis=1, dtype=np.int32) >= agreement
            new = left[near]
            root[new] = first
            found.extend(new)
            left = left[~near]
    return root


def _candidates(agreement: int, threshold: tuple[int, int]):
    """Partition function over (task, node, n, sig) sorted by task: (a, b) for each row that a candidate pair
    connects to row b of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task = None

        def flush() -> Iterator[pa.RecordBatch]:
            node, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            sig = np.concatenate([h[2] for h in held])
            held.clear()
            root = groups(sig, n, agreement, threshold)
            some = root != np.arange(len(root))
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["a", "b"])

        for batch in batches:
            names, node, n = (batch.column(k).to_numpy() for k in (0, 1, 2))
            if not len(names):
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), dtype=np.uint8).reshape(len(names), -1)
            edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if names[lo] != task and held:
                    yield from flush()
                task = names[lo]
                held.append((node[lo:hi], n[lo:hi], sig[lo:hi]))
        if held:
            yield from flush()

    return run


def candidates(nodes: DataFrame, bands: int, rows: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) links whose components hold every candidate pair of ``nodes`` (node, n, sig)."""
    keyed = nodes.select("node", F.explode(band_keys(F.col("sig"), bands, rows)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialise(shared.select("key", _block(F.col("members"), 4, KEY_BLOCK, MOST_KEY_BLOCK).alias("blocks")))
    # nodes' signatures meet their shared keys by node: keys that nobody shares carry none
    met = keyed.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("key", "blocks")).alias("at"))
    met = nodes.select("node", "n", "sig").join(met, "node").withColumn("at", F.explode("at"))
    own = F.pmod(F.xxhash64("node", F.col("at.key")), F.col("at.blocks")).cast("int")
    met = met.withColumn("m", F.explode(_meetings(own, F.col("at.blocks"))))
    met = met.select(F.xxhash64("at.key", "m.low", "m.high").alias("task"), "node", "n", "sig")
    run = _candidates(least_agreement(threshold[0] / threshold[1], bands * rows), threshold)
    return met.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], cross: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs that ``cross`` allows and whose Jaccard similarity reaches the threshold."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=bool)
    number = np.cumsum(new) - 1
    many = np.bincount(number) > 1 if len(every) else np.zeros(0, dtype=bool)
    shared = many[number] if len(every) else np.zeros(0, dtype=bool)
    column, owner = (np.cumsum(many) - 1)[number[shared]], owner[shared]
    common = np.zeros((m, m), dtype=np.float32)
    width, wide = 4096, int(many.sum())
    for k in range(0, wide, width):
        lo, hi = np.searchsorted(column, [k, k + width])
        part = np.zeros((m, min(width, wide - k)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - k] = 1
        common += part @ part.T
    inter = common.astype(np.int64)
    above, below = threshold
    return cross & (inter * below >= (size[:, None] + size[None, :] - inter) * above)


def _verify(n: int, threshold: tuple[int, int]):
    """Partition function over (task, side, node, copies, text) sorted by task."""

    def check(nodes: list[int], copies: list[int], sides: list[int], texts: list[bytes], shingler: Shingler) -> tuple[np.ndarray, ...]:
        side = np.array(sides)
        if (side == 0).all():  # all pairs of one block
            cross = ~np.eye(len(nodes), dtype=bool)
        else:
            cross = side[:, None] != side[None, :]
        link = linked(shingler.sets(texts), cross, threshold)
        node = np.array(nodes, dtype=np.int64)
        weight = link @ np.array(copies, dtype=np.int64)
        root, before = node.copy(), None
        while before is None or (before != root).any():
            before = root.copy()
            root = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        some = link.any(axis=1)
        return node[some], weight[some].astype(np.int64), root[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        task, held, here = None, ([], [], [], []), set()
        done: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            out = [np.concatenate(c) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["node", "weight", "root"])

        for batch in batches:
            for k, side, node, copies, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4).cast(pa.binary()), strict=True):
                if k == task and node in here:
                    continue  # a row that repeats doc_id and text
                if k != task:
                    here = set()
                    if len(held[0]) > 1:
                        done.append(check(*held, shingler))
                    task, held = k, ([], [], [], [])
                    if len(done) >= 1000:
                        yield flush()
                here.add(node)
                for column, value in zip(held, (node, copies, side, text.as_py() or b""), strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            done.append(check(*held, shingler))
        if done:
            yield flush()

    return run


def _tasks(grouped: DataFrame, ratio: float, block: int, most: int) -> DataFrame:
    """(node, task, side) of nodes (node, n, root, members): groups of up to ``2 * block`` nodes are one task.  Larger
    ones are cut by size class (neighbouring classes cover every pair whose sizes allow the threshold), then by hash
    into blocks, and each pair of blocks of equal or neighbouring classes is a task."""
    small = F.col("members") <= 2 * block
    grade = F.when(small, F.lit(0)).otherwise(F.floor(F.log(F.col("n")) / F.lit(-np.log(ratio)) + 1e-9)).cast("int")
    df = grouped.withColumn("grade", grade)
    cut = F.when(F.max("members") <= 2 * block, F.lit(1)).otherwise(_block(F.count("*"), 1, block, most))
    blocks = materialise(df.groupBy("root", "grade").agg(cut.alias("blocks")))
    here = blocks.select(F.col("root").alias("hr"), F.col("grade").alias("hg"), F.col("blocks").alias("b0"))
    above = blocks.select(F.col("root").alias("ar"), F.col("grade").alias("ag"), F.col("blocks").alias("b1"))
    below = blocks.select(F.col("root").alias("br"), F.col("grade").alias("bg"), F.col("blocks").alias("b2"))
    plan = here.join(above, (F.col("hr") == F.col("ar")) & (F.col("hg") + 1 == F.col("ag")), "left")
    plan = materialise(plan.join(below, (F.col("hr") == F.col("br")) & (F.col("hg") - 1 == F.col("bg")), "left").select("hr", "hg", "b0", F.coalesce("b1", F.lit(0)).alias("b1"), F.coalesce("b2", F.lit(0)).alias("b2")))
    df = df.join(plan, (F.col("root") == F.col("hr")) & (F.col("grade") == F.col("hg")))
    df = df.withColumn("own", F.pmod(F.xxhash64("node"), F.col("b0")).cast("int"))
    own, g = F.col("own"), F.col("grade")

    def meet(g1, s1, g2, s2, side):
        return F.struct(F.xxhash64(F.col("root"), g1, s1, g2, s2).alias("task"), side.cast("int").alias("side"))

    def beside(n, task):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), task)).otherwise(F.array().cast("array<struct<task:bigint,side:int>>"))

    same = F.transform(_meetings(own, F.col("b0")), lambda x: meet(g, x["low"], g, x["high"], x["side"]))
    up = beside("b1", lambda x: meet(g, own, g + 1, x, F.lit(1)))
    down = beside("b2", lambda x: meet(g - 1, x, g, own, F.lit(2)))
    return df.select("node", F.explode(F.concat(same, up, down)).alias("t")).select("node", "t.task", "t.side")


def classes(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK, most: int = MOST_BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the class), n_links (documents linked
    to this one directly), n_copies (documents with the same shingle set), n_shingles, h (hash of its text)."""
    ratio = threshold[0] / threshold[1]
    bands, rows = bands_and_rows(ratio, recall)
    signed = materialise(signatures(docs, n, bands * rows))
    grouped = signed.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("low"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    grouped = grouped.select("f1", "f2", "n", F.col("low.doc_id").alias("first"), F.col("low.h").alias("h"), "copies", "sig")
    nodes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()))

    near = materialise(components(candidates(nodes, bands, rows, threshold)))
    sizes = materialise(near.groupBy("root").agg(F.count("*").alias("members")))
    tasks = _tasks(materialise(near.join(sizes, "root").join(nodes.select("node", "n"), "node")), ratio, block, most)
    tasks = materialise(tasks.join(nodes.select("node", "first", "h", "copies"), "node"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # only candidates' texts are shuffled; the join is the same at every size
    text, _ = sifted(text, sieve(tasks, "first", "h"), "id", "th")
    joined = tasks.hint("merge").join(text, F.col("first").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")))
    rows_in = joined.select("task", "side", "node", "copies", "text").repartition("task").sortWithinPartitions("task")
    found = materialise(rows_in.mapInArrow(_verify(n, threshold), "node long, weight long, root long"))

    weight = found.groupBy("node").agg(F.sum("weight").alias("links"))
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    tied = materialise(tied.select(F.col("node"), F.col("root").alias("class")))
    every = nodes.select("node", "first", "copies", "f1", "f2", "n").join(tied, "node", "left").join(weight, "node", "left")
    every = materialise(every.withColumn("class", F.coalesce("class", "node")))
    named = materialise(every.groupBy("class").agg(F.min("first").alias("class_id")))
    every = materialise(every.join(named, "class").select("f1", "f2", "n", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    with_set = signed.where("n > 0").select("doc_id", "h", "f1", "f2", "n").join(every, ["f1", "f2", "n"])
    with_set = with_set.select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"), F.col("n").alias("n_shingles"), "h")
    without = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("n").alias("n_shingles"), "h")
    return with_set.unionByName(without)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each class, all columns.  Rows that repeat both
    doc_id and text stay or go together."""
    verdict = classes(docs, **options)
    gone = verdict.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_digest"))
    return without(docs, materialise(gone.distinct()), F.xxhash64("text"))


__all__ = ["bands_and_rows", "candidates", "classes", "keep_first", "least_agreement", "linked"]
