"""Language-model scoring with a gated recurrent network in numpy.

Corpus counts: training words are counted over all training documents; the HEAD most frequent ones, a table of
fixed size, are broadcast.  Every other word meets its count in a shuffle join; such a word has at most a
1/HEAD share of the words counted, so no key is hot.

Network: a gated recurrent unit over words, with a class-factored softmax: the VOCABULARY most frequent words
(and the end token) are cut by frequency into classes of equal size, P(word) = P(class) P(word | class).  All
other words are in ENDINGS more classes by their last two characters (the most frequent endings, and one class for
the rest); within such a class a word's share follows its counts, and every word never seen has that of half a
count.  So the score is the probability of the whole text, whatever its words, and the network starts out as the
unigram model.

Texts are turned into numbers once, in a table of two bytes a token that training and scoring read.

Training: truncated backpropagation in windows whose state is carried on; each training document is in one of
the rounds.  Shards (partitions of that table as it lies, so no text is shuffled) train side by side from the same
weights, and a tree of averages joins them, once a round.  Which documents share a shard follows from the input's
files, so other files of the same rows give slightly other weights.

Scoring: documents advance side by side in windows, states carried across windows from the first to the last
token; longer ones go on while shorter ones have ended.

Defined results: null and empty texts are one end token; texts are read whole; without training documents
every count is 0 and the base falls back to its formula; rows that repeat a doc_id are scored separately; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .ngram_join import _portions

HEAD = 1 << 17
CLASSES, MEMBERS = 32, 64
VOCABULARY = CLASSES * MEMBERS  # the end token is number 0
ENDINGS = 64  # classes of words outside the vocabulary
HIDDEN = 16
WINDOW = 16
STREAMS = 256  # texts side by side; fewer, down to LEAST_STREAMS, where a shard has no more than UPDATES windows of them
LEAST_STREAMS, UPDATES = 16, 256
SCALE = 64  # of a window's mean gradient, before it is clipped
RATE = 0.15
ROUNDS = 2  # each trains on its own part of the training documents, together on all
SHARD = 2_000_000  # tokens of a shard, about, where partitions hold fewer
CHUNK = 2_000_000  # tokens that a shard lays out side by side at once
FAN_IN = 16  # shards averaged at once
GROUP = 2_000_000  # tokens that a worker gathers, to score texts of like lengths side by side
SIDE = 512
# numbers: the vocabulary, then the classes of other words (the last for endings that are not listed), then a text's begin
REST, BEGIN = VOCABULARY + ENDINGS - 1, VOCABULARY + ENDINGS

PIECE = 1 << 16  # floats of a shard's weights in one row

_SHAPES = {
    "wx": (BEGIN + 1, 3 * HIDDEN),
    "u": (HIDDEN, 3 * HIDDEN),
    "bx": (3 * HIDDEN,),
    "wc": (CLASSES + ENDINGS, HIDDEN),
    "bc": (CLASSES + ENDINGS,),
    "ww": (CLASSES, MEMBERS, HIDDEN),
    "bw": (CLASSES, MEMBERS),
}


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES]).astype(np.float32)


def _unflat(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).copy()
        at += size
    return out


def start_weights(counts: np.ndarray, other: np.ndarray) -> dict[str, np.ndarray]:
    """A network that gives each vocabulary entry and each class of other words its unigram share; ``counts`` may be
    shorter than the vocabulary, what is missing has no probability to speak of."""
    rng = np.random.default_rng(7)
    p = np.full(VOCABULARY, 1e-9)
    p[: len(counts)] = counts + 0.5
    p = p.reshape(CLASSES, MEMBERS)
    mass = np.append(p.sum(axis=1), np.zeros(ENDINGS) + other + 0.5)
    w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES.items()}
    w["bx"][:] = 0
    w["bc"] = np.log(mass / mass.sum()).astype(np.float32)
    w["bw"] = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
    w["wc"] *= 0.1
    w["ww"] *= 0.1
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * np.float32(0.5))
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated recurrent step: state, reset gate, update gate, candidate, the candidate's recurrent part."""
    n = HIDDEN
    hu = h @ w["u"]
    gates = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
    r, z = gates[:, :n], gates[:, n:]
    a = hu[:, 2 * n :]
    c = np.tanh(x[:, 2 * n :] + r * a)
    return (1 - z) * c + z * h, r, z, c, a


def _exp(x: np.ndarray) -> tuple[np.ndarray | float, np.ndarray]:
    """What was taken off each row of ``x`` and the sum of its exponentials; ``x`` becomes the exponentials."""
    if float(x.max(initial=0)) < 80:  # a row's own maximum is only needed where a sum could leave the range
        out = np.exp(x)
        total = out @ np.ones(x.shape[1], dtype=np.float32)
        if float(total.min(initial=1)) > 1e-30:
            x[...] = out
            return 0.0, total
    top = x.max(axis=1)
    x -= top[:, None]
    np.exp(x, out=x)
    return top, x.sum(axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row; ``x`` is overwritten."""
    _, total = _exp(x)
    x *= (1 / total)[:, None]
    return x


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; ``x`` is overwritten."""
    top, total = _exp(x)
    return top + np.log(total)


def _kind(number: np.ndarray) -> np.ndarray:
    """The output class of each number."""
    return np.where(number < VOCABULARY, number // MEMBERS, number - VOCABULARY + CLASSES).astype(np.int16)  # sorted by radix


def _by_class(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def log_probabilities(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log P(target | h); targets from VOCABULARY on are classes of other words."""
    kind = _kind(target)
    outer = h @ w["wc"].T + w["bc"]
    logp = outer[np.arange(len(h)), kind].astype(np.float64)
    logp -= _log_sum(outer)
    for k, rows in _by_class(kind):
        inner = h[rows] @ w["ww"][k].T + w["bw"][k]
        mine = inner[np.arange(len(rows)), target[rows] % MEMBERS]
        logp[rows] += mine - _log_sum(inner)
    return logp


def document_scores(w: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole document (numbers, the end token last)."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    total = np.zeros(len(docs))
    if not len(docs):
        return total
    order = np.argsort(-size, kind="stable")
    every = np.concatenate(docs).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    wx = w["wx"] + w["bx"]
    for k in range(0, len(docs), SIDE):  # of like lengths
        here = order[k : k + SIDE]
        total[here] = _side_by_side(w, wx, every, begin[here], size[here])
    return total


def _side_by_side(w: dict[str, np.ndarray], wx: np.ndarray, every: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores of texts that begin at ``begin`` in ``every``, longest first: those that go on at a place come first."""
    total = np.zeros(len(size))
    h = np.zeros((len(size), HIDDEN), dtype=np.float32)
    before = np.full(len(size), BEGIN)
    active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")
    t = 0
    while t < size[0]:
        states, targets, counts = [], [], []
        room = WINDOW * STREAMS  # a window is longer where fewer documents go on
        while t < size[0] and room > 0:
            n = int(active[t])
            h = _step(w, wx[before[:n]], h[:n])[0]
            before = every[begin[:n] + t]
            states.append(h)
            targets.append(before)
            counts.append(n)
            room -= n
            t += 1
        logp = log_probabilities(w, np.concatenate(states), np.concatenate(targets))
        at = 0
        for n in counts:
            total[:n] += logp[at : at + n]
            at += n
    return total


def train(w: dict[str, np.ndarray], docs: list[np.ndarray]) -> int:
    """Truncated backpropagation over ``docs``, in place; returns the number of tokens seen."""
    target = np.concatenate(docs).astype(np.int64)
    given = np.concatenate([[BEGIN], target[:-1]])
    fresh = np.zeros(len(target), dtype=bool)
    fresh[np.cumsum([0, *[len(d) for d in docs[:-1]]])] = True
    given[fresh] = BEGIN
    streams = max(1, min(STREAMS, len(target) // WINDOW, max(LEAST_STREAMS, len(target) // WINDOW // UPDATES)))
    length = -(-len(target) // streams)
    pad = streams * length - len(target)
    lay = lambda x, fill: np.ascontiguousarray(np.concatenate([x, np.full(pad, fill, dtype=x.dtype)]).reshape(streams, length).T)
    live = lay(np.ones(len(target), dtype=np.float32), 0)
    given, target_at, goes_on = lay(given, BEGIN), lay(target, 0), 1 - lay(fresh, True).astype(np.float32)
    seen = {k: np.full(v.shape, 1e-6, dtype=np.float32) for k, v in w.items()}
    n = HIDDEN

    def update(name: str, grad: np.ndarray, at=slice(None)) -> None:
        np.clip(grad, -1, 1, out=grad)
        total = seen[name][at] + grad * grad
        seen[name][at] = total
        grad *= RATE
        grad /= np.sqrt(total)
        w[name][at] -= grad

    there, name = np.zeros(BEGIN + 1, dtype=bool), np.zeros(BEGIN + 1, dtype=np.int16)
    h = np.zeros((streams, n), dtype=np.float32)
    for t0 in range(0, length, WINDOW):
        rows = range(t0, min(t0 + WINDOW, length))
        ids = given[rows.start : rows.stop].ravel()
        there[:] = False
        there[ids] = True
        used = np.flatnonzero(there)
        name[used] = np.arange(len(used))
        place = name[ids]
        x = (w["wx"][used] + w["bx"])[place].reshape(len(rows), streams, 3 * n)
        past, kept = np.empty((len(rows), streams, n), dtype=np.float32), []
        hs = np.empty((len(rows), streams, n), dtype=np.float32)
        for i, t in enumerate(rows):
            np.multiply(h, goes_on[t][:, None], out=past[i])
            h, *gates = _step(w, x[i], past[i])
            hs[i] = h
            kept.append(gates)
        hs = hs.reshape(-1, n)
        y = target_at[rows.start : rows.stop].ravel()
        weight = live[rows.start : rows.stop].ravel()
        weight = weight * np.float32(SCALE / max(1.0, float(weight.sum())))
        kind = _kind(y)
        dc = _softmax(hs @ w["wc"].T + w["bc"])
        dc[np.arange(len(y)), kind] -= 1
        dc *= weight[:, None]
        dh = dc @ w["wc"]
        # rows in order of their class: each class multiplies its own slice, the rest is one pass over all
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        listed = order[: edges[-1]]
        met = np.flatnonzero(np.diff(edges))
        ordered = hs[listed]
        d = np.empty((len(listed), MEMBERS), dtype=np.float32)
        for k in met:
            np.matmul(ordered[edges[k] : edges[k + 1]], w["ww"][k].T, out=d[edges[k] : edges[k + 1]])
            d[edges[k] : edges[k + 1]] += w["bw"][k]
        d = _softmax(d)
        d[np.arange(len(listed)), y[listed] % MEMBERS] -= 1
        d *= weight[listed][:, None]
        back = np.empty((len(listed), n), dtype=np.float32)
        grads = np.empty((len(met), MEMBERS, n), dtype=np.float32)
        for j, k in enumerate(met):
            part = d[edges[k] : edges[k + 1]]
            np.matmul(part, w["ww"][k], out=back[edges[k] : edges[k + 1]])
            np.matmul(part.T, ordered[edges[k] : edges[k + 1]], out=grads[j])
        dh[listed] += back
        update("wc", dc.T @ hs)
        update("bc", dc.sum(axis=0))
        if len(met):
            update("ww", grads, met)
            update("bw", np.add.reduceat(d, edges[met], axis=0), met)
        dh = dh.reshape(len(rows), streams, n)
        carry = np.zeros((streams, n), dtype=np.float32)
        dx = np.empty((len(rows), streams, 3 * n), dtype=np.float32)
        du = np.empty((len(rows), streams, 3 * n), dtype=np.float32)
        for i in range(len(rows) - 1, -1, -1):
            r, z, c, a = kept[i]
            g = dh[i] + carry
            dcand = g * (1 - z) * (1 - c * c)
            dx[i, :, :n] = dcand * a * r * (1 - r)
            dx[i, :, n : 2 * n] = g * (past[i] - c) * z * (1 - z)
            dx[i, :, 2 * n :] = dcand
            du[i, :, : 2 * n] = dx[i, :, : 2 * n]
            np.multiply(dcand, r, out=du[i, :, 2 * n :])
            carry = (g * z + du[i] @ w["u"].T) * goes_on[rows.start + i][:, None]
        du, dx = du.reshape(-1, 3 * n), dx.reshape(-1, 3 * n)
        order = np.argsort(place, kind="stable")
        summed = np.add.reduceat(dx[order], np.searchsorted(place[order], np.arange(len(used))), axis=0)
        update("u", past.reshape(-1, n).T @ du)
        update("bx", summed.sum(axis=0))
        update("wx", summed, used)
    return len(target)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of the column ``text``; words are combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            some, numbers = list(counts.keys()), list(counts.values())
            counts.clear()
            for k in range(0, len(some), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 50_000], pa.binary()).cast(pa.string()), pa.array(numbers[k : k + 50_000], pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > 400_000:
                    yield from flush()
        yield from flush()

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int = HEAD) -> tuple[list[bytes], np.ndarray]:
    """Words and counts, most frequent first: all words above the lowest count that leaves ``most`` at most.

    The limit comes from the number of words by count, so no task gathers the candidates of all others."""
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).collect()
    total, above = 0, 0
    for row in by_count:
        if total + row["n"] > most:
            above = row["c"]
            break
        total += row["n"]
    head = counts.where(F.col("c") > above).toArrow()
    words = pc.cast(head.column("word"), pa.binary()).to_pylist()
    number = head.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-number[k], words[k]))
    return [words[k] for k in order], number[order]


def ending(word: bytes) -> str:
    return word.decode("utf-8", "replace")[-2:]


def class_of(word: bytes, endings: dict[str, int]) -> int:
    """The number of the class of a word outside the vocabulary."""
    return endings.get(ending(word), REST)


def _endings(counts: DataFrame, listed: list[bytes], found: np.ndarray) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Class numbers of the most frequent endings among words that are not ``listed`` (with counts ``found``), and for
    each class how often its words occur and how many there are."""
    every = counts.agg(F.sum("c").alias("n"), F.count("*").alias("k")).first()
    rows = counts.groupBy(F.right("word", F.lit(2)).alias("ending")).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    # the vocabulary can only take an ending out of the first ones, so its size more of them are enough
    left = {r["ending"]: [r["n"], r["k"]] for r in rows.orderBy(F.desc("n"), "ending").limit(VOCABULARY + ENDINGS).collect()}
    for word, c in zip(listed, found, strict=True):
        if (mine := left.get(ending(word))) is not None:
            mine[0] -= int(c)
            mine[1] -= 1
    chosen = sorted((e for e in left if left[e][1] > 0), key=lambda e: (-left[e][0], e))[: ENDINGS - 1]
    total, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for k, e in enumerate(chosen):
        total[k], kinds[k] = left[e]
    total[-1] = int(every["n"] or 0) - int(found.sum()) - total.sum()
    kinds[-1] = int(every["k"]) - len(listed) - kinds.sum()
    return {e: VOCABULARY + k for k, e in enumerate(chosen)}, total, kinds


def _average(parts: DataFrame, shards: int) -> np.ndarray:
    """Mean weights, by number of tokens, of rows (shard, piece, tokens, data); FAN_IN rows meet in a task."""
    schema = "shard long, piece int, tokens long, data binary"

    def join(table: pa.Table) -> pa.Table:
        tokens = np.array(table.column("tokens").to_pylist(), dtype=np.float64)
        total = 0.0
        for n, data in zip(tokens, table.column("data"), strict=True):
            total = total + n * np.frombuffer(data.as_py(), dtype=np.float32)
        row = [table.column("shard")[0].as_py() // FAN_IN, table.column("piece")[0].as_py(), int(tokens.sum()), (total / max(1.0, tokens.sum())).astype(np.float32).tobytes()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "piece", "tokens", "data"])

    while shards > 1:
        parts = materialise(parts.withColumn("up", F.floor(F.col("shard") / FAN_IN)).groupBy("up", "piece").applyInArrow(_without_up(join), schema))
        shards = -(-shards // FAN_IN)
    rows = sorted((r["piece"], bytes(r["data"])) for r in parts.select("piece", "data").collect())
    return np.frombuffer(b"".join(d for _, d in rows), dtype=np.float32)


def _without_up(join):
    return lambda table: join(table.drop_columns(["up"]))


def encode(docs: DataFrame, names: list[bytes], code: np.ndarray, count: np.ndarray, endings: dict[str, int], log_base: float, log_other: np.ndarray) -> DataFrame:
    """Every whole text as numbers, once: rid, doc_id, held_out, n_tokens, n_known, base and share (what the words that
    are listed in ``names`` give), codes (16 bits a token, the end last) and rest (the words that are not listed)."""
    sent = docs.sparkSession.sparkContext.broadcast((names, np.concatenate([[0], code]), count, endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, count, endings = sent.value
        rank, log_count = {x: k for k, x in enumerate(names, 1)}, np.log10(count + 0.5)
        for batch, texts in _portions(batches, 3):
            words = [t.lower().split() for t in texts]
            flat = list(chain.from_iterable(words))
            n = np.array([len(w) for w in words], dtype=np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            number = np.fromiter(map(rank.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
            outside = np.flatnonzero(number < 0)
            coded = code[number]
            coded[outside] = [class_of(flat[k], endings) for k in outside]
            sums = lambda value: np.bincount(owner, value, minlength=len(n))
            listed, tail = number >= 0, coded >= VOCABULARY
            logs = np.where(listed, log_count[number], 0.0)
            known = sums(listed & (count[number] > 0)).astype(np.int64) + int(count[0] > 0)
            base = sums(logs) + log_count[0] - (n + 1) * log_base
            # counts of words outside the list are still to come
            share = sums(np.where(tail, logs - log_other[np.where(tail, coded - VOCABULARY, 0)], 0.0))
            line = np.zeros(len(flat) + len(n), dtype="<i2")
            line[np.arange(len(flat)) + owner] = coded
            edges = np.concatenate([[0], np.cumsum(2 * (n + 1))]).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(line)])
            lists = np.concatenate([[0], np.cumsum(np.bincount(owner[outside], minlength=len(n)))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(lists), pa.array([flat[k] for k in outside], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n + 1), pa.array(known), pa.array(base), pa.array(share), codes, rest],
                ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "codes", "rest"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, codes binary, rest array<string>"
    return materialise(numbered.mapInArrow(run, schema))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for x in batch.column(column):
        yield np.frombuffer(x.as_py(), dtype="<i2")


def fit(coded: DataFrame, tokens: int, w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
    """``w`` trained on all texts of ``coded`` (doc_id, codes), and the number of tokens seen; ``tokens`` is how many
    there are, which sets how many shards there are at most."""
    seen = 0
    for turn in range(ROUNDS):
        shards = max(1, round(tokens / ROUNDS / SHARD))
        sent = coded.sparkSession.sparkContext.broadcast(_flat(w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, docs, held, done = _unflat(sent.value), [], 0, 0
            for batch in batches:
                for number in _texts(batch, 0):
                    docs.append(number)
                    held += len(number)
                    if held >= CHUNK:
                        done += train(mine, docs)
                        docs, held = [], 0
            if docs:
                done += train(mine, docs)
            if not done:
                return
            out = _flat(mine)
            shard = TaskContext.get().partitionId()
            for k in range(0, len(out), PIECE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([k // PIECE], pa.int32()), pa.array([done], pa.int64()), pa.array([out[k : k + PIECE].tobytes()], pa.binary())],
                    ["shard", "piece", "tokens", "data"],
                )

        some = coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("codes").coalesce(shards)
        parts = materialise(some.mapInArrow(run, "shard long, piece int, tokens long, data binary"))
        top, done = parts.agg(F.max("shard"), F.sum(F.when(F.col("piece") == 0, F.col("tokens")))).first()
        if top is not None:
            w = _unflat(_average(parts, max(2, top + 1)))
            seen += done
        sent.unpersist()
    return w, seen


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = materialise(word_counts(learn))
    whole = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = learn.count()
    n, v = int(whole["n"] or 0) + ends, int(whole["v"]) + (ends > 0)
    names, found = _most_frequent(counts)
    # number 0 is the end token, then words by frequency
    count = np.concatenate([[ends], found]).astype(np.int64)
    listed = count[:VOCABULARY]
    endings, others, kinds = _endings(counts, names[: VOCABULARY - 1], found[: VOCABULARY - 1])
    code = np.array([k if k < VOCABULARY else class_of(x, endings) for k, x in enumerate(names, 1)], dtype=np.int64)
    log_base = float(np.log10(n + 0.5 * (v + 1)))
    coded = encode(docs, names, code, count, endings, log_base, np.log10(others + 0.5 * (kinds + 1)))
    w, _ = fit(coded.where(~F.col("held_out")), n, start_weights(listed, others))
    sent = docs.sparkSession.sparkContext.broadcast(_flat(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, waiting, texts, tokens = _unflat(sent.value), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            logp, at = document_scores(w, texts) / np.log(10), 0
            for batch in waiting:
                here = pa.array(logp[at : at + batch.num_rows] + batch.column(5).to_numpy())
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(6), here], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            waiting.append(batch.drop_columns(["codes"]))
            texts.extend(_texts(batch, 7))
            tokens = sum(map(len, texts))
            if tokens >= GROUP:
                yield from flush()
                waiting, texts = [], []
        if waiting:
            yield from flush()

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rows = coded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "share", "base", "codes").mapInArrow(run, schema)
    outside = coded.select("rid", F.explode("rest").alias("word"))
    met = outside.join(counts, "word", "left").select("rid", F.coalesce("c", F.lit(0)).alias("c"))
    late = met.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("late"), F.sum((F.col("c") > 0).cast("long")).alias("late_known"))
    out = rows.join(late, "rid", "left")
    more = F.coalesce("late", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
