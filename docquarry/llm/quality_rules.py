"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0).  Expectation-maximisation estimates for each rule how often it
votes good or bad on good and on bad documents, and each document gets a posterior probability of being good.

The votes of m rules make at most 3**m patterns, so the statistics that EM needs are one count per pattern.
Counting is one map-side combined aggregation; EM then runs as one SQL expression (``aggregate`` over the
iterations) on the array of patterns, whose size depends on the number of rules and not on the corpus.

Defined results: null and empty texts have no words and fail the base filter; texts are read whole; repeated
rows are scored alike; an empty table gives an empty table; columns of ``docs`` that clash with an output
name keep their values, the output name gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, free_name, materialise, words

#: Name, condition for a good vote, condition for a bad vote.  Integer arithmetic, valid in
#: Spark SQL and DuckDB alike; the counts are those of ``signals``.
RULES = [  # bars: tables and menus flattened to text; shouts: exclamations of advertising
    ("length", "n_words >= 40", "n_words < 10"),
    ("word_size", "word_chars >= 3 * n_words and word_chars <= 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > 3 * n_words"),
    ("lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "20 * n_repeat_words <= n_words", "100 * n_repeat_words > 20 * n_words"),
    ("capitals", "10 * n_capitals <= 2 * n_chars", "10 * n_capitals > 4 * n_chars"),
    ("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 7 * word_chars"),
    ("bars", "n_bars = 0", "10 * n_bars > 2 * n_words"),
    ("shouts", "50 * n_shouts <= n_words", "10 * n_shouts > 3 * n_words"),
]
#: The base filter, all of which must pass.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
#: Fixed values of EM: first guesses of P(bad), P(bad vote | bad), P(bad vote | good); pseudo-count; rounds.
START_BAD, START_HIT, START_SLIP, PSEUDO, ROUNDS = 0.2, 0.5, 0.02, 1.0, 12

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_capitals", "n_letters", "n_shouts", "n_bars"]


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def signals(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``carry`` columns and the counts of each whole text; the second value maps a count to its column.

    A five-word window is known by a 64-bit hash within its own text.
    """
    at = {}
    for name in [*COUNTS, "w_", "h_", "s_", "l_", "t_"]:
        at[name] = free_name([*carry, *at.values()], name)
    w, h, s, l, t = (at[x] for x in ("w_", "h_", "s_", "l_", "t_"))
    q = lambda c: F.col(f"`{c}`")
    keep = [q(c) for c in carry]
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias(t))
    df = df.select(*keep, q(t), words(q(t)).alias(w), F.filter(F.split(q(t), "\n"), lambda x: x.rlike(WORD)).alias(l))
    window = F.when(F.size(q(w)) >= 5, F.transform(F.sequence(F.lit(1), F.size(q(w)) - 4), lambda i: F.xxhash64(F.slice(q(w), i, 5))))
    df = df.select(
        *keep,
        F.size(q(w)).cast("long").alias(at["n_words"]),
        F.length(F.array_join(q(w), "")).cast("long").alias(at["word_chars"]),
        _kept_chars(q(t), r"[^#*$%&|<>]+").alias(at["n_symbols"]),
        (F.size(q(l)) - F.size(F.array_distinct(q(l)))).cast("long").alias(at["n_dup_lines"]),
        F.size(q(l)).cast("long").alias(at["n_lines"]),
        F.length(q(t)).cast("long").alias(at["n_chars"]),
        _kept_chars(q(t), r"[^\p{Lu}]+").alias(at["n_capitals"]),
        _kept_chars(q(t), r"[^\p{L}]+").alias(at["n_letters"]),
        F.size(F.regexp_extract_all(q(t), F.lit(r"!(?:[\x20\x09-\x0D]|$)"), F.lit(0))).cast("long").alias(at["n_shouts"]),
        _kept_chars(q(t), r"[^|]+").alias(at["n_bars"]),
        F.coalesce(window, F.array().cast("array<bigint>")).alias(h),
    )
    # Only where a window repeats are windows sorted with their places; equal neighbours are repeats.
    repeats = F.size(F.array_distinct(q(h))) < F.size(q(h))
    placed = F.when(repeats, F.array_sort(F.transform(q(h), lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    names = [at[c] for c in COUNTS if c != "n_repeat_words"]
    df = df.select(*keep, *[q(c) for c in names], placed.alias(s))

    def place(x: Column, k: Column) -> Column:
        before = F.get(q(s), k - 1)["x"] == x["x"]
        after = F.get(q(s), k + 1)["x"] == x["x"]
        return F.when(before | after, x["i"])

    df = df.select(*keep, *[q(c) for c in names], F.array_sort(F.array_compact(F.transform(q(s), place))).alias(s))
    step = F.transform(q(s), lambda p, k: F.least(F.lit(5), F.coalesce(F.get(q(s), k + 1) - p, F.lit(5))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select(*keep, *[q(c) for c in names], F.coalesce(covered, F.lit(0).cast("long")).alias(at["n_repeat_words"]))
    return df, {c: at[c] for c in COUNTS}


def _rule_sql(condition: str, at: dict[str, str]) -> str:
    import re

    return re.sub(r"\b(" + "|".join(COUNTS) + r")\b", lambda m: f"`{at[m[1]]}`", condition)


def em_expression(patterns: str = "patterns", rules: int = len(RULES)) -> str:
    """Spark SQL for the model struct<bad, hit array, slip array, yes array, no array> from ``patterns``,
    an array<struct<v array<int>, n bigint>> of vote patterns and counts.

    hit and slip are P(bad vote | bad) and P(bad vote | good), yes and no the same of good votes.
    """
    fill = lambda x: f"array_repeat(cast({x} as double), {rules})"
    start = f"named_struct('bad', cast({START_BAD} as double), 'hit', {fill(START_HIT)}, 'slip', {fill(START_SLIP)}, 'yes', {fill(1 - START_HIT)}, 'no', {fill(1 - START_SLIP)})"
    odds = posterior_log_odds("p.v", "s")
    post = f"transform({patterns}, p -> named_struct('v', p.v, 'n', cast(p.n as double), 'b', cast(p.n as double) / (1 + exp({odds}))))"
    # sums over patterns of what is bad (b) and good (n - b), for each rule by its vote
    total = lambda what, when: f"aggregate(q, cast(0 as double), (a, p) -> a + if({when}, {what}, cast(0 as double)))"
    each = lambda what, vote: (
        f"transform(sequence(0, {rules - 1}), j -> ({total(what, f'p.v[j] = {vote}')} + {PSEUDO} * {0.1 if vote == -1 else 0.9}) / ({total(what, 'p.v[j] <> 0')} + {PSEUDO}))"
    )
    # transform over a one-element array gives the posterior table a name
    step = (
        f"element_at(transform(array({post}), q -> named_struct("
        f"'bad', ({total('p.b', 'true')} + {PSEUDO} * {START_BAD}) / ({total('p.n', 'true')} + {PSEUDO}), "
        f"'hit', {each('p.b', -1)}, 'slip', {each('p.n - p.b', -1)}, 'yes', {each('p.b', 1)}, 'no', {each('p.n - p.b', 1)})), 1)"
    )
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})"


def posterior_log_odds(votes: str, model: str) -> str:
    """Spark SQL: log odds that a document with ``votes`` is good under ``model``."""
    evidence = (
        f"aggregate(zip_with({votes}, sequence(0, size({votes}) - 1), (x, j) -> "
        f"case when x = -1 then ln({model}.slip[j] / {model}.hit[j]) when x = 1 then ln({model}.no[j] / {model}.yes[j]) else cast(0 as double) end), "
        f"cast(0 as double), (a, x) -> a + x)"
    )
    return f"(ln((1 - {model}.bad) / {model}.bad) + {evidence})"


def score(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all, by default) with the counts, ``votes``, ``base_failed``, ``p_good`` and ``kept``.

    Counts and votes are written once; the model's one row joins them as a scalar subquery.
    """
    carry = docs.columns if carry is None else carry
    df, at = signals(docs, carry)
    taken = [*carry, *at.values()]
    votes, failed, good, kept, model = (free_name(taken, x) for x in ("votes", "base_failed", "p_good", "kept", "model_"))
    vote = [f"case when {_rule_sql(bad, at)} then -1 when {_rule_sql(yes, at)} then 1 else 0 end" for _, yes, bad in RULES]
    df = materialise(df.withColumn(votes, F.expr(f"array({', '.join(vote)})")).withColumn(failed, F.expr(_rule_sql(BASE_FAILED, at))))
    patterns = df.groupBy(F.col(f"`{votes}`").alias("v")).agg(F.count("*").alias("n"))
    packed = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    fitted = materialise(packed.select(F.expr(em_expression()).alias("m")))
    df = df.withColumn(model, fitted.select("m").scalar())
    df = df.withColumn(good, F.expr(f"1 / (1 + exp(-{posterior_log_odds(f'`{votes}`', f'`{model}`')}))"))
    return df.withColumn(kept, ~F.col(failed) & (F.col(good) >= 0.5)).drop(model)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``."""
    scored = score(docs)
    kept = [c for c in scored.columns if c not in docs.columns][-1]
    return scored.where(F.col(f"`{kept}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["RULES", "SPACE", "em_expression", "keep_good", "score", "signals"]
