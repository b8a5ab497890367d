"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, gru_lm, html_extract, kneser_ney, langid, mixing, ngram_join, packing, quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    predicted = langid.predict(docs, langid.dictionaries(docs, ~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    out = chat.formatted(chat.canonical(chat.as_published(chat.from_rows(rows.union(extra))), messages="messages"))
    back = chat.read_back(F.col("formatted"))
    out = out.select("conv_id", "formatted", back.alias("back"), F.array_join(chat.masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(_table(spark, sf_dir, "documents"), langid.fold(F.col("doc_id"), 5) == 1)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


def _quality_sql() -> str:
    """The rules' counts, the same EM over vote patterns unrolled round by round, and the verdict."""
    rules = quality_rules.RULES
    q = quality_rules
    votes = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}" for j, (_, good, bad) in enumerate(rules))
    m = range(len(rules))
    start = ", ".join([f"{q.START_BAD}::double as bad", *(f"{q.START_HIT}::double as hit{j}, {q.START_SLIP}::double as slip{j}, {1 - q.START_HIT}::double as yes{j}, {1 - q.START_SLIP}::double as no{j}" for j in m)])
    odds = "ln((1 - bad) / bad) + " + " + ".join(f"(case v{j} when -1 then ln(slip{j} / hit{j}) when 1 then ln(no{j} / yes{j}) else 0 end)" for j in m)
    each = lambda what, j, vote, prior: f"(sum(case when v{j} = {vote} then {what} else 0 end) + {q.PSEUDO} * {prior}) / (sum(case when v{j} <> 0 then {what} else 0 end) + {q.PSEUDO})"
    step = ", ".join([f"(sum(b) + {q.PSEUDO} * {q.START_BAD}) / (sum(n) + {q.PSEUDO}) as bad", *(f"{each('b', j, -1, 0.1)} as hit{j}, {each('n - b', j, -1, 0.1)} as slip{j}, {each('b', j, 1, 0.9)} as yes{j}, {each('n - b', j, 1, 0.9)} as no{j}" for j in m)])
    rounds = ""
    for k in range(q.ROUNDS):
        rounds += f",\nmodel{k + 1} as (select {step} from (select p.*, n / (1 + exp({odds})) as b from patterns p, model{k}))"
    v = ", ".join(f"v{j}" for j in m)
    return rf"""
with t as (select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents),
w as (select doc_id, rid, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
grams as (select rid, unnest(generate_series(1, len(w) - 4)) as i, w from w where len(w) >= 5),
named as (select rid, i, array_to_string(w[i:i+4], ' ') as g from grams),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from named) where c > 1),
steps as (select rid, least(5, coalesce(lead(i) over (partition by rid order by i) - i, 5)) as s from twice),
repeats as (select rid, sum(s)::bigint as r from steps group by rid),
counts as (select doc_id, rid, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words,
    len(l)::bigint as n_lines, length(t)::bigint as n_chars, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::bigint as n_capitals,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::bigint as n_letters,
    len(regexp_extract_all(t, '!(?:[\x20\x09-\x0D]|$)'))::bigint as n_shouts,
    length(regexp_replace(t, '[^|]+', '', 'g'))::bigint as n_bars
  from w left join repeats using (rid)),
votes as (select *, ({q.BASE_FAILED}) as base_failed, {votes} from counts),
patterns as (select {v}, count(*)::double as n from votes group by {v}),
model0 as (select {start}){rounds}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and 1 / (1 + exp(-({odds}))) >= 0.5) as kept
from votes, model{q.ROUNDS}"""


MIXING_SQL = r"""
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, 'text ' || sha256(coalesce(text, '')))) as k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5, 2, 1])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as w, source_size * 2 as cap from s),
b as (select *, sum(source_size) over () * 1.5::double
      - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as rest_w from w),
o as (select *, cap * rest_w > rest * w as open, row_number() over (order by cap / w, source is null, source) as pos from b),
f as (select rest as f_rest, rest_w as f_w from o where open order by pos limit 1),
g as (select source, source_size, case when open then w * f_rest / f_w else cap::double end as target from o left join f on true),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from g),
r as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, d.k, e.target - e.epochs * e.source_size as over,
    d.source, sum(d.size) over (partition by d.source, d.k) as ks,
    sum(d.size) over (partition by d.source order by d.k range between unbounded preceding and current row) as upto
  from d join e on d.source is not distinct from e.source),
c as (select source, max(k) as cut from r where over > 0 and upto - ks / 2 <= over and upto - ks < over group by source)
select r.doc_id, r.size, r.source_size, r.target,
  (r.size * (r.epochs + case when r.k <= c.cut then 1 else 0 end))::bigint as taken
from r left join c on r.source is not distinct from c.source"""

DEDUP_SQL = r"""
with n as (select doc_id, row_number() over () as rid, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select doc_id, rid, t, first_value(doc_id) over (partition by t order by doc_id nulls last, rid) as keep_id,
  first_value(rid) over (partition by t order by doc_id nulls last, rid) as keep_rid, count(*) over (partition by t) as group_size from n)
select doc_id, keep_id, group_size, rid = keep_rid as kept, sha256(t) as text_sha256 from g"""


CHAT_SQL = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
alone as (select *, case when conv_id is null then row_number() over () end as one from rows),
sized as (select *, replace(replace(replace(role, '\', '\b'), '</turn', '\l/turn'), '### ', '\h## ') as r,
  replace(replace(replace(text, '\', '\b'), '</turn', '\l/turn'), '### ', '\h## ') as e from alone)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(replace(r, ':', '\c')) + 2 + length(e) + 8)::bigint as formatted_chars
from sized group by conv_id, one"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality_sql(),
        "op3_mixing": MIXING_SQL,
        "op5_chat_formatting": CHAT_SQL,
        "op10_exact_dedup": DEDUP_SQL,
    }
