"""Chat formatting by schema fingerprinting.

A record is JSON of any layout.  Its nested field paths, without types, are hashed one by one; the first mapping
whose required paths are all among them turns the record into canonical turns (role, text), so fields that no
mapping needs do no harm.  ``fingerprint`` is the hash of all paths together.  Turns are formatted as

    ### role: text</turn>\\n

Inside texts the escape character and the control strings are written so that no control string occurs and
the original comes back exactly.  The loss mask is a list of code point spans of the formatted text: the texts
of assistant turns.  All of it is one projection over built-in functions.

Defined results: a record that is not JSON, or has all paths of no mapping, gets a null layout and null turns; null
texts and roles are empty; empty lists give no turns and an empty text; turns of ``from_rows`` with equal numbers are
ordered by role and text; each row without a conversation id is a conversation of its own; a conversation is one
value, so its rows meet in one task; an empty table gives an empty table; other columns are carried through.  Spark parses no string over LONGEST characters and no record
over VARIANT's size limit: conversations of ``from_rows`` beyond them keep their turns, which need no parsing;
other records that are not parsed and are longer than LONGEST get the layout ``too_long`` and null turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Layouts, what needs most paths first.  ``paths`` must be there (``[]`` is an element of a list, and
#: ``[]`` at the end a list without elements); ``list`` has the turns of a list of records, with the names of role and
#: text; ``fields`` has (role, field) in order, fields joined to the one before by "+".
MAPPINGS = [
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    {"name": "from_value", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    {"name": "system_prompt", "paths": ["system", "prompt", "response"], "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "instruction_input", "paths": ["instruction", "input", "output"], "fields": [("user", "instruction"), ("+", "input"), ("assistant", "output")]},
    {"name": "prompt_response", "paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt_completion", "paths": ["prompt", "completion"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "instruction", "paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    {"name": "question_answer", "paths": ["question", "answer"], "fields": [("user", "question"), ("assistant", "answer")]},
    {"name": "messages_empty", "paths": ["messages[]"], "fields": []},
]
#: Role names of the from_value layout.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
END = "</turn>\n"
#: Written in this order, read back in reverse.
ESCAPES = [("\\", "\\b"), ("</turn", "\\l/turn"), ("### ", "\\h## ")]
ROLE_ESCAPE = (":", "\\c")
#: Fixed value: characters of the longest string that Spark's JSON reader takes.
LONGEST = 20_000_000


def paths(record: Column) -> Column:
    """Sorted array of the nested field paths of a JSON string; null if it is not JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    # names, begins and ends of the schema's text; a walk over them knows where it is by a stack of prefixes
    token = F.regexp_extract_all(schema, F.lit(r"`(?:[^`]|``)*`: |[^\s<>,:`]+: |OBJECT<|ARRAY<VOID>|ARRAY<|>"), F.lit(0))
    kind = "struct<stack:array<string>,at:string,found:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("found")).cast(kind)

    def state(stack: Column, at: Column, found: Column) -> Column:
        return F.struct(stack.alias("stack"), at.alias("at"), found.alias("found"))

    def step(s: Column, t: Column) -> Column:
        name = F.concat(F.element_at(s["stack"], -1), F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", ""))
        inner = F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
        listed = F.concat(s["at"], F.lit("[]"))
        return (
            F.when(t.endswith(": "), state(s["stack"], name, F.array_append(s["found"], name)))
            .when(t == "OBJECT<", state(F.array_append(s["stack"], inner), s["at"], s["found"]))
            .when(t == "ARRAY<", state(F.array_append(s["stack"], listed), listed, s["found"]))
            .when(t == "ARRAY<VOID>", state(s["stack"], s["at"], F.array_append(s["found"], listed)))
            .otherwise(state(F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0))), s["at"], s["found"]))
        )

    return F.when(schema.isNotNull(), F.aggregate(token, start, step, lambda s: F.array_sort(F.array_distinct(s["found"]))))


def fingerprint(record: Column) -> Column:
    return F.sha2(F.array_join(paths(record), "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(v: Column, mapping: dict) -> Column:
    get = lambda x, path: F.try_variant_get(x, path, "string")
    if "list" in mapping:
        field, role, text = mapping["list"]
        names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
        items = F.try_variant_get(v, f"$.{field}", "array<variant>")

        def one(x: Column) -> Column:
            said = get(x, f"$.{role}")
            return _turn(F.coalesce(F.try_element_at(names, said), said) if mapping["name"] == "from_value" else said, get(x, f"$.{text}"))

        return F.transform(items, one)
    groups: list[tuple[str, list[str]]] = []
    for role, field in mapping["fields"]:
        if role == "+":
            groups[-1][1].append(field)
        else:
            groups.append((role, [field]))
    turns = [_turn(F.lit(role), F.array_join(F.filter(F.array(*[get(v, f"$.{f}") for f in fields]), lambda x: x != ""), "\n\n")) for role, fields in groups]
    return F.array(*turns) if turns else F.array().cast("array<struct<role:string,text:string>>")


def canonical(df: DataFrame, record: str = "record", messages: str | None = None) -> DataFrame:
    """``df`` with ``layout`` and ``turns`` (array of role, text) of its JSON column.

    ``messages`` names a column of the same turns (array of content, role) for records that are not parsed."""
    names = [free_name(df.columns, x) for x in ("layout", "turns", "fp_", "v_")]
    layout, turns, fp, v = names
    df = df.withColumn(fp, F.transform(paths(F.col(record)), lambda p: F.xxhash64(p))).withColumn(v, F.try_parse_json(F.col(record)))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for mapping in reversed(MAPPINGS):
        here = F.forall(F.array(*[F.xxhash64(F.lit(p)) for p in mapping["paths"]]), lambda p: F.array_contains(F.col(fp), p))
        name = F.when(here, F.lit(mapping["name"])).otherwise(name)
        value = F.when(here, _turns(F.col(v), mapping)).otherwise(value)
    if messages is not None:
        unread = F.col(v).isNull() & F.col(messages).isNotNull()
        name = F.when(unread, F.lit("messages")).otherwise(name)
        value = F.when(unread, F.transform(messages, lambda x: _turn(x["role"], x["content"]))).otherwise(value)
    name = F.when(F.col(v).isNull() & (F.length(record) > LONGEST) & name.isNull(), F.lit("too_long")).otherwise(name)
    return df.withColumn(layout, name).withColumn(turns, value).drop(fp, v)


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(ROLE_ESCAPE[0]), F.lit(ROLE_ESCAPE[1])), F.lit(": "))


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (array of start, length in code points from 0)."""
    out, spans, parts = (free_name(df.columns, x) for x in ("formatted", "loss_spans", "parts_"))
    piece = F.transform(F.col(turns), lambda t: F.struct(_header(t["role"]).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    df = df.withColumn(parts, piece)
    df = df.withColumn(out, F.array_join(F.transform(F.col(parts), lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    kind = "array<struct<start:bigint,length:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = (a["at"] + F.length(p["head"])).cast("bigint")
        size = F.length(p["body"]).cast("bigint")
        more = F.concat(a["spans"], F.array(F.struct(begin.alias("start"), size.alias("length"))))
        return F.struct((begin + size + len(END)).alias("at"), F.when(p["loss"], more).otherwise(a["spans"]).alias("spans"))

    return df.withColumn(spans, F.aggregate(F.col(parts), start, step, lambda a: a["spans"])).drop(parts)


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, END)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        at = F.instr(p, ": ")
        role = unescape(F.replace(F.substring(p, F.lit(5), at - 5), F.lit(ROLE_ESCAPE[1]), F.lit(ROLE_ESCAPE[0])))
        return F.struct(role.alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(pieces, one)


def masked(text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def from_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, messages, record): one ``messages`` record per conversation of a table with one row per turn,
    and its turns as an array.  Rows without a conv_id say nothing about what they belong to: each is alone."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    lists = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    lists = lists.unionByName(rows.where(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("m")))
    message = F.transform("m", lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role")))
    lists = lists.select("conv_id", message.alias("messages"))
    return lists.select("conv_id", "messages", F.to_json(F.struct("messages")).alias("record"))


def as_published(lists: DataFrame) -> DataFrame:
    """``lists`` of ``from_rows`` with records in the layouts that such conversations are published in: a lone prompt
    and its response, the same under a system prompt, dialogues of two, and messages for all others."""
    m = F.col("messages")
    roles = F.transform(m, lambda x: x["role"])
    said = lambda k: F.element_at(m, k)["content"]
    asks = lambda *names: roles == F.array(*[F.lit(x) for x in names])
    prompt = F.struct(said(1).alias("prompt"), said(2).alias("response"))
    system = F.struct(said(1).alias("system"), said(2).alias("prompt"), said(3).alias("response"))
    sides = F.transform(m, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["content"].alias("value")))
    two = (F.size(m) > 0) & F.forall(roles, lambda r: r.isin("user", "assistant"))
    record = F.when(asks("user", "assistant"), F.to_json(prompt)).when(asks("system", "user", "assistant"), F.to_json(system))
    return lists.withColumn("record", record.when(two, F.to_json(F.struct(sides.alias("conversations")))).otherwise(F.col("record")))
