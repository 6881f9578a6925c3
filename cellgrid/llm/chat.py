"""Chat formatting: layouts recognised by a fingerprint of their field paths, in DataFrame operations alone.

A layout is the set of its nested field paths (``messages[].role``); its
fingerprint is their hash. A registry maps fingerprints to declarative
mappings, expressions that turn the layout into canonical turns
``array<struct<role, text>>``. Turns are rendered with a template whose control
strings are escaped inside texts so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Turn template: opening, role, text, closing.
OPEN, ROLE_END, CLOSE = "[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", CLOSE, OPEN, ROLE_END)
#: A control string with any number of backslashes after its first character.
_PLAIN = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
#: Tokens of a variant's shape: a name, an opening, a closing, a scalar type.
_SHAPE_TOKEN = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z][A-Z_ ]*(?:\([0-9,]+\))?"
TURNS = "array<struct<role:string,text:string>>"

_message = lambda items, role, text: f"transform(${items}, m -> named_struct('role', cast(m.{role} as string), 'text', cast(m.{text} as string)))"
_said = lambda **turns: "filter(array(" + ", ".join(f"named_struct('role', '{r}', 'text', cast(${c} as string))" for r, c in turns.items()) + "), t -> t.text is not null)"
_turn = lambda role, text: f"array(named_struct('role', cast(${role} as string), 'text', cast(${text} as string)))"

#: Declarative mappings: field paths of a layout, and the expression of its turns over fields marked ``$``.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("role", "text"): _turn("role", "text"),
    ("content", "role"): _turn("role", "content"),
    ("messages[].content", "messages[].role"): _message("messages", "role", "content"),
    ("messages[].role", "messages[].text"): _message("messages", "role", "text"),
    ("conversations[].from", "conversations[].value"): "transform($conversations, m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else cast(m.from as string) end, 'text', cast(m.value as string)))",
    ("completion", "prompt"): _said(user="prompt", assistant="completion"),
    ("prompt", "response"): _said(user="prompt", assistant="response"),
    ("instruction", "output"): _said(user="instruction", assistant="output"),
    ("input", "instruction", "output"): "filter(array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', cast($instruction as string), nullif(cast($input as string), ''))), named_struct('role', 'assistant', 'text', cast($output as string))), t -> t.text is not null)",
    ("answer", "question"): _said(user="question", assistant="answer"),
    ("question", "response", "system_prompt"): _said(system="system_prompt", user="question", assistant="response"),
}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a layout's sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {fingerprint(k): v for k, v in LAYOUTS.items()}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a schema; ``[]`` marks an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def canonical(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with ``turns``, by the mapping that the fingerprint of ``fields`` selects; an unknown layout is refused."""
    paths = field_paths(df.select(*fields).schema)
    if (mark := fingerprint(paths)) not in MAPPINGS:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return df.withColumn("turns", F.expr(MAPPINGS[mark].replace("$", "")).cast(TURNS))


def record_paths(shape: Column) -> Column:
    """Sorted paths of the leaves of a variant's shape (``schema_of_variant``), as ``field_paths`` gives them.

    The shape is read token by token with a stack of the objects and arrays
    that are open. Names with other characters than letters, digits and ``_``
    keep their backquotes, so no name looks like a path.
    """
    tokens = F.regexp_extract_all(shape, F.lit(_SHAPE_TOKEN), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        above = F.coalesce(F.element_at(s["open"], -1), F.lit(""))
        state = lambda **new: F.struct(*[new.get(k, s[k]).alias(k) for k in ("open", "at", "found")])
        named = state(at=F.concat(above, F.regexp_replace(t, ": $", "")))
        inside = F.when(s["at"] == "", F.lit("")).otherwise(F.concat(s["at"], F.lit(".")))
        return (
            F.when(t.endswith(": "), named)
            .when(t == "OBJECT<", state(open=F.array_append(s["open"], inside)))
            .when(t == "ARRAY<", state(open=F.array_append(s["open"], F.lit("")), at=F.concat(s["at"], F.lit("[]"))))
            .when(t == ">", state(open=F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)))
            .otherwise(state(found=F.array_append(s["found"], s["at"])))
        )

    return F.array_sort(F.aggregate(tokens, start, step, lambda s: s["found"]))


def canonical_records(df: DataFrame, column: str = "record") -> DataFrame:
    """``df`` with ``layout`` (fingerprint) and ``turns`` of JSON records, each of a layout of its own.

    A record's own field paths are hashed, and the hash selects the mapping.
    Records of unknown layouts keep their fingerprint, so they can be counted,
    and get null turns; what is not a JSON object gets nulls in both. All stay
    as rows.
    """
    shape = F.schema_of_variant(F.try_parse_json(column))
    mark = F.when(shape.startswith("OBJECT<"), F.sha2(F.array_join(record_paths(shape), "\n"), 256))
    out = df.withColumn("layout", mark)
    turns, parsed = F.lit(None).cast(TURNS), {}
    for i, (paths, mapping) in enumerate(LAYOUTS.items()):
        nested = sorted(p.split("].")[1] for p in paths if "]." in p)
        top = paths[0].split("[")[0]
        schema = f"`{top}` array<struct<{', '.join(f'`{p}`: string' for p in nested)}>>" if nested else ", ".join(f"`{p}` string" for p in paths)
        known = F.col("layout") == fingerprint(paths)
        parsed[f"_parsed{i}"] = F.when(known, F.from_json(column, schema))
        turns = F.when(known, F.expr(mapping.replace("$", f"_parsed{i}.")).cast(TURNS)).otherwise(turns)
    return out.withColumns(parsed).withColumn("turns", turns).drop(*parsed)


def escaped(text: Column) -> Column:
    """No control string is left: a backslash joins those after its first character."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def rendered(turns: Column, learnt: str = "assistant") -> Column:
    """``struct<text, loss>`` of canonical turns: the formatted text, and for each turn the place of its loss within the turn.

    ``loss``: ``array<struct<turn, start, length>>`` of the turns of the role to
    learn, counted in code points of the turn's rendered text (without its close).
    """
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(ROLE_END))
    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), escaped(t["text"]), F.lit(CLOSE))), "")
    spans = F.transform(turns, lambda t, i: F.when(t["role"] == learnt, F.struct(i.alias("turn"), F.length(head(t)).alias("start"), F.length(escaped(t["text"])).alias("length"))))
    return F.struct(text.alias("text"), F.array_compact(spans).alias("loss"))


def read_back(formatted: Column) -> Column:
    """``struct<turns, loss>`` read from ``struct<text, loss>``: canonical turns, and the unescaped text under the mask."""
    chunks = F.filter(F.split(formatted["text"], CLOSE), lambda c: F.length(c) > 0)
    role_end = ROLE_END.replace("[", "\\[").replace("]", "\\]")

    def turn(c: Column) -> Column:
        parts = F.split(c, role_end, 2)
        return F.struct(unescaped(F.substring(parts[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescaped(parts[1]).alias("text"))

    loss = F.transform(formatted["loss"], lambda s: unescaped(F.substring(chunks[s["turn"]], s["start"] + 1, s["length"])))
    return F.struct(F.transform(chunks, turn).alias("turns"), F.array_join(loss, "").alias("loss"))


def format_turn_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted)`` from a table with a row for each turn: ``conv_id, turn, role, text``.

    Turns are in order of ``turn``, ties by role and text; null roles and texts
    are empty, repeated rows are turns. A row without ``conv_id`` is a
    conversation of its own, since nothing says that two of them belong
    together. Other columns are ignored; an empty table gives no rows.
    """
    one = canonical(rows.select("conv_id", "turn", "role", "text"), ["role", "text"])
    filled = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    numbered = one.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), filled.alias("turns")))).alias("all"))
    grouped = numbered.select("conv_id", F.flatten(F.transform("all", lambda x: x["turns"])).alias("turns"))
    alone = one.filter("conv_id is null").select("conv_id", filled.alias("turns"))
    return grouped.unionByName(alone).select("conv_id", rendered(F.col("turns")).alias("formatted"))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``conversations`` as a JSON record of one of the layouts in turn, made canonical by its fingerprint."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    record = F.lit('{"other": 1}')
    for i, paths in enumerate(LAYOUTS):
        value = lambda p: F.col("role").alias(p) if p in ("role", "from") else F.col("text").alias(p)
        nested = [p.split("].")[1] for p in paths if "]." in p]
        one = F.struct(F.array(F.struct(*map(value, nested)), F.struct(*map(value, nested))).alias(paths[0].split("[")[0])) if nested else F.struct(*map(value, paths))
        record = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(LAYOUTS) + 1)) == i, F.to_json(one)).otherwise(record)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return canonical_records(c.withColumn("record", record)).select("conv_id", "turn", "layout", F.size("turns").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    out = format_turn_rows(rows.unionByName(extra)).withColumn("back", read_back(F.col("formatted")))
    turns = F.array_join(F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back.turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("back.loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("back.loss"), 256).alias("loss_sha256"),
        F.length("formatted.text").cast("long").alias("formatted_chars"),
    )
