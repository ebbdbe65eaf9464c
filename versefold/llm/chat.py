"""Chat formatting: field-path fingerprints select declarative mappings to canonical turns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versefold.llm.common import table

#: Roles with a printed name; any other role is written percent-encoded after "=".
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
OPEN, CLOSE = "### ", "</turn>\n"
TURNS = "array<struct<turn:long,role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted nested paths of a type with their kinds: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [f"{at}:{'number' if isinstance(kind, T.NumericType) else kind.typeName()}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def steps(*pairs: tuple[str, str]) -> str:
    """SQL for the turns of one row: role and expression, in order; null expressions left out."""
    each = ", ".join(f"named_struct('turn', {i}L, 'role', '{role}', 'text', cast({sql} as string))" for i, (role, sql) in enumerate(pairs))
    return f"filter(array({each}), t -> t.text is not null)"


def listed(field: str, role: str, text: str, renamed: dict[str, str] | None = None) -> str:
    """SQL for the turns in an array of structs."""
    said = f"m.{role}"
    for old, new in (renamed or {}).items():
        said = f"if({said} <=> '{old}', '{new}', {said})"
    return f"transform({field}, (m, i) -> named_struct('turn', cast(i as long), 'role', {said}, 'text', cast(m.{text} as string)))"


#: Layouts by their field paths: the columns that must be there, and the SQL for turns; `rows`
#: layouts hold one turn a row and are grouped. Order counts: the first that fits is used.
LAYOUTS: dict[str, tuple[list[str], str, str]] = {
    "turn rows": (["conv_id:number", "role:string", "text:string", "turn:number"], "rows", ""),
    "messages": (["messages[].content:string", "messages[].role:string"], "nested", listed("messages", "role", "content")),
    "from/value": (["conversations[].from:string", "conversations[].value:string"], "nested", listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "instruction": (["input:string", "instruction:string", "output:string"], "nested", steps(("user", "if(coalesce(input, '') = '', instruction, concat_ws('\\n\\n', instruction, input))"), ("assistant", "output"))),
    "prompt/completion": (["completion:string", "prompt:string"], "nested", steps(("user", "prompt"), ("assistant", "completion"))),
    "prompt/response": (["prompt:string", "response:string"], "nested", steps(("user", "prompt"), ("assistant", "response"))),
    "system/prompt/response": (["prompt:string", "response:string", "system:string"], "nested", steps(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question/answer": (["answer:string", "question:string"], "nested", steps(("user", "question"), ("assistant", "answer"))),
}
MAPPINGS = {fingerprint(paths): (name, kind, sql) for name, (paths, kind, sql) in LAYOUTS.items()}


def mappings_for(schema: T.StructType) -> list[tuple[str, str, str]]:
    """The mapping whose fingerprint is that of the schema, or else those of the subsets of its
    paths that a mapping knows, the largest first (extra columns, also with clashing names, don't
    matter). A table of turn rows has that mapping alone."""
    paths = field_paths(schema)
    if (hit := MAPPINGS.get(fingerprint(paths))) is not None:
        return [hit]
    inside = sorted((p for p, _, _ in LAYOUTS.values() if set(p) <= set(paths)), key=len, reverse=True)
    if not inside:
        raise ValueError(f"no chat layout has the field paths {paths}")
    found = [MAPPINGS[fingerprint(p)] for p in inside]
    return found[:1] if found[0][1] == "rows" else [m for m in found if m[1] != "rows"]


def row_turns(mappings: list[tuple[str, str, str]]) -> Column:
    """Turns of a row of a table that fits several layouts: by the largest one of whose columns the
    row has all, else some."""
    tops = lambda name: sorted({p.split(":")[0].split("[")[0].split(".")[0] for p in LAYOUTS[name][0]})
    has = lambda name, mode: F.expr(mode.join(f"`{c}` is not null" for c in tops(name)))
    turns = [F.when(has(name, mode), F.expr(sql).cast(TURNS)) for mode in (" and ", " or ") for name, _, sql in mappings]
    return F.coalesce(*turns, F.array().cast(TURNS))


def canonical(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Any known layout, or several in one table, as (conv_id, turns). Turn rows are grouped by
    conversation and ordered by turn (nulls first; ties by role, then text; repeated rows are turns
    each); null roles and texts become empty, a null id is one conversation. Very long texts stay
    whole; a conversation is one value, so it must fit a task."""
    mappings = mappings_for(df.schema)
    if mappings[0][1] == "rows":
        one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return df.groupBy(F.col(id_column).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    turns = F.transform(row_turns(mappings), lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return df.select(F.col(id_column).cast("long").alias("conv_id"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """Reversible: every backslash is doubled, and a backslash is put between two # and after
    the < of a closing mark, so that neither mark can stand in a text."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=#)", r"#\\")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_mark(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, role), F.concat(F.lit("="), F.url_encode(role)))


def formatted(turns: Column) -> Column:
    """One string: for each turn `### Role: text</turn>` and a newline."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), role_mark(t["role"]), F.lit(": "), escaped(t["text"]), F.lit(CLOSE))), "")


def parsed(text: Column) -> Column:
    """Turns read back from a formatted string."""
    names = F.create_map(*(F.lit(x) for role, shown in ROLES.items() for x in (shown, role)))
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        F.coalesce(F.try_element_at(names, F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ": ", 1)), F.url_decode(F.substr(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ": ", 1), F.lit(2)))).alias("role"),
        unescaped(F.substr(p, F.locate(": ", p) + 2)).alias("text")))


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): turns are read back from formatted. Conversations without
    turns give an empty string; an empty table gives no rows."""
    out = canonical(df).select("conv_id", formatted(F.col("turns")).alias("formatted"))
    return out.withColumn("turns", parsed(F.col("formatted")))


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: those of assistant turns, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, and read back from the output."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", F.array_join(loss_texts(F.col("turns")), ""))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
