"""Chat formatting: heterogeneous conversation layouts into one template with a loss mask.

Layouts are recognised by fingerprint. For each declarative mapping the paths of its nested fields that a record holds
(not null) are hashed together; a table keyed by that hash tells how well the mapping reads the record. Of the mappings
that find something, the one with all its required paths is taken, of several or none such the one with the most
required paths, then the most optional ones, then the first in MAPPINGS. Fields that it does not know play no part: a
record of `prompt` and `messages` is read by its messages.

Canonical turns are then written in a template whose control strings are escaped inside roles and texts, so the
formatted string can be read back exactly. All is DataFrame expressions.

Template of a turn:  <turn>ROLE<turn|>TEXT</turn>  and a newline. Escaping doubles each backslash and then puts one
after the < of each "<turn" and "</turn" inside a text, so no marker occurs in an escaped text; unescaping drops each
backslash and keeps what follows it.

A record that holds no required path of any mapping has null turns and a null formatted string; unknown() counts them.
Null texts are empty texts (a required part without a value is a turn with an empty text, an optional one gives no
turn), a null role is the empty role, null turns of a list are left out; an empty list gives an empty string.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

OPEN, BAR, CLOSE = "<turn>", "<turn|>", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
LOSS_ROLES = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """required and optional: paths, with [] for list elements. Either `turns` names a list and its role and text
    fields (a text of `parts[].text` is the parts' texts in a row), or `single` lists (role, path or paths to join by a
    blank line) in order; an absent optional part gives no turn. roles: renamed roles."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("role_text", ("turns[].role", "turns[].text"), turns=("turns", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Mapping("message_parts", ("messages[].role", "messages[].content[].text"), turns=("messages", "role", "content[].text")),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), ("system",), turns=("conversations", "from", "value"), single=(("system", ("system",)),), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), single=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", ("question", "answer"), ("context",), single=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def _paths(schema: T.DataType, at: str = "") -> dict[str, bool]:
    """Paths of all leaf fields; True for strings."""
    if isinstance(schema, T.StructType):
        return {p: s for f in schema for p, s in _paths(f.dataType, f"{at}.{f.name}" if at else f.name).items()}
    if isinstance(schema, T.ArrayType):
        return _paths(schema.elementType, f"{at}[]")
    return {at: isinstance(schema, T.StringType)}


def _present(path: str) -> Column:
    """True if the record holds the path: a value, or a list that is empty or has an element with the field."""
    if "[]." in path:
        head, field = path.split("[].", 1)
        whole = F.col(f"`{head}`")
        if "[]." in field:
            inner, leaf = field.split("[].", 1)
            own = F.exists(whole, lambda x: F.coalesce(F.exists(x.getField(inner), lambda y: y.getField(leaf).isNotNull()), F.lit(False)))
        else:
            own = F.exists(whole, lambda x: x.getField(field).isNotNull())
        return F.coalesce(own, F.lit(False)) | F.coalesce(F.size(whole) == 0, F.lit(False))
    return F.col(f"`{path}`").isNotNull()


def fingerprint_of(paths: Iterable[Column]) -> Column:
    return F.xxhash64(F.concat_ws("\n", *paths))


def layouts(mappings: tuple[Mapping, ...], known: set[str]) -> list[tuple[int, tuple[str, ...], tuple[bool, int, int, int]]]:
    """(number of the mapping, paths held, how well it reads them) of all sets of paths with a required one."""
    out = []
    for at, m in enumerate(mappings):
        own = [p for p in m.required + m.optional if p in known]
        for n in range(1, len(own) + 1):
            for held in combinations(own, n):
                need = sum(p in held for p in m.required)
                if need:
                    out.append((at, held, (need == len(m.required), need, n - need, -at)))
    return out


def _turns(m: Mapping, known: set[str]) -> Column:
    parts = []
    empty = F.array().cast(TURNS)
    for role, paths in m.single:
        own = [F.col(f"`{p}`") for p in paths if p in known]
        turn = F.array(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *own).alias("text"))).cast(TURNS)
        if any(p in m.required for p in paths):
            parts.append(turn)
        elif own:
            parts.append(F.when(F.coalesce(*own).isNotNull(), turn).otherwise(empty))
    if m.turns:
        head, role, text = m.turns
        given = F.filter(F.col(f"`{head}`"), lambda x: x.isNotNull())
        renamed = lambda x: x.getField(role)
        if m.roles:
            names = F.create_map(*[F.lit(v) for pair in m.roles for v in pair])
            renamed = lambda x: F.coalesce(F.try_element_at(names, x.getField(role)), x.getField(role))
        if f"{head}[].{role}" not in known:
            renamed = lambda x: F.lit(None).cast("string")
        said = lambda x: x.getField(text)
        if "[]." in text:
            inner, leaf = text.split("[].", 1)
            said = lambda x: F.array_join(F.transform(x.getField(inner), lambda y: y.getField(leaf)), "")
        if f"{head}[].{text}" not in known:
            said = lambda x: F.lit(None).cast("string")
        parts.append(F.coalesce(F.transform(given, lambda x: F.struct(F.coalesce(renamed(x), F.lit("")).alias("role"), F.coalesce(said(x), F.lit("")).alias("text"))).cast(TURNS), empty))
    return F.concat(*parts).cast(TURNS)


def canonical(df: DataFrame, *, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with layout (the hash of the mapping's paths that the record holds), mapping (its name) and turns_out.

    Paths are looked for by name in the schema of df, and must be strings; other columns play no part. Columns
    named layout, mapping or turns_out are replaced.
    """
    strings = {p for p, is_string in _paths(df.schema).items() if is_string}
    known = strings & {p for m in mappings for p in m.required + m.optional}
    table = layouts(mappings, known)
    none = df.withColumn("layout", F.lit(None).cast("bigint")).withColumn("mapping", F.lit(None).cast("string")).withColumn("turns_out", F.lit(None).cast(TURNS))
    if not table:
        return none
    marked = lambda at, held: fingerprint_of([F.lit(mappings[at].name), *held])
    rank = F.create_map(*[x for at, held, (whole, need, more, turn) in table for x in (marked(at, [F.lit(p) for p in held]), F.struct(F.lit(whole).alias("whole"), F.lit(need).alias("need"), F.lit(more).alias("more"), F.lit(turn).alias("turn")))])
    asked = sorted({at for at, _, _ in table})
    held = [marked(at, [F.when(_present(p), F.lit(p)) for p in mappings[at].required + mappings[at].optional if p in known]) for at in asked]
    choice, best = fresh(df, "choice"), fresh(df, "best")
    out = df.withColumn(choice, F.transform(F.array(*held), lambda h: F.struct(F.try_element_at(rank, h).alias("rank"), h.alias("layout"))))
    out = out.withColumn(best, F.array_max(F.filter(F.col(choice), lambda c: c["rank"].isNotNull())))
    at = -F.col(best)["rank"]["turn"]
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for i in asked:
        name = F.when(at == i, F.lit(mappings[i].name)).otherwise(name)
        turns = F.when(at == i, _turns(mappings[i], known)).otherwise(turns)
    return out.withColumn("layout", F.col(best)["layout"]).withColumn("mapping", name).withColumn("turns_out", turns).drop(choice, best)


def unknown(df: DataFrame) -> DataFrame:
    """(records, unknown) of canonical(): how many there are, and how many no mapping reads."""
    return df.agg(F.count("*").alias("records"), F.count_if(F.col("mapping").isNull()).alias("unknown"))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<turn"), F.lit("<\\turn")), F.lit("</turn"), F.lit("<\\/turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, *, turns_col: str = "turns_out", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """df with formatted (the string) and loss_spans: where texts of the loss roles stand in it, in order.

    A span has start and length in code points, and byte_start and byte_length in UTF-8, all from 0. Empty texts
    have spans of length 0.
    """
    escaped = F.transform(F.col(turns_col), lambda x: F.struct(x["role"].alias("role"), escape(x["role"]).alias("head"), escape(x["text"]).alias("body")))
    inner = fresh(df, "turns")
    pieces = F.transform(F.col(inner), lambda x: F.concat(F.lit(OPEN), x["head"], F.lit(BAR), x["body"], F.lit(CLOSE)))
    loss = lambda x: x["role"].isin(*loss_roles)
    fixed = len(OPEN) + len(BAR)
    number = lambda c: c.cast("bigint")
    empty = F.array().cast("array<struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>>")

    def add(state: Column, x: Column) -> Column:
        at, byte_at = state["at"] + F.length(x["head"]) + fixed, state["byte_at"] + F.octet_length(x["head"]) + fixed
        span = F.struct(number(at).alias("start"), number(F.length(x["body"])).alias("length"), number(byte_at).alias("byte_start"), number(F.octet_length(x["body"])).alias("byte_length"))
        return F.struct(
            number(at + F.length(x["body"]) + len(CLOSE)).alias("at"),
            number(byte_at + F.octet_length(x["body"]) + len(CLOSE)).alias("byte_at"),
            F.when(loss(x), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("byte_at"), empty.alias("spans"))
    staged = df.withColumn(inner, escaped)
    out = staged.withColumn("formatted", F.array_join(pieces, "")).withColumn("loss_spans", F.aggregate(F.col(inner), zero, add, lambda s: s["spans"]))
    return out.drop(inner)


def parse(formatted: Column) -> Column:
    """The turns of a formatted string."""
    blocks = F.split(formatted, r"</turn>\n")
    whole = F.slice(blocks, 1, F.size(blocks) - 1)
    parts = F.transform(whole, lambda b: F.split(F.substr(b, F.lit(len(OPEN) + 1)), r"<turn\|>", 2))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the spans cover, unescaped and put together. Bytes are sliced, so each span costs its own length."""
    raw = formatted.cast("binary")
    cut = F.transform(spans, lambda s: unescape(F.substr(raw, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")))
    return F.array_join(cut, "")


def gather(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record for each conversation of rows by turn: the id and turns, a list of role and text in order of turn
    (then role, then text; null turns first). Repeated rows are repeated turns; null ids are one conversation."""
    item = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy(id_col).agg(turns.alias("turns"))
