"""Chat formatting by schema fingerprints.

A record (JSON text) is reduced to its nested field paths, and their hash selects a declarative ``Mapping`` that says
where the turns are: a list of messages with named role and text fields, or single fields with fixed roles. All
mappings give the same canonical turns, an array of (role, text), which ``formatted`` writes in a template.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline for each turn. A backslash in a text is doubled and a
control string (of this and of other common templates) gets one after its first character, so no text can hold a mark, and
``unescaped`` gives the text back. The loss mask lists the places, in code points, of the assistants' texts.

Defined results: a null text or role is the empty one; a role's line ends are escaped as well. A record without a
mapping for its fingerprint has null turns, and ``unmapped`` counts such layouts. A record that is not JSON, or null, has fingerprint
null and null turns; with ``strict`` both are an error, but for a null record. Turns of one number go by role, then text; null numbers come first. A repeated row is a turn again. One conversation
is one training text, so its turns meet in one row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.binding import let

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates.
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths`` are all field paths of the layout. Either ``messages`` names a list whose elements have ``role`` and
    ``text`` fields, or ``turns`` lists (role, path) in order; a missing or empty optional field gives no turn.
    ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()


MAPPINGS = [
    Mapping("messages", ("messages[].content", "messages[].role"), messages="messages"),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", ("input", "instruction", "output"),
            turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_only", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt", ("completion", "prompt", "system"),
            turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("question", ("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
]


def _skeleton(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return F.when(schema.startswith("OBJECT<"), F.regexp_replace(
        schema, r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?", "$1*"
    ))


def skeleton(record: Column) -> Column:
    """Nested field paths of a JSON object as one text; null if the record is not an object.

    That is its schema, names in order, with every scalar type as ``*``: a value of another type, or null,
    does not change the layout.
    """
    return _skeleton(F.try_parse_json(record))


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths."""
    return F.md5(skeleton(record))


def layout(paths: tuple[str, ...]) -> str:
    """The skeleton that records with these field paths have."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def text(node: dict) -> str:
        def of(name: str, below: dict) -> str:
            inner = text(below) if below else "*"
            return f"{name.removesuffix('[]')}: {f'ARRAY<{inner}>' if name.endswith('[]') else inner}"

        return f"OBJECT<{', '.join(of(k, node[k]) for k in sorted(node))}>"

    return text(tree)


def _json_path(path: str) -> str:
    return "$." + path


def _turns(mapping: Mapping, value: Column) -> Column:
    if mapping.messages:
        items = F.try_variant_get(value, f"$.{mapping.messages}", "array<variant>")

        def turn(item: Column) -> Column:
            role = F.try_variant_get(item, f"$.{mapping.role}", "string")
            renamed = role
            for old, new in mapping.roles:
                renamed = F.when(role == old, F.lit(new)).otherwise(renamed)
            return F.struct(
                F.coalesce(renamed, F.lit("")).alias("role"),
                F.coalesce(F.try_variant_get(item, f"$.{mapping.text}", "string"), F.lit("")).alias("text"),
            )

        return F.transform(items, turn)
    out = []
    for role, path in mapping.turns:
        text = F.coalesce(F.try_variant_get(value, _json_path(path), "string"), F.lit(""))
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        out.append(F.when(text != "", turn) if path in mapping.optional else turn)
    return F.array_compact(F.array(*out))


def recognised(record: Column, mappings: list[Mapping] | None = None) -> Column:
    """Struct of ``fingerprint`` and ``turns`` (by its mapping; null where none is registered); a record is parsed once."""

    def by_mapping(value: Column, key: Column) -> Column:
        chosen = F.lit(None).cast(TURNS)
        for mapping in mappings or MAPPINGS:
            known = hashlib.md5(layout(mapping.paths).encode()).hexdigest()
            chosen = F.when(key == known, _turns(mapping, value)).otherwise(chosen)
        return chosen

    return let(F.try_parse_json(record), lambda value: let(F.md5(_skeleton(value)), lambda key: F.struct(
        key.alias("fingerprint"), by_mapping(value, key).alias("turns")
    )))


def canonical(record: Column, mappings: list[Mapping] | None = None) -> Column:
    """Canonical turns of a JSON record by the mapping of its fingerprint; null where none is registered."""
    return recognised(record, mappings)["turns"]


def unmapped(df: DataFrame, record: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """Layouts without a mapping, with how many records have them."""
    rows = df.filter(canonical(F.col(record), mappings).isNull())
    return rows.groupBy(skeleton(F.col(record)).alias("layout")).agg(F.count("*").alias("records"))


# The first character of a control string, where the rest follows: one pass that stops at two characters only.
_CONTROL = "|".join(
    re.escape(first) + "(?=" + "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) + ")" for first in sorted({c[0] for c in CONTROL})
)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """Struct of ``text`` and ``loss``, the (start, length) of each assistant text in code points."""
    safe = F.transform(turns, lambda t: F.struct(
        t["role"].alias("role"),
        F.concat(F.lit(START), F.regexp_replace(escaped(t["role"]), "\n", "\\\\\n"), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("text"),
    ))
    whole = F.array_join(F.transform(safe, lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        size = F.length(t["text"])
        one = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(state["loss"], one)).otherwise(state["loss"]).alias("loss"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return F.struct(whole.alias("text"), F.aggregate(safe, zero, step, lambda s: s["loss"]).alias("loss"))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, re.escape(END)), lambda p: p != "")
    head = r"(?s)^" + re.escape(START) + r"((?:[^\\\n]++|\\.)*+)\n(.*)$"
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")
    ))


def under_loss(text: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def records_of(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``record``: turn rows (``conv_id``, ``turn``, ``role``, ``text``) as JSON in the layout of messages."""
    turn = F.struct(
        F.col("turn").isNotNull().alias("has"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = F.sort_array(F.collect_list(turn))
    grouped = rows.groupBy("conv_id").agg(ordered.alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def layouts_of(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``record``: turn rows as JSON in the plainest layout that holds the conversation.

    A question with its answer is a prompt with its completion, with a system text before it a prompt with one; other talk of users and
    assistants is a list in the sharegpt layout, and everything else a list of messages.
    """
    turn = F.struct(
        F.col("turn").isNotNull().alias("has"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = lambda n: F.get("turns", F.lit(n))["text"]
    said = lambda *names: (F.size("turns") == len(names)) & F.forall(
        F.zip_with("turns", F.array(*map(F.lit, names)), lambda t, name: t["role"].eqNullSafe(name)), lambda same: same
    )
    pair = F.struct(text(0).alias("prompt"), text(1).alias("completion"))
    led = F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion"))
    talk = F.transform("turns", lambda t: F.struct(
        F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")
    ))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = (
        F.when(said("user", "assistant"), F.to_json(pair))
        .when(said("system", "user", "assistant") & (text(0) != ""), F.to_json(led))
        .when(F.forall("turns", lambda t: t["role"].isin("user", "assistant")), F.to_json(F.struct(talk.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def format_records(df: DataFrame, record: str = "record", mappings: list[Mapping] | None = None, strict: bool = False) -> DataFrame:
    """``df`` with ``fingerprint``, and ``text`` and ``loss`` of the formatted turns (null where no mapping fits, or an error if ``strict``)."""

    def made(found: Column) -> Column:
        turns = found["turns"]
        if strict:
            lost = F.col(record).isNotNull() & turns.isNull()
            turns = F.when(lost, F.raise_error(F.lit("a record that cannot be read, or of a layout without a mapping")).cast(TURNS)).otherwise(turns)
        return let(turns, lambda t: F.struct(found["fingerprint"].alias("fingerprint"), formatted(t).alias("made")))

    out = df.withColumn("found", let(recognised(F.col(record), mappings), made))
    out = out.withColumn("fingerprint", F.col("found.fingerprint")).withColumn("text", F.col("found.made.text"))
    return out.withColumn("loss", F.col("found.made.loss")).drop("found")
