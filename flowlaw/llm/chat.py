"""Operator 8, chat formatting by schema fingerprints.

A record is a JSON text of any layout. The paths of its nested fields, in order and without their
values, are hashed; the fingerprint selects a mapping, which says in terms of paths where turns
come from. Mappings are declared by an example of the layout. The canonical turns are written by
one template, whose control strings are escaped inside texts, and can be read back from it.

All of it is DataFrame functions; no Python runs in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A turn is START role MIDDLE text END.
START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
#: What chat models take for control strings: a backslash goes behind the first character of each.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
ASSISTANT = "assistant"
TURNS = "array<struct<role: string, text: string>>"
#: What gather() gives of a record besides its JSON text.
PARTS = "struct<fields: map<string, string>, items: array<struct<role: string, content: string>>>"
#: A variant holds 128 MiB and its parser strings of 20,000,000 characters; records up to this many characters are far from both.
LONG = 16_000_000


@dataclass(frozen=True)
class Layout:
    """example: the least JSON text with all fields of the layout. turns: (role, path) in order, or
    one (role path, text path) inside the array at each."""

    name: str
    example: str
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    #: Whether roles go by other names there, which become the usual ones.
    foreign: bool = True


LAYOUTS = (
    Layout("prompt", '{"prompt": "", "completion": ""}', (("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("response", '{"prompt": "", "response": ""}', (("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", '{"question": "", "answer": ""}', (("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", '{"instruction": "", "output": ""}', (("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction with input", '{"instruction": "", "input": "", "output": ""}', (("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("system instruction", '{"system": "", "instruction": "", "output": ""}', (("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', (("$.role", "$.content"),), "$.messages", foreign=False),
    Layout("messages without name", '[{"role": "", "content": ""}]', (("$.role", "$.content"),), "$", foreign=False),
    Layout("conversations", '{"conversations": [{"from": "", "value": ""}]}', (("$.from", "$.value"),), "$.conversations"),
    Layout("nested", '{"data": {"dialog": [{"speaker": "", "text": ""}]}}', (("$.speaker", "$.text"),), "$.data.dialog"),
)
#: Other names of the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(record: Column) -> Column:
    """The hash of the nested field paths of a variant; kinds of scalars don't count, nor does their order."""
    paths = F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT|ARRAY)[A-Z_0-9(,)]+", ": VALUE")
    return F.xxhash64(paths)


def _mappings(spark: SparkSession, layouts: tuple[Layout, ...]) -> dict[str, int]:
    """By name: the fingerprint of each layout's example."""
    marks = spark.range(1).select(*[fingerprint(F.parse_json(F.lit(x.example))) for x in layouts]).first()
    return {x.name: mark for x, mark in zip(layouts, marks)}


def _canonical(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[F.lower(role)], role, F.lit(""))


def _turns(record: Column, layout: Layout) -> Column:
    text = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    if layout.each is None:
        return F.array(*[F.struct(F.lit(role).alias("role"), text(record, path).alias("text")) for role, path in layout.turns])
    role, path = layout.turns[0]
    named = _canonical if layout.foreign else lambda r: F.coalesce(r, F.lit(""))
    return F.transform(F.try_variant_get(record, layout.each, "array<variant>"), lambda v: F.struct(named(F.try_variant_get(v, role, "string")).alias("role"), text(v, path).alias("text")))


def _turns_of_parts(parts: Column, layout: Layout) -> Column:
    if layout.each is None:
        return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(parts["fields"][path], F.lit("")).alias("text")) for role, path in layout.turns])
    named = _canonical if layout.foreign else lambda r: F.coalesce(r, F.lit(""))
    return F.transform(parts["items"], lambda x: F.struct(named(x["role"]).alias("role"), x["content"].alias("text")))


def canonical(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout (null if none fits) and turns, an array of role and text.

    column holds JSON texts; what is null or no JSON has no layout. An empty list of messages tells
    nothing of its fields and fits none, either. Null texts are empty, null roles are "". Columns named layout or turns are replaced.
    Where columns _shape and _parts of gather()'s types come along, the fingerprint is that of _shape, a record's fields without its texts, at any length; the mapping that it selects is
    applied to the parsed record, or to _parts where the record has more than LONG characters, which may be too much for a variant. A record so long that comes without them and can't be parsed raises an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    own = kinds.get("_shape") == "variant" and kinds.get("_parts") == PARTS.replace(": ", ":").replace(", ", ",")
    if not own:
        records = records.withColumnsRenamed({c: f"{c}_" for c in ("_shape", "_parts") if c in kinds}).withColumns({"_shape": F.lit(None).cast("variant"), "_parts": F.lit(None).cast(PARTS)})
    marks = _mappings(records.sparkSession, layouts)
    rest = [c for c in records.columns if c not in ("layout", "turns", "_shape", "_parts")]
    lost = F.raise_error(F.lit(f"a record of more than {LONG} characters cannot be parsed")).cast("variant")
    tried = F.try_parse_json(column)
    read = F.when(F.char_length(column) <= LONG, tried).when(F.col("_parts").isNull() & F.col(column).isNotNull(), F.coalesce(tried, lost))
    parsed = records.select(F.struct(*rest).alias("_kept"), "_shape", "_parts", read.alias("_record")).withColumn("_mark", fingerprint(F.col("_shape" if own else "_record")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        here = F.col("_mark") == F.lit(marks[layout.name])
        name = F.when(here, F.lit(layout.name)).otherwise(name)
        turns = F.when(here, F.when(F.col("_parts").isNotNull(), _turns_of_parts(F.col("_parts"), layout)).otherwise(_turns(F.col("_record"), layout))).otherwise(turns)
    found = parsed.select("_kept.*", name.alias("layout"), turns.alias("turns"))
    return found if own else found.withColumnsRenamed({f"{c}_": c for c in ("_shape", "_parts") if c in kinds})


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """The formatted text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """start (characters from 0) and length of each assistant text, as escaped, in the formatted text."""
    sized = F.transform(turns, lambda t: F.struct((t["role"] == ASSISTANT).alias("own"), (F.lit(len(START + MIDDLE)) + F.char_length(escape(t["role"]))).alias("before"), F.char_length(escape(t["text"])).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + t["before"]
        span = F.array(F.struct(at.alias("start"), t["n"].alias("length")))
        return F.struct((at + t["n"] + len(END)).alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sized, start, step, lambda acc: acc["spans"])


def read_back(formatted: Column) -> Column:
    """The canonical turns of a formatted text. Only control strings of the template start with "<|"."""
    pieces = F.filter(F.split(formatted, F.lit(r"\Q" + END + r"\E"), F.lit(-1)), lambda p: p.startswith(START))
    halves = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), F.lit(r"\Q" + MIDDLE + r"\E"), F.lit(2)))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def format_records(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout, formatted and loss_spans; nulls where no layout fits."""
    found = canonical(records, column, layouts)
    rest = [c for c in found.columns if c not in ("turns", "formatted", "loss_spans")]  # what is named like a result is replaced
    return found.select(*rest, render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def gather(rows: DataFrame) -> DataFrame:
    """conv_id, record, a JSON text, _shape and _parts of conversations given as rows conv_id, turn, role, text.

    A user and an assistant turn make a prompt record, with a system turn before them an instruction
    record, anything else a list of messages. Rows of a conversation are put in order by turn, then
    role and text; null roles and texts count as empty; of rows without conv_id, as nothing joins them, each makes a conversation of its own.
    _shape is the record's fields with empty texts, from which its fingerprint is taken; _parts is what they hold, for records longer than LONG, null for others.
    """
    value = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = rows.withColumn("_lone", lone).groupBy("conv_id", "_lone").agg(F.sort_array(F.collect_list(value)).alias("t"))
    text = lambda i: F.get("t", F.lit(i))["content"]
    roles = F.array_join("t.role", ",")
    listed = lambda role, content, t: F.struct(F.transform(t, lambda x: F.struct(role(x).alias("role"), content(x).alias("content"))).alias("messages"))
    flat = {"user,assistant": ("prompt", "completion"), "system,user,assistant": ("system", "instruction", "output")}
    empty = lambda x: F.lit("")
    record = F.to_json(listed(lambda x: x["role"], lambda x: x["content"], F.col("t")))
    shape = F.to_variant_object(listed(empty, empty, F.slice("t", 1, 1)))
    fields = F.lit(None).cast("map<string, string>")
    for order, names in flat.items():
        own = roles == order
        record = F.when(own, F.to_json(F.struct(*[text(i).alias(n) for i, n in enumerate(names)]))).otherwise(record)
        shape = F.when(own, F.to_variant_object(F.struct(*[F.lit("").alias(n) for n in names]))).otherwise(shape)
        fields = F.when(own, F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"$.{n}"), text(i))])).otherwise(fields)
    items = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    made = turns.select("conv_id", record.alias("record"), shape.alias("_shape"), F.struct(fields.alias("fields"), items.alias("items")).alias("_all"))
    return made.select("conv_id", "record", "_shape", F.when(F.char_length("record") > LONG, F.col("_all")).cast(PARTS).alias("_parts"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id and what the formatted text and its loss spans say when they are read back."""
    turns = read_back(F.col("formatted"))
    spans = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(spans, "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all conversations of the data set, and of one that is made of control strings.

    Null texts and roles are empty. Rows are in order by turn, ties by role and text; repeated rows are turns of their own, and rows without a conv_id
    conversations of their own. Texts of any length are kept whole, other columns are not read. Without rows there is the added conversation only.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(format_records(gather(rows.unionByName(odd))))
