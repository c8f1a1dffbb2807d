"""Chat formatting by schema fingerprint, with DataFrame functions only.

Records come in many layouts: one row per turn, message lists, instruction or prompt columns, and all
of these as JSON text. A layout's fingerprint is a hash of its sorted nested field paths; each known
fingerprint names a declarative mapping (where the roles and texts are) to canonical turns
(conversation, turn, role, text). A table's layout is read from its schema, a JSON record's from its
own keys, row by row, so mixed records can share a column.

The template writes a turn as <|turn|>role<|text|>text<|end|>. Control strings cannot arise from
roles or texts: each backslash, < and [ in them is written as a backslash and a letter, which can be
undone. The loss mask is the list of code-point spans of the assistants' (escaped) texts.

A conversation is one output row, so its turns meet in one task by definition; offsets come from a
window over its turns, one sort for the whole plan.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null role or text is
empty; rows with a null conversation id form one conversation; repeated rows are turns of their own. Of
JSON records, a null or blank one and one with an empty message list have no turns; one of unknown
layout, or that is no JSON object, is kept as one turn with an empty role and the record as its text
(on_unknown="drop" drops it, "raise" raises). A table of unknown layout raises. Columns that the mapping
does not name are ignored; roles of row layouts are taken as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Other names of roles; fixed values.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """fixed: (role, field) pairs in turn order, where fields joined by + make one text; or messages:
    the list's field with its role and text fields; or rows: (turn, role, text) columns."""

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None

    @property
    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.messages:
            field, role, text = self.messages
            return sorted([f"{field}.{role}", f"{field}.{text}"])
        return sorted(f for _, names in self.fixed for f in names.split("+"))


MAPPINGS = (
    Mapping("turn rows", rows=("turn", "role", "text")),
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("shared conversations", messages=("conversations", "from", "value")),
    Mapping("instruction with input", fixed=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt and response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system, prompt and response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", fixed=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted nested paths of the leaves; list levels add nothing to a path."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix)
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    return [prefix]


def fingerprint(paths: Column) -> Column:
    """Hash of a list of field paths."""
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _of(mapping: Mapping) -> Column:
    return fingerprint(F.array(*map(F.lit, mapping.paths)))


def _by_fingerprint(spark: SparkSession, paths: list[str], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping with the hash of the paths, or else the first with that of some of them."""
    some = [[p for p in paths if p in m.paths] for m in mappings]
    hashes = [fingerprint(F.array(*map(F.lit, p)).cast("array<string>")) for p in (paths, *some)]
    found = spark.sql("SELECT 1").select(F.array(*hashes).alias("seen"), F.array(*map(_of, mappings)).alias("own")).first()
    (known, *parts), own = found.seen, found.own
    return next((m for m, h in zip(mappings, own) if h == known), None) or next((m for m, h, part in zip(mappings, own, parts) if h == part), None)


def json_paths(record: Column, ignored: tuple[str, ...]) -> Column:
    """Nested field paths of a JSON object, one level below the top; those of a list are its elements',
    and a path that ends in * where these differ, which no mapping has."""

    def below(key: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))
        inner = F.coalesce(F.json_object_keys(value), of_elements(value))
        return F.coalesce(F.transform(inner, lambda k: F.concat(key, F.lit("."), k)), F.array(key))

    def of_elements(value: Column) -> Column:
        keys = F.transform(F.from_json(value, "array<string>"), lambda e: F.array_sort(F.json_object_keys(e)))
        every, alike = F.array_distinct(F.flatten(F.filter(keys, lambda k: k.isNotNull()))), F.size(F.array_distinct(keys)) == 1
        return F.when(F.exists(keys, lambda k: k.isNotNull()), F.when(alike, every).otherwise(F.array_append(every, F.lit("*"))))

    keys = F.filter(F.json_object_keys(record), lambda k: ~k.isin(*ignored))
    return F.flatten(F.transform(keys, below))


def _role(name: Column) -> Column:
    out = F.when(F.lower(name) == "\0", name)
    for other, role in ROLE_NAMES.items():
        out = out.when(F.lower(name) == other, F.lit(role))
    return out.otherwise(name)


_TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def _turn(turn, role, text) -> Column:
    cast = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(cast(turn).cast("long").alias("turn"), cast(role).cast("string").alias("role"), cast(text).cast("string").alias("text"))


def _fixed_turns(mapping: Mapping, field) -> Column:
    made = [_turn(i, role, F.concat_ws("\n", *[F.when(field(n) != "", field(n)) for n in names.split("+")])) for i, (role, names) in enumerate(mapping.fixed)]
    return F.array(*made)


def canonical_turns(df: DataFrame, id_col: str, json_col: str | None = None, ignored: tuple[str, ...] = (), mappings: tuple[Mapping, ...] = MAPPINGS, on_unknown: str = "keep") -> DataFrame:
    """conv_id, turn, role and text rows of records in any mapped layout; ignored fields (and the id)
    take no part in fingerprints. on_unknown: what becomes of JSON records without a mapping (keep,
    drop or raise)."""
    if on_unknown not in ("keep", "drop", "raise"):
        raise ValueError(f"on_unknown is {on_unknown!r}")
    skip = {id_col, *ignored}
    if json_col is None:
        paths = [p for p in field_paths(df.schema) if p.split(".")[0] not in skip]
        chosen = _by_fingerprint(df.sparkSession, paths, mappings)
        if chosen is None:
            raise ValueError(f"no mapping for fields {paths}")
        if chosen.rows:
            turn, role, text = (F.col(c) for c in chosen.rows)
            return df.select(F.col(id_col).alias("conv_id"), turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
        if chosen.messages:
            field, role, text = chosen.messages
            turns = F.transform(field, lambda m, i: _turn(i, _role(m[role]), m[text]))
        else:
            turns = _fixed_turns(chosen, lambda n: F.col(n).cast("string"))
    else:
        record = F.col(json_col)
        paths = json_paths(record, tuple(skip))
        known, none = fingerprint(paths), F.array().cast(_TURNS)
        turns = F.when(F.coalesce(record.rlike(r"^\s*$"), F.lit(True)), none)
        for m in mappings:
            if m.rows:
                continue
            if m.messages:
                field, role, text = m.messages
                parsed = F.from_json(F.get_json_object(record, f"$.{field}"), f"array<struct<`{role}`: string, `{text}`: string>>")
                made = _json_messages(parsed, role, text)
            else:
                made = _fixed_turns(m, lambda n: F.get_json_object(record, f"$.{n}"))
            made = made.cast(_TURNS)
            turns = turns.when(known == _of(m), made)
            if m.messages:  # an empty list shows no element paths
                empty = F.get_json_object(record, f"$.{m.messages[0]}") == "[]"
                turns = turns.when((known == fingerprint(F.array(F.lit(m.messages[0])))) & empty, none)
        if on_unknown == "raise":
            turns = turns.otherwise(F.raise_error(F.concat(F.lit("no mapping for fields "), F.coalesce(F.array_join(F.array_sort(paths), ", "), F.lit("of what is no JSON object")))).cast(_TURNS))
        elif on_unknown == "keep":
            turns = turns.otherwise(F.array(_turn(0, "", record)).cast(_TURNS))
    return df.select(F.col(id_col).alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def _json_messages(parsed: Column, role: str, text: str) -> Column:
    return F.transform(parsed, lambda m, i: _turn(i, _role(m[role]), m[text]))


def escaped(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_spans (start and end in code points of formatted) of canonical turns."""
    parts = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escaped(F.col("role")).alias("r"), F.coalesce("text", F.lit("")).alias("text"), escaped(F.col("text")).alias("t"))
    length = F.length("r") + F.length("t") + len(TURN + TEXT + END)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(length.cast("long")).over(before)).select("conv_id", "turn", "end", "role", F.concat(F.lit(TURN), "r", F.lit(TEXT), "t", F.lit(END)).alias("block"), F.length("t").alias("size"))
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("end", "role", "block", "size"))).alias("parts"))
    text_end = lambda p: p["end"] - len(END)
    spans = F.transform(F.filter("parts", lambda p: p["role"] == "assistant"), lambda p: F.struct((text_end(p) - p["size"]).alias("start"), text_end(p).alias("end")))
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["block"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted text holds."""
    blocks = F.split(formatted, F.lit("\\Q" + END + "\\E"), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        at = F.instr(block, TEXT)
        return F.struct(unescaped(F.substring(block, len(TURN) + 1, at - 1 - len(TURN))).alias("role"), unescaped(F.substring(block, at + len(TEXT), F.length(block))).alias("text"))

    return F.transform(blocks, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
