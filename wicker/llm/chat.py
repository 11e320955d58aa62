"""Chat formatting by schema fingerprints.

The nested field paths of each record itself are hashed; the hash selects a declarative mapping, which
names where the turns, their roles and their texts are. All mappings end in the same canonical turns;
a record whose hash selects none is one turn of the role ``unknown`` whose text is the record. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TURNS = "array<struct<role:string,text:string>>"
#: What marks turns in the formatted text, and what stands for it inside texts. The escape sign comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"))
#: Inside roles the sign that ends them too.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
UNKNOWN = "unknown"
#: Strings of any length are read; what is no JSON is told apart.
_JSON = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "_broken"}
HEAD, HEAD_END, TAIL = "### ", ": ", " </turn>\n"


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths that a record of this layout has. ``turns``: either a list with its role and text fields, or (role, field) pairs; =name is the role in a field."""

    name: str
    paths: tuple[str, ...]
    list_name: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    names: tuple[tuple[str, str], ...] = ()  # usual names of this layout's roles

    def turns(self, record: Column) -> Column:
        """The turns of a record of this layout; null where it is no JSON after all."""
        if self.list_name:
            fields = [f"`{self.list_name}` array<struct<`{self.role}`:string,`{self.text}`:string>>"]
        else:
            fields = [f"`{name}` string" for name in sorted({*(f for _, f in self.fields), *(r[1:] for r, _ in self.fields if r.startswith("="))})]
        read = F.from_json(record, ", ".join([*fields, "_broken string"]), _JSON)

        def found(x: Column) -> Column:
            if self.list_name:
                usual = lambda role: F.coalesce(F.create_map(*[F.lit(n) for pair in self.names for n in pair])[role], role) if self.names else role
                turns = F.transform(x[self.list_name], lambda t: F.struct(usual(t[self.role]).alias("role"), t[self.text].alias("text")))
            else:
                each = [F.struct((x[role[1:]] if role.startswith("=") else F.lit(role)).alias("role"), x[name].alias("text")) for role, name in self.fields]
                turns = F.array(*each) if len(each) == 1 else F.filter(F.array(*each), lambda t: t["text"].isNotNull())
            return F.when(x["_broken"].isNull(), turns)

        return F.transform(F.array(read), found)[0]


LAYOUTS = (
    Layout("row", ("role", "text"), fields=(("=role", "text"),)),
    Layout("messages", ("messages", "messages.content", "messages.role"), "messages", "role", "content"),
    Layout("conversations", ("conversations", "conversations.from", "conversations.value"), "conversations", "from", "value", names=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
    Layout("prompt", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system prompt", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
)


def blanked(record: Column) -> Column:
    """A JSON record with null for every string that is no name, so that what is left to parse doesn't grow with the texts.

    Escaped quotes and escape signs go first (from names too, where they tell nothing apart), so that a string ends at the next quote.
    """
    bare = F.replace(F.replace(record, F.lit("\\\\")), F.lit('\\"'))
    names_alone = F.regexp_replace(bare, r'("[^"]*+"\s*+:)|"[^"]*+"', "$1")
    return F.regexp_replace(names_alone, r"(?<=[:\[,])\s*+(?=[,}\]]|$)", "null")


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON record (lists add no step), from the variant schema of its names; values and types don't matter."""
    record = blanked(record)
    # OBJECT<a: BIGINT, b: ARRAY<OBJECT<c: STRING>>>: one token per name, opening or closing bracket
    schema = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)+`|[^\s<>,:`]+)(?=: )|<|>"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("last"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        name = F.regexp_replace(t, "^`|`$", "")
        path = F.array_join(F.filter(F.concat(s["open"], F.array(name)), lambda x: x != ""), ".")
        return (
            F.when(t == "<", F.struct(F.concat(s["open"], F.array(s["last"])).alias("open"), F.lit("").alias("last"), s["paths"].alias("paths")))
            .when(t == ">", F.struct(F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1).alias("open"), F.lit("").alias("last"), s["paths"].alias("paths")))
            .otherwise(F.struct(s["open"].alias("open"), name.alias("last"), F.concat(s["paths"], F.array(path)).alias("paths")))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"])))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """A JSON record -> ``array<struct<role, text>>``, by the mapping of its fingerprint.

    Null where the record is null, no JSON object, or of an unknown layout. Missing roles and texts are empty; roles that
    a layout names otherwise (human, gpt) get their usual names.
    """
    return turns_by(fingerprint(field_paths(record)), record, layouts)


def turns_by(its: Column, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        known = fingerprint(F.array(*[F.lit(p) for p in sorted(layout.paths)]))
        turns = F.when(its == known, layout.turns(record)).otherwise(turns)
    return F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))


def escape(text: Column, marks: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, marked in marks:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column, marks: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Undo ``escape``: between escaped escape signs, each mark stands for its control string."""

    def part(x: Column) -> Column:
        for plain, marked in marks[1:]:
            x = F.replace(x, F.lit(marked), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def segments(turns: Column) -> Column:
    """Turns as pieces of formatted text with the loss mask: ``array<struct<text, loss>>``; loss falls on assistants' texts."""

    def turn(x: Column) -> Column:
        role = escape(x["role"], ROLE_ESCAPES)
        return F.array(
            F.struct(F.concat(F.lit(HEAD), role, F.lit(HEAD_END)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("loss")),
            F.struct(F.lit(TAIL).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, turn))


def formatted(segments_: Column) -> Column:
    return F.array_join(F.transform(segments_, lambda s: s["text"]), "")


def parsed(text: Column) -> Column:
    """The turns back from formatted text."""
    pieces = F.filter(F.split(text, TAIL), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, HEAD_END, 1)
        body = F.substr(x, F.length(role) + 1 + len(HEAD_END))
        name = F.substr(role, F.lit(len(HEAD) + 1))
        return F.struct(unescape(name, ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def format_records(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records(conv_id, turn, record)`` -> ``conv_id, formatted, segments``, one row for each conversation.

    ``record`` is JSON of any of the ``layouts``, mixed as they come; the fingerprint of each selects its mapping to turns. A record
    of another layout, or none, is one turn of the role UNKNOWN whose text is the record (null: empty). Records go by ``turn`` (null
    first), ties by their turns' roles and texts; repeated rows are repeated turns. A null text is empty, a null role is an empty role, rows
    with a null conv_id are one conversation. Other columns are ignored. A conversation is one row of the result, so its
    turns meet in one task.
    """
    odd = F.array(F.struct(F.lit(UNKNOWN).alias("role"), F.coalesce("record", F.lit("")).alias("text")))
    turns = records.select("conv_id", "turn", "record", fingerprint(field_paths(F.col("record"))).alias("its"))
    one = turns.select("conv_id", F.struct("turn", F.coalesce(turns_by(F.col("its"), F.col("record"), layouts), odd).alias("turns")).alias("x"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    parts = whole.select("conv_id", segments(F.flatten(F.transform("xs", lambda x: x["turns"]))).alias("segments"))
    return parts.select("conv_id", formatted(F.col("segments")).alias("formatted"), "segments")


def format_rows(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> as ``format_records``, each row being a record of its role and text."""
    record = F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("text")), {"ignoreNullFields": "false"})
    return format_records(rows.select("conv_id", "turn", record.alias("record")))
