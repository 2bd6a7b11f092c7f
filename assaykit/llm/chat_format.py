"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, then a reversible template.

A record is a VARIANT (``parse_json`` of a raw line, or ``to_variant_object`` of a struct). Its shape, that is its
nested field paths without the scalar types, is hashed; the hash selects a mapping, and the mapping is a Column
expression that yields turns. A shape that no mapping names is hashed again by the paths that any mapping knows, so that
ids, names and other fields beside them don't hide a layout; there, texts may be lists of text parts too.
``fingerprint_census`` lists the shapes of a table, so that a mapping for a new layout can be declared. Only DataFrame
functions; one row in, one row out, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_SCALAR = r"\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"


@dataclass(frozen=True)
class Mapping:
    """``shapes``: those it applies to, as ``shape`` prints them; ``turns``: from the variant to array<struct<role, text>>.

    ``paths`` (``field`` or ``field[].field``) and ``loose`` are for records that have these of all known paths and, besides,
    any unknown ones; ``loose`` gives null where a text can't be read.
    """

    name: str
    shapes: tuple[str, ...]
    turns: Callable[[Column], Column]
    paths: tuple[str, ...] = ()
    loose: Callable[[Column], Column] | None = None


def shape(record: Column) -> Column:
    """The nested field paths of a variant, sorted, scalar types written *."""
    return F.regexp_replace(F.schema_of_variant(record), _SCALAR, "*")


def fingerprint(record: Column) -> Column:
    """64-bit hash of the nested field paths; null for a null record."""
    return F.when(record.isNotNull(), F.xxhash64(shape(record)))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_text(role).alias("role"), _text(text).alias("text"))


def _listed(field: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Turns from a list of messages; ``names`` renames roles."""

    def turns(v: Column) -> Column:
        items = F.variant_get(v, f"$.{field}", f"array<struct<`{role}` string, `{text}` string>>")
        renamed = lambda c: c if not names else F.coalesce(*[F.when(c == k, F.lit(x)) for k, x in names.items()], c)
        return F.transform(F.coalesce(items, F.array().cast(f"array<struct<`{role}` string, `{text}` string>>")), lambda m: _turn(renamed(m[role]), m[text]))

    return turns


def _pair(asked: tuple[str, ...], answer: str, system: str | None = None) -> Callable[[Column], Column]:
    """A user and an assistant turn from flat fields; several asking fields are joined by an empty line, empty ones left out."""

    def turns(v: Column) -> Column:
        get = lambda f: F.variant_get(v, f"$.{f}", "string")
        said = F.array_join(F.filter(F.array(*[get(f) for f in asked]), lambda x: x != ""), "\n\n")
        pair = F.array(_turn(F.lit("user"), said), _turn(F.lit("assistant"), get(answer)))
        if not system:
            return pair
        return F.concat(F.filter(F.array(_turn(F.lit("system"), get(system))), lambda t: t["text"] != ""), pair)

    return turns


def _readable(c: Column) -> Column:
    """Text of a variant: a scalar's, or that of a list of strings and objects with a ``text``, joined by line ends. Missing
    or null: ''; what has other contents: null."""
    kind = F.schema_of_variant(c)
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.try_variant_get(p, "$.text", "string"))
    parts = F.transform(F.try_variant_get(c, "$", "array<variant>"), part)
    joined = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "\n"))
    return F.when(c.isNull() | (kind == "VOID"), "").when(kind.startswith("ARRAY<"), joined).when(~kind.startswith("OBJECT<"), F.try_variant_get(c, "$", "string"))


def _all_read(turns: Column) -> Column:
    return F.when(~F.exists(turns, lambda t: t["text"].isNull()), F.transform(turns, lambda t: _turn(t["role"], t["text"])))


def _items(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "array<variant>")


def _chat(name: str, field: str, role: str, text: str, names: dict[str, str] | None = None) -> Mapping:
    """The mapping of a list of messages."""
    inner = ", ".join(f"{n}: *" for n in sorted((role, text)))
    shapes = f"OBJECT<{field}: ARRAY<OBJECT<{inner}>>>", f"OBJECT<{field}: ARRAY<*>>"

    def loose(v: Column) -> Column:
        said = lambda m: F.try_variant_get(m, f"$.{role}", "string")
        renamed = lambda c: c if not names else F.coalesce(*[F.when(c == k, F.lit(x)) for k, x in names.items()], c)
        return _all_read(F.transform(_items(v, field), lambda m: F.struct(renamed(said(m)).alias("role"), _readable(F.try_variant_get(m, f"$.{text}", "variant")).alias("text"))))

    return Mapping(name, shapes, _listed(field, role, text, names), (f"{field}[].{role}", f"{field}[].{text}"), loose)


def _flat(name: str, asked: tuple[str, ...], answer: str, system: str | None = None) -> Mapping:
    """The mapping of flat asking and answering fields."""
    fields = tuple(sorted((*asked, answer, *([system] if system else []))))

    def loose(v: Column) -> Column:
        get = lambda f: _readable(F.try_variant_get(v, f"$.{f}", "variant"))
        parts = F.array(*[get(f) for f in asked])
        said = F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(F.filter(parts, lambda x: x != ""), "\n\n"))
        turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
        pair = _all_read(F.array(turn("user", said), turn("assistant", get(answer))))
        if not system:
            return pair
        return F.concat(F.filter(_all_read(F.array(turn("system", get(system)))), lambda t: t["text"] != ""), pair)

    return Mapping(name, ("OBJECT<" + ", ".join(f"{f}: *" for f in fields) + ">",), _pair(asked, answer, system), fields, loose)


#: Public layouts of instruction and chat data.
MAPPINGS = (
    _chat("turns", "turns", "role", "text"),
    _chat("messages", "messages", "role", "content"),
    _chat("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    _flat("prompt_completion", ("prompt",), "completion"),
    _flat("prompt_response", ("prompt",), "response"),
    _flat("question_answer", ("question",), "answer"),
    _flat("instruction", ("instruction",), "output"),
    _flat("instruction_input", ("instruction", "input"), "output"),
    _flat("instruction_system", ("instruction", "input"), "output", "system"),
)


def known_paths(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Of all paths that the mappings read, those that the record has, sorted and joined by commas."""

    def present(path: str) -> Column:
        field, inner, of = path.partition("[].")
        if not inner:
            return F.try_variant_get(record, f"$.{field}", "variant").isNotNull()
        return F.exists(_items(record, field), lambda m: F.try_variant_get(m, f"$.{of}", "variant").isNotNull())

    every = sorted({p for m in mappings for p in m.paths})
    return F.array_join(F.array(*[F.when(present(p), F.lit(p)) for p in every]), ",")  # nulls are left out


def to_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint (long), mapping (name; null if no mapping has that shape) and turns (array<struct<role, text>>).

    Null roles and texts become ''. A mapping applies to the shapes it names and to records that have just its paths among
    all known ones. A null record, one of an unknown shape and one with a text that is neither a scalar nor a list of
    text parts get null mapping and turns, never a guess; their fingerprints show in ``fingerprint_census``. Input columns of
    the three added names are replaced.
    """
    v = F.col(record)
    # the mappings' sides hash literals only, so the optimizer folds them to one constant each
    is_of = lambda m: F.col("fingerprint").isin([F.xxhash64(F.lit(s)) for s in m.shapes])
    has = lambda m: F.col("__known") == F.xxhash64(F.lit(",".join(sorted(m.paths))))
    nothing = F.lit(None).cast("array<struct<role:string,text:string>>")
    name, loose_name, turns, loose = F.lit(None).cast("string"), F.lit(None).cast("string"), nothing, nothing
    for m in reversed(mappings):
        name, turns = F.when(is_of(m), F.lit(m.name)).otherwise(name), F.when(is_of(m), m.turns(v)).otherwise(turns)
        if m.loose:
            loose_name, loose = F.when(has(m), F.lit(m.name)).otherwise(loose_name), F.when(has(m), m.loose(v)).otherwise(loose)
    marked = records.withColumn("fingerprint", fingerprint(v)).withColumn("__exact", name)
    marked = marked.withColumn("__known", F.when(F.col("__exact").isNull() & v.isNotNull(), F.xxhash64(known_paths(v, mappings))))
    found = marked.withColumn("turns", F.when(F.col("__exact").isNotNull(), turns).otherwise(loose))
    return found.withColumn("mapping", F.when(F.col("turns").isNotNull(), F.coalesce("__exact", loose_name))).drop("__exact", "__known")


def fingerprint_census(records: DataFrame, record: str = "record") -> DataFrame:
    """One row per shape: fingerprint, shape, n."""
    return records.select(fingerprint(F.col(record)).alias("fingerprint"), shape(F.col(record)).alias("shape")).groupBy("fingerprint", "shape").agg(F.count("*").alias("n"))


def escape(text: Column) -> Column:
    r"""``<|`` cannot occur in the result: each ``<``, any backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame, turns: str = "turns", train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted (string) and loss_spans (array<struct<start, length>>, code points from 0).

    A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``, with control strings inside text and role escaped, so
    that ``read_turns`` gives back the very turns. Loss spans cover the escaped texts of the ``train_on`` roles. Null
    turns are formatted as none.
    """
    t = F.coalesce(F.col(turns), F.array().cast("array<struct<role:string,text:string>>"))
    parts = F.transform(
        t,
        lambda x: F.struct(
            F.concat(F.lit(START), _escape_role(_text(x["role"])), F.lit("\n")).alias("head"),
            escape(_text(x["text"])).alias("body"),
            _text(x["role"]).isin(*train_on).alias("train"),
        ),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(p["train"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return (
        df.withColumn("__parts", parts)
        .withColumn("formatted", F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), ""))
        .withColumn("loss_spans", F.aggregate("__parts", begin, step, lambda acc: acc["spans"]))
        .drop("__parts")
    )


def read_turns(formatted: Column) -> Column:
    """The turns that ``format_turns`` wrote, from the formatted string alone."""

    def turn(part: Column) -> Column:
        head = F.instr(part, "\n")
        return F.struct(
            _unescape_role(F.substring(part, F.lit(1), head - 1)).alias("role"),
            unescape(F.substring(part, head + 1, F.char_length(part) - head - len(END) - 1)).alias("text"),
        )

    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def gather_turns(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Records of the ``turns`` layout (conv_id, record variant) from one row per turn, ordered by turn, ties by role and text.

    A conversation is one record, so its rows meet in one row; null roles and texts become ''; a null conv_id is a
    conversation of its own. Other columns are left out.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text")))), lambda x: F.struct(x["role"], x["text"]))
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("t")).select("conv_id", F.to_variant_object(F.struct(F.col("t").alias("turns"))).alias("record"))
