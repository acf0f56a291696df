"""Chat formatting: schema fingerprints select declarative mappings into canonical turns; a reversible chat template.

Everything is built-in column functions. A record is a row of one wide schema, as spark.read.json gives for a file of
mixed layouts: the fields that another layout uses are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


@dataclass(frozen=True)
class Layout:
    """One layout: the field paths a record must and may have, and how they become turns, in order.

    turns: (role, path) takes one field; (path[].role, path[].text) with `each` takes an array of structs.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[str]:
        subsets = (c for k in range(len(self.optional) + 1) for c in combinations(self.optional, k))
        return [_digest([*self.required, *c]) for c in subsets]


LAYOUTS = (
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), ("system", "input"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("messages", ("messages[].content", "messages[].role"), ("messages[].name",), each=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (), each=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
)


def _digest(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _some_has(array: Column, name: str) -> Column:
    return F.coalesce(F.exists(array, lambda e: e.getField(name).isNotNull()), F.lit(False))


def field_paths(schema: T.StructType, only: set[str], required: set[str]) -> list[tuple[str, Column]]:
    """The leaf paths below the columns `only`, each with whether a row has it.

    Below an array of structs, a path in `required` counts where the array is not null, as its elements may lack a text;
    any other field counts where an element has it.
    """
    found: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, there: Column, value: Column | None) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                inner = value.getField(f.name) if value is not None else None
                walk(f.dataType, f"{path}.{f.name}", there if inner is None else inner.isNotNull(), inner)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType) and value is not None:
                for f in kind.elementType.fields:
                    own = f"{path}[].{f.name}"
                    some = there if own in required else _some_has(value, f.name)
                    walk(f.dataType, own, some, None)
            else:
                walk(kind.elementType, f"{path}[]", there, None)
        else:
            found.append((path, there))

    for f in schema.fields:
        if f.name in only:
            walk(f.dataType, f.name, F.col(f"`{f.name}`").isNotNull(), F.col(f"`{f.name}`"))
    return found


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """SHA-256 of the row's sorted field paths, among the top-level fields that any layout names."""
    named = {p.split("[")[0].split(".")[0] for x in layouts for p in x.required + x.optional}
    required = {p for x in layouts for p in x.required}
    paths = [F.when(there, F.lit(p)) for p, there in sorted(field_paths(df.schema, named, required), key=lambda x: x[0])]
    present = F.array_compact(F.array(*paths)) if paths else F.array().cast("array<string>")
    return F.sha2(F.concat_ws("\n", present), 256)


def _turn(role: str, text: str, names: tuple[tuple[str, str], ...]) -> Callable[[Column], Column]:
    def one(e: Column) -> Column:
        r = e.getField(role)
        for old, new in names:
            r = F.when(e.getField(role) == old, F.lit(new)).otherwise(r)
        return F.struct(F.coalesce(r, F.lit("")).alias("role"), F.coalesce(e.getField(text), F.lit("")).alias("text"))

    return one


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds layout, and turns: array<struct<role, text>>. Unknown fingerprints: layout 'unknown', turns null.

    A null role or text inside an array becomes empty; an optional field that is absent gives no turn. Repeated rows
    each get theirs; no rows: no rows. Columns named layout or turns in df are replaced, all others are kept.
    """
    have, own = set(df.columns), "_fingerprint"
    while own in have:
        own += "_"
    fp = fingerprint(df, layouts)
    layout, turns = F.lit("unknown"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        if not {p.split("[")[0] for p in x.required} <= have:
            continue
        if x.each:
            array, role, text = x.each
            made = F.transform(F.col(array), _turn(role, text, x.roles))
        else:
            made = F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.struct(F.lit(r).alias("role"), F.col(p).alias("text"))) for r, p in x.turns if p in have]))
        mine = F.col(own).isin(x.fingerprints())
        layout, turns = F.when(mine, F.lit(x.name)).otherwise(layout), F.when(mine, made).otherwise(turns)
    return df.withColumn(own, fp).withColumns({"layout": layout, "turns": turns}).drop(own)


def escape(text: Column) -> Column:
    """Control strings inside a text get one more backslash after their `<|`; unescape() takes it away again."""
    return F.regexp_replace(text, r"<\|(\\*)(turn|text|end)\|>", r"<|\\$1$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|\\(\\*)(turn|text|end)\|>", r"<|$1$2|>")


def format_chat(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds formatted, and segments: array<struct<text, loss>> that concatenate to it; loss marks what is trained on.

    No turns: an empty string and an empty array. Null turns: both null. Columns of these names in df are replaced.
    """

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"]), t["role"] == loss_role), piece(F.lit(END + "\n"), F.lit(False)))

    df = df.withColumn("segments", F.flatten(F.transform("turns", parts)))
    return df.withColumn("formatted", F.when(F.col("segments").isNotNull(), F.concat_ws("", F.col("segments.text"))))


def read_chat(formatted: Column) -> Column:
    """The turns, read back from a formatted string."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    sides = lambda p: F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2)
    return F.transform(pieces, lambda p: F.struct(unescape(sides(p)[0]).alias("role"), unescape(sides(p)[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))
