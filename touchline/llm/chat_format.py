"""Chat formatting: records of any declared layout become canonical turns, and
turns become text under a template with a loss mask.  DataFrame functions only.

A layout is a mapping from nested field paths (``messages[].role``) to turns.
Its fingerprint is the SHA-256 of its sorted paths.  A table's fingerprint
comes from its schema, a VARIANT record's from the paths that the record
holds; only declared paths count, so extra fields of any name do no harm.  An
unknown fingerprint gives a null layout and no turns.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles
``<``, any backslashes and ``|`` get one more backslash, and a role's own line
breaks and backslashes are written as two signs, so no control string stands
inside a text and reading back is exact.  Only texts of the role ``assistant``
lie under the loss mask.

A conversation is formatted in parts of ``PART`` turn numbers, so the turns of
a very long one are sorted and written by many tasks.  Nulls: text and role
count as empty, a null turn comes last, a null conv_id is a conversation of its
own.  Rows with equal turn are ordered by role and text; repeated rows are all
kept.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
PART = 64
TURN = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``turns``: (role or path of it, path of the text).  A path into
    ``container[]`` gives a turn per element, another path one turn.
    Turns whose path is in ``optional`` may be missing.  ``roles`` renames."""
    name: str
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    order: str = ""          # path of the turn number, where a row is a turn

    @property
    def paths(self) -> set[str]:
        own = {p for turn in self.turns for p in turn if not p.startswith("=")}
        return own | ({self.order} if self.order else set())


# Field names and roles of common public layouts.
SHARED_ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn_rows", (("role", "text"),), order="turn"),
    Layout("messages", (("messages[].role", "messages[].content"),)),
    Layout("exchange", (("conversations[].from", "conversations[].value"),), roles=SHARED_ROLES),
    Layout("prompt", (("=system", "system"), ("=user", "prompt"), ("=assistant", "completion")),
           optional=("system",)),
    Layout("instruction", (("=system", "system"), ("=user", "instruction"), ("=user", "input"),
                           ("=assistant", "output")), optional=("system", "input")),
    Layout("question", (("=user", "question"), ("=assistant", "answer"))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def fingerprints(layouts=LAYOUTS) -> dict[str, Layout]:
    """Fingerprint of every layout, with and without its optional paths."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for gone in combinations(layout.optional, n):
                out.setdefault(fingerprint(layout.paths - set(gone)), layout)
    return out


def declared(layouts=LAYOUTS) -> set[str]:
    return set().union(*(layout.paths for layout in layouts))


def schema_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, StructType):
        out = []
        for f in kind.fields:
            inner = schema_paths(f.dataType, f"{prefix}{f.name}")
            out += inner or [f"{prefix}{f.name}"]
        return out
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[].") if isinstance(kind.elementType, StructType) else []
    return []


def _renamed(role: Column, layout: Layout) -> Column:
    out = role
    for a, b in layout.roles.items():
        out = F.when(role == a, b).otherwise(out)
    return out


def _container(layout: Layout) -> str | None:
    heads = {p.split("[].")[0] for p in layout.paths if "[]." in p}
    return heads.pop() if heads else None


def _numbered(turns: list[Column]) -> Column:
    """Turns of single fields: those whose text is null are left out."""
    kept = F.filter(F.array(*turns), lambda t: t["text"].isNotNull())
    return F.transform(kept, lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["role"], t["text"]))


def _mapped(layout: Layout, listed, single) -> Column:
    """Turns of a record: ``listed(container)`` is its array of elements with
    accessor, ``single(path)`` the text at a path."""
    head = _container(layout)
    if head:
        (role, text), = layout.turns
        role, text = role.split("[].")[1], text.split("[].")[1]
        items, get = listed(head)
        return F.transform(items, lambda e, i: F.struct(
            i.cast("bigint").alias("turn"), _renamed(get(e, role), layout).alias("role"),
            get(e, text).alias("text")))
    return _numbered([F.struct(F.lit(role[1:]).alias("role"), single(text).alias("text"))
                      for role, text in layout.turns])


def table_turns(df: DataFrame, conv_id: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """Canonical turns (``conv_id, turn, role, text``) of a table whose schema's
    fingerprint selects the layout."""
    have = [p for p in schema_paths(df.schema) if p in declared(layouts)]
    layout = fingerprints(layouts).get(fingerprint(have))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(have)}")
    cid = F.col(f"`{conv_id}`").alias("conv_id")
    if layout.order:
        (role, text), = layout.turns
        return df.select(cid, F.col(layout.order).cast("bigint").alias("turn"),
                         _renamed(F.col(role), layout).alias("role"), F.col(text).alias("text"))
    have = set(have)
    turns = _mapped(layout, lambda head: (F.col(f"`{head}`"), lambda e, k: e[k]),
                    lambda path: F.col(f"`{path}`") if path in have else F.lit(None).cast("string"))
    return df.select(cid, F.inline(turns.cast(TURN)))


def record_fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    """Fingerprint of the declared paths that a VARIANT record holds."""
    known = declared(layouts)
    top = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
    found = [F.filter(top, lambda k: k.isin(*[p for p in known if "[]" not in p]))]
    for head in sorted({p.split("[].")[0] for p in known if "[]." in p}):
        items = F.coalesce(F.try_variant_get(record, f"$.{head}", "array<variant>"), F.array().cast("array<variant>"))
        keys = F.flatten(F.transform(items, lambda e: F.coalesce(
            F.map_keys(F.try_variant_get(e, "$", "map<string,variant>")), F.array().cast("array<string>"))))
        paths = F.transform(keys, lambda k: F.concat(F.lit(f"{head}[]."), k))
        found.append(F.filter(paths, lambda p: p.isin(*known)))
    held = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in found])))
    return F.sha2(F.array_join(held, "\n"), 256)


def record_turns(df: DataFrame, conv_id: str, record: str, layouts=LAYOUTS) -> DataFrame:
    """Canonical turns of VARIANT records of mixed layouts, a fingerprint each.
    Adds ``layout``; records of no layout give one row of null turn and layout
    so that they can be counted (``layout is null``)."""
    by_print = fingerprints(layouts)
    v = F.col(f"`{record}`")
    base = df.select(F.col(f"`{conv_id}`").alias("conv_id"), v.alias("_v"),
                     record_fingerprint(v, layouts).alias("_f"))
    v = F.col("_v")

    def listed(head):
        return (F.try_variant_get(v, f"$.{head}", "array<variant>"),
                lambda e, k: F.try_variant_get(e, f"$.{k}", "string"))

    turns, name = F.lit(None).cast(TURN), F.lit(None).cast("string")
    for layout in layouts:
        if layout.order:      # a record that is one turn of a conversation
            (role, text), = layout.turns
            made = F.array(F.struct(F.try_variant_get(v, f"$.{layout.order}", "bigint").alias("turn"),
                                    _renamed(F.try_variant_get(v, f"$.{role}", "string"), layout).alias("role"),
                                    F.try_variant_get(v, f"$.{text}", "string").alias("text")))
        else:
            made = _mapped(layout, listed, lambda path: F.try_variant_get(v, f"$.{path}", "string"))
        mine = F.col("_f").isin(*[f for f, x in by_print.items() if x is layout])
        turns = F.when(mine, made.cast(TURN)).otherwise(turns)
        name = F.when(mine, F.lit(layout.name)).otherwise(name)
    made = base.select("conv_id", name.alias("layout"), turns.alias("_t"))
    return made.select("conv_id", "layout", F.inline_outer("_t"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_parts(turns: DataFrame) -> DataFrame:
    """Formatted conversations in parts: ``conv_id, part, formatted`` and
    ``loss``, the spans (code points from 0 within the part) under the mask."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    body = escape(text)
    made = turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / F.lit(PART)).cast("bigint"),
                              F.lit((1 << 63) - 1)).alias("part"),
        F.struct(F.col("turn").isNull().alias("late"), "turn", role.alias("role"), text.alias("raw"),
                 F.concat(head, body, F.lit(END)).alias("text"),
                 F.length(head).alias("lead"), F.length(body).alias("size")).alias("t"))
    parts = made.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc, t):
        lo = acc["at"] + t["lead"]
        span = F.array(F.struct(lo.alias("start"), (lo + t["size"]).alias("end")))
        return F.struct((lo + t["size"] + F.lit(len(END))).alias("at"),
                        F.when(t["role"] == TRAINED, F.concat(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return parts.select("conv_id", "part", F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
                        F.aggregate("t", state, step, lambda acc: acc["spans"]).alias("loss"))


def conversations(parts: DataFrame) -> DataFrame:
    """Whole conversations of ``format_parts``: one text and its loss spans."""
    row = F.struct("part", "formatted", "loss")
    c = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("p"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, p):
        moved = F.transform(p["loss"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"),
                                                          (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(p["formatted"])).alias("at"),
                        F.concat(acc["spans"], moved).alias("spans"))

    return c.select("conv_id", F.array_join(F.transform("p", lambda p: p["formatted"]), "").alias("formatted"),
                    F.aggregate("p", state, step, lambda acc: acc["spans"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns (``role, text``) of a formatted text, in order."""
    pieces = F.filter(F.split(formatted, START.replace("|", r"\|")), lambda p: p != "")
    cut = F.transform(pieces, lambda p: F.struct(
        F.substring_index(p, "\n", 1).alias("role"), p.alias("piece")))
    return F.transform(cut, lambda c: F.struct(
        _unescape_role(c["role"]).alias("role"),
        unescape(F.substring(c["piece"], F.length(c["role"]) + 2,
                             F.length(c["piece"]) - F.length(c["role"]) - F.lit(1 + len(END)))).alias("text")))


def masked_texts(formatted: Column, loss: Column) -> Column:
    """Unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
