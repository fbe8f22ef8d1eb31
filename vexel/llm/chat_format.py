"""Conversations as training text with a loss mask, in Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_of


@dataclass(frozen=True)
class Template:
    """How turns are marked. Roles that are not named are written out between `other_open` and `says`.

    Every control string starts with `<` or `[`; inside texts and roles a tilde goes behind that first character, and
    one more tilde where tildes stand there already, so escaping is undone exactly and no text can hold a control.
    """

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other_open: str = "<<ROLE>>"
    says: str = "<<SAYS>>"
    other_close: str = "<</ROLE>>"
    more: str = "<<MORE>>"
    trained: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [*(x for role in self.roles for x in role[1:]), self.other_open, self.says, self.other_close, self.more]

    @property
    def rests(self) -> str:
        """The controls without their first character, as alternatives of a pattern."""
        return "|".join("".join("\\" + c if c in "[]|().*+?" else c for c in x[1:]) for x in self.controls)


def escape(col: Column, template: Template) -> Column:
    return F.regexp_replace(col, rf"([<\[])(~*)({template.rests})", "$1~$2$3")


def unescape(col: Column, template: Template) -> Column:
    return F.regexp_replace(col, rf"([<\[])~(~*)({template.rests})", "$1$2$3")


def _running(sizes: Column) -> Column:
    """What all earlier elements come to, for each element. Every step copies the array, so it is for short ones."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
    step = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["before"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` worked out once, however often a lambda in `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def running(sizes: Column, step: int = 128) -> Column:
    """`_running` of an array of any length: inside pieces of `step` elements, and over the sums of pieces and of `step` pieces."""

    def level(deeper: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def sums(all_sizes: Column) -> Column:
            cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_sizes), F.lit(1)) - 1) / step).cast("int"))
            return bound(F.transform(cuts, lambda k: F.slice(all_sizes, k * step + 1, F.lit(step))), joined)

        def joined(pieces: Column) -> Column:
            before = deeper(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y)))
            return F.flatten(F.zip_with(pieces, before, lambda p, first: F.transform(_running(p), lambda x: x + first)))

        return lambda x: bound(x, sums)

    return level(level(_running))(sizes)


def chat_format(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points, from 0).

    Turn structs are collected and sorted by (turn, role, text), so ties and repeated rows have a fixed order and every
    row is kept. Neighbours of the same role share one block: its texts stand between the role's marks, parted by
    `more`. `loss_spans` covers each text of a trained role, in order, and nothing else. Spans are in the escaped text.

    A null text is empty, a null role is the empty role, a null turn sorts first, and a row of null conv_id belongs to
    no other: it is a conversation of its own, so any number of them is never gathered. An empty table gives an empty
    one. A conversation is one output row, so it must fit in memory, as in any form of this output; conversations are
    dealt by conv_id and nothing else is gathered. Running sums are made once for a conversation and meet their blocks
    and parts by `zip_with`, so the work follows the number of turns.
    """
    rows = pick(turns, (conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own")
    rows = rows.select("conv_id", own, "turn", text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"))
    talks = rows.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def mark(role: Column, at: int, other: Column) -> Column:
        out = other
        for name, *marks in template.roles:
            out = F.when(role == name, F.lit(marks[at])).otherwise(out)
        return out

    size = F.size("turns")
    # Where blocks start: the turns whose role differs from the one before.
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.get(F.col("turns"), i - 1)["role"]))
    talks = talks.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get(F.col("starts"), k + 1), size) - s))
    talks = talks.select("conv_id", F.transform(blocks, lambda b: F.struct(b[0]["role"].alias("role"), F.transform(b, lambda t: escape(t["text"], template)).alias("parts"))).alias("blocks"))

    def opened(role: Column) -> Column:
        return mark(role, 0, F.concat(F.lit(template.other_open), escape(role, template), F.lit(template.says)))

    whole = F.transform("blocks", lambda b: F.concat(opened(b["role"]), F.array_join(b["parts"], template.more), mark(b["role"], 1, F.lit(template.other_close))))

    def spans_of(b: Column, at: Column) -> Column:
        first = at + F.length(opened(b["role"]))
        places = running(F.transform(b["parts"], lambda p: F.length(p) + len(template.more)))
        return F.zip_with(b["parts"], places, lambda p, before: F.struct((first + before).cast("long").alias("start"), F.length(p).cast("long").alias("length")))

    talks = talks.withColumn("texts", whole)
    nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.zip_with("blocks", running(F.transform("texts", F.length)), lambda b, at: F.when(b["role"].isin(*template.trained), spans_of(b, at)).otherwise(nothing))
    return talks.select("conv_id", F.array_join("texts", "").alias("formatted"), F.flatten(spans).alias("loss_spans"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text, as an array of (role, text): what was formatted, read back."""

    def plain(x: str) -> str:
        return "".join("\\" + c if c in "[]|().*+?" else c for c in x)

    opens = "|".join(plain(x) for x in [*(r[1] for r in template.roles), template.other_open])
    closes = "|".join(plain(x) for x in [*(r[2] for r in template.roles), template.other_close])
    pattern = F.lit(rf"(?s)({opens})(.*?)({closes})")
    marks, bodies = F.regexp_extract_all(formatted, pattern, 1), F.regexp_extract_all(formatted, pattern, 2)

    def block(mark: Column, body: Column) -> Column:
        other = mark == template.other_open
        role = F.when(other, unescape(F.substring_index(body, template.says, 1), template))
        for name, opening, _ in template.roles:
            role = F.when(mark == opening, F.lit(name)).otherwise(role)
        text = F.when(other, F.substr(body, F.instr(body, F.lit(template.says)) + len(template.says))).otherwise(body)
        return F.transform(F.split(text, plain(template.more)), lambda p: F.struct(role.alias("role"), unescape(p, template).alias("text")))

    return F.flatten(F.zip_with(marks, bodies, block))


def read_loss(formatted: Column, spans: Column, template: Template = Template(), step: int = 4096) -> Column:
    """All text under the loss mask, unescaped span by span and joined.

    The text is first cut every `step` code points, as finding a place in a string means to walk there; a span is read
    from the cuts that it touches.
    """
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length(formatted) / step).cast("int")), lambda k: F.substr(formatted, k * step + 1, F.lit(step)))

    def read(cuts: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / step).cast("int"), F.floor((s["start"] + s["length"]) / step).cast("int")
        near = F.array_join(F.slice(cuts, first + 1, last - first + 1), "")
        return unescape(F.substr(near, (s["start"] % step + 1).cast("int"), s["length"].cast("int")), template)

    return bound(cuts, lambda held: F.array_join(F.transform(spans, lambda s: read(held, s)), ""))
