"""What the corpus operators share: column access, training splits, row numbers, bounded memories, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored  # noqa: F401

#: The white space of the word and equality rules: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Name of the row number that stages add to tell rows apart.
ROW = "_row_number"


def pick(df: DataFrame, *cols: tuple[str, str]) -> DataFrame:
    """Only the named columns under the operator's own names, so other columns can never clash."""
    return df.select(*(df[have].alias(want) for have, want in cols))


def text_of(col: Column) -> Column:
    """A text, where null counts as empty."""
    return F.coalesce(col, F.lit(""))


def bucket_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1))


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """`docs` with a number for each row, fixed by writing the table once: ids may repeat or be null, rows may be equal."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), label)


def without_rows(rows: DataFrame, gone: DataFrame, label: str, max_broadcast_rows: int) -> DataFrame:
    """`rows` (numbered) without those whose number is in `gone`, and without the number.

    The numbers are 8 bytes each, so the count that allows a broadcast bounds its bytes; a longer list meets the rows
    in a shuffle. `scratch` of the result has the tables that it reads.
    """
    gone = stored(gone, label)
    few = gone.count() <= max_broadcast_rows
    out = rows.join(F.broadcast(gone) if few else gone, ROW, "left_anti").drop(ROW)
    out.scratch = [rows, gone]
    return out


_held: dict[tuple[str, str], object] = {}


def held_by(operator: str, key: str, make: Callable[[], object]):
    """What an operator keeps in a Python worker from task to task. A worker serves many operators in turn: what another one, or
    the same one under another key, has kept is let go first."""
    if (operator, key) not in _held:
        _held.clear()
        _held[operator, key] = make()
    return _held[operator, key]


class Recent:
    """Values remembered by key in two generations, each of at most half of `max_bytes`.

    A full young generation becomes the old one; a key found there moves up. So what is used often stays, and a worker's
    memory has a bound whatever the number of keys. `entry` is what a key costs beside its own bytes and its value's.
    """

    def __init__(self, max_bytes: int, entry: int = 180):
        self.max_bytes, self.entry, self.size = max_bytes, entry, 0
        self.young: dict = {}
        self.old: dict = {}

    def many(self, keys: list, learn: Callable[[list], list[bytes]]) -> list[bytes]:
        """The value of each key; `learn` gives the values of those that are not remembered."""
        found = list(map(self.young.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            asked = [keys[i] for i in missing]
            out: dict[Hashable, bytes] = dict(zip(asked, map(self.old.get, asked)))
            new = [key for key, value in out.items() if value is None]
            out.update(zip(new, learn(new)))
            size = sum(map(len, out)) + sum(map(len, out.values())) + self.entry * len(out)
            if 2 * (self.size + size) > self.max_bytes:
                self.old, self.young, self.size = self.young, {}, 0
            self.size += size
            self.young.update(out)
            for i, key in zip(missing, asked):
                found[i] = out[key]
        return found
