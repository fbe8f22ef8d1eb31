"""Brown class-based bigram model: exchange clustering, class transitions, words emitted by classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .common import bucket_of, discard, pick, stored

END = 0  #: item number of the end of a text, which also stands before its first word
_END_HASH = np.uint64(0x656E64206F662074)
#: Bytes of the texts whose words are numbered together: a distinct word among them is hashed and looked up once.
CHUNK = 1 << 22


@dataclass(frozen=True)
class Settings:
    """Words counted `least` times or more are items of their own; rarer ones belong to one of `groups` items by their last
    letters, as their own contexts say next to nothing.

    All items get classes by exchange: first the `head` most frequent ones among each other, then all others in
    `rounds` over the whole table of pairs. The number of classes grows with that of items (`class_number`) unless given.
    `table` bounds the number of words that are broadcast (their hash, count and item: 20 bytes each); if more words
    reach `least`, the count asked for is raised so far, and the rest of the vocabulary is joined. `backing` pseudo-counts of the class's
    overall share smooth a transition; `mixed` is the weight of the class model against the unigram model of the same counts.
    """

    least: int = 5
    groups: int = 384
    classes: int | None = None
    head: int = 512
    sweeps: int = 8
    rounds: int = 8
    table: int = 400_000
    backing: float = 4.0
    mixed: float = 0.95

    def __post_init__(self):
        if 1 + self.table + self.groups >= 1 << 20:
            raise ValueError("more items than the packed pairs hold")

    def class_number(self, items: int) -> int:
        return max(2, min(items, self.classes or max(16, round(2 * items ** (1 / 3)))))


def _documents(batch: pd.DataFrame) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in batch["text"]]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, groups' raw values, first word of each text and the end)."""
    hashes, firsts, starts, ends = text_hash.words(texts)
    data = text_hash.LOWER[np.frombuffer(b" ".join(texts), np.uint8)].astype(np.uint64)
    tail = np.zeros(len(ends), np.uint64)
    for k in range(1, 4):  # the last three bytes say what a word's ending is
        at = ends - k
        tail = tail * np.uint64(257) + np.where(at >= starts, data[np.maximum(at, 0)] + np.uint64(1), np.uint64(0))
    return hashes, tail, firsts


def _numbered_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, their groups' raw values, number of every word among them, first word of each text and the end)."""
    own, ends, number, firsts = text_hash.distinct_words([t.lower() for t in texts])
    data = np.full(len(own) + len(ends) - 1, 32, np.uint8)
    inside = np.ones(len(data), bool)
    inside[ends[1:] + np.arange(len(ends) - 1)] = False
    data[inside] = own
    hashes, tail, _ = _tokens([data.tobytes()])
    return hashes, tail, number, firsts


def _group(tail: np.ndarray, groups: int) -> np.ndarray:
    return (text_hash.mix(tail) % np.uint64(groups)).astype(np.int64)


def word_counts(rows: DataFrame, groups: int) -> DataFrame:
    """(word, group, n) of every word of `rows`: each task adds up its own words before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, group, n = (np.concatenate(x) for x in zip(*held))
            own, at, back = np.unique(word, return_index=True, return_inverse=True)
            return own, group[at], np.bincount(back, n, len(own)).astype(np.int64)

        size = 0
        for batch in batches:
            texts = _documents(batch)
            for first, last in text_hash.chunks(texts, CHUNK):
                own, tail, number, _ = _numbered_tokens(texts[first:last])
                held.append((own, _group(tail, groups), np.bincount(number, minlength=len(own))))
                size += len(own)
                if size > 2_000_000:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # as many words as memory is meant for: the shuffle adds up the rest
                        word, group, n = held.pop()
                        size = 0
                        yield pd.DataFrame({"word": word.view(np.int64), "group": group.astype(np.int32), "n": n})
        if held:
            word, group, n = merged()
            yield pd.DataFrame({"word": word.view(np.int64), "group": group.astype(np.int32), "n": n})

    return rows.mapInPandas(run, "word bigint, group int, n bigint").groupBy("word").agg(F.first("group").alias("group"), F.sum("n").alias("n"))


@dataclass
class Words:
    """The broadcast part of the vocabulary: sorted hashes, counts, and item numbers (0 for words of an ending's group)."""

    hashes: np.ndarray
    counts: np.ndarray
    items: np.ndarray
    own: int
    groups: int

    @property
    def total(self) -> int:
        """Items: 0 the end, then words of their own by falling count, then the groups."""
        return 1 + self.own + self.groups

    def look_up(self, word: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, count) of each word; count 0 for words that are not here."""
        out, n = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
            hit = self.hashes[at] == word
            out[hit], n[hit] = self.items[at[hit]], self.counts[at[hit]]
        by_ending = out == 0
        out[by_ending] = 1 + self.own + _group(tail[by_ending], self.groups)
        return out, n


def _sequence(items: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, item) of every token, ends among them; tokens of text i begin at firsts[i] + i."""
    places = firsts[1:] + np.arange(len(firsts) - 1)
    out = np.full(len(items) + len(firsts) - 1, END, np.int64)
    inside = np.ones(len(out), bool)
    inside[places] = False
    out[inside] = items
    return np.concatenate([[END], out[:-1]]), out


def pair_counts(rows: DataFrame, words: Words) -> DataFrame:
    """(before, item, n): how often an item follows another, over all tokens; each task adds up its own before the shuffle."""
    shared, total = rows.sparkSession.sparkContext.broadcast(words), words.total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, n = (np.concatenate(x) for x in zip(*held))
            own, back = np.unique(pair, return_inverse=True)
            return own, np.bincount(back, n, len(own)).astype(np.int64)

        size = 0
        for batch in batches:
            texts = _documents(batch)
            for first, last in text_hash.chunks(texts, CHUNK):
                word, tail, number, firsts = _numbered_tokens(texts[first:last])
                before, item = _sequence(shared.value.look_up(word, tail)[0][number], firsts)
                held.append(np.unique(before * total + item, return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 700_000:
                        pair, n = held.pop()
                        size = 0
                        yield pd.DataFrame({"pair": pair, "n": n})
        if held:
            pair, n = merged()
            yield pd.DataFrame({"pair": pair, "n": n})

    counted = rows.mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))  # a pair is one number on its way
    return counted.select(F.expr(f"int(pair div {total})").alias("before"), F.expr(f"int(pair % {total})").alias("item"), "n")


#: Low bits of a packed neighbour that hold its count; the others hold its item (under 2 ** 20 of them, see `Settings.table`).
COUNT_BITS = 42


def neighbours(pairs: DataFrame) -> DataFrame:
    """(item, near): for each item, all it stands next to, as other * 2 ** COUNT_BITS + n, where other is -1 - o for an o
    before it and o for one after it; near is the bytes of these numbers, which every round hands to its tasks as they are.

    A row has at most twice as many entries as there are items, whatever the input.
    """
    packed = lambda item, other: pairs.select(F.col(item).alias("item"), (other.cast("bigint") * (1 << COUNT_BITS) + F.col("n")).alias("near"))
    lists = packed("before", F.col("item")).unionByName(packed("item", -1 - F.col("before"))).groupBy("item").agg(F.collect_list("near").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            ends, data = near.offsets.to_numpy() * 8, near.values.to_numpy().tobytes()
            rows = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_pydict({"item": batch.column("item"), "near": pa.array(rows, pa.binary())})

    return lists.mapInArrow(run, "item int, near binary")


def _near(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the rows, others, counts) of a batch of `neighbours`."""
    near = batch.column("near")
    if not len(near):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(near.buffers()[1], np.int32, len(near) + 1, near.offset * 4) // 8
    values = np.frombuffer(near.buffers()[2], np.int64, offsets[-1])[offsets[0] :]
    return offsets - offsets[0], values >> COUNT_BITS, values & ((1 << COUNT_BITS) - 1)


def _contexts(batch: pa.RecordBatch, of: np.ndarray, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, counts) for some rows of `neighbours` at a time; counts[i] has the classes after item i, then those before it.
    Neighbours without a class yet (-1) count for nothing."""
    items = batch.column("item").to_numpy()
    offsets, other, n = _near(batch)
    for first in range(0, len(items), 1024):
        last = min(first + 1024, len(items))
        lo, hi = offsets[first], offsets[last]
        row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        o = other[lo:hi]
        cls = of[np.where(o >= 0, o, -1 - o)]
        ok = cls >= 0
        cell = row * (2 * classes) + cls + np.where(o >= 0, 0, classes)
        yield items[first:last], np.bincount(cell[ok], n[lo:hi][ok], (last - first) * 2 * classes).reshape(-1, 2 * classes)


def class_table(near: DataFrame, of: np.ndarray, classes: int, old: np.ndarray | None = None) -> np.ndarray:
    """table[a, b]: tokens of class b after class a, over pairs of items that have a class; with `old`, what the table gains (or
    loses) when items go from these classes to those of `of`, for which only the rows of items that move are read.

    Tasks' tables are added up in Spark. The broadcast items are at most as many as `Settings.table` and the groups.
    """
    spark = near.sparkSession
    shared = spark.sparkContext.broadcast((of, old))
    if old is not None:
        moved = spark.createDataFrame(pa.table({"item": pa.array(np.flatnonzero(of != old), pa.int32())}))
        near = near.join(F.broadcast(moved), "item", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, was), table = shared.value, np.zeros(classes * classes)
        for batch in batches:
            offsets, other, n = _near(batch)
            item = np.repeat(batch.column("item").to_numpy(), np.diff(offsets))
            after, other = other >= 0, np.where(other >= 0, other, -1 - other)
            # A pair stands in the rows of both its items: it counts in that of the first, or in the only one that moves.
            ok = after if was is None else after | (own[other] == was[other])
            ok &= (own[item] >= 0) & (own[other] >= 0)
            first, second, n = np.where(after, item, other)[ok], np.where(after, other, item)[ok], n[ok]
            table += np.bincount(own[first] * classes + own[second], n, len(table))
            if was is not None:
                table -= np.bincount(was[first] * classes + was[second], n, len(table))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": table[cells]})

    cells = near.mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # classes * classes
    table = np.zeros(classes * classes)
    table[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    return table.reshape(classes, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, up to what no clustering changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _sides(counts: np.ndarray, table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(counts of the classes on one side, cells[j, k] that such a count of class j changes if the item is of class k, tokens of k)."""
    classes = len(table)
    return [(counts[:, :classes], table.T, table.sum(axis=1)), (counts[:, classes:], table, table.sum(axis=0))]


#: Counts up to this one are told apart by `_joining`.
_FEW = 3


def _joining(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the likelihood gains if the item of a row of counts is added to class k, shape (rows, classes).

    Only cells that a row has change. Many rows have the same count of the same class, so each such case is
    worked out once for all k. Most counts are at most `_FEW`: what these change is a product of matrices for each count, in
    blocks of rows that are too small for the library to spread them over threads.
    """
    classes = len(table)
    out = np.zeros((len(counts), classes))
    block = max(1, (1 << 18) // classes**2)
    for part, cells, tokens in _sides(counts, table):
        has = np.zeros((-(-len(part) // block) * block, classes))
        for n in range(1, _FEW + 1):
            has[: len(part)] = part == n
            out += np.matmul(has.reshape(-1, block, classes), _xlogx(cells + n) - _xlogx(cells)).reshape(-1, classes)[: len(part)]
        row, j = np.nonzero(part > _FEW)
        if len(row):
            n = part[row, j]
            span = int(n.max()) + 1
            case, back = np.unique(j * span + n.astype(np.int64), return_inverse=True)
            have = cells[case // span]
            change = _xlogx(have + (case % span)[:, None]) - _xlogx(have)
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[starts]] += np.add.reduceat(change[back], starts, axis=0)
        out -= _xlogx(tokens + part.sum(axis=1)[:, None]) - _xlogx(tokens)
    return out


def _leaving(counts: np.ndarray, table: np.ndarray, old: np.ndarray) -> np.ndarray:
    """What the likelihood loses if the item of a row of counts is taken out of its class, one number a row."""
    out = np.zeros(len(counts))
    for part, cells, tokens in _sides(counts, table):
        row, j = np.nonzero(part)
        have = cells[j, old[row]]
        out += np.bincount(row, _xlogx(have) - _xlogx(np.maximum(have - part[row, j], 0)), len(counts))
        have = tokens[old]
        out -= _xlogx(have) - _xlogx(np.maximum(have - part.sum(axis=1), 0))
    return out


def exchange_round(near: DataFrame, of: np.ndarray, table: np.ndarray, turn: int) -> np.ndarray:
    """The classes after one round: items without a class get their best one; once all have one, half of them move to theirs.

    All tasks judge by the same table; the halves take turns, so that neighbours seldom move past each other.
    The end keeps class 0 for itself.
    """
    shared = near.sparkSession.sparkContext.broadcast((of, table))
    classes = len(table)
    if (of >= 0).all():
        near = near.filter(F.pmod(F.xxhash64("item"), F.lit(2)) == turn % 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = shared.value
        for batch in batches:
            for items, counts in _contexts(batch, own, classes):
                new = own[items] < 0
                may = (items != END) & (new if (own < 0).any() else True)
                items, counts, new = items[may], counts[may], new[may]
                gain = _joining(counts, cells)
                stay = np.flatnonzero(~new)
                old = own[items[stay]]
                gain[stay, old] = _leaving(counts[stay], cells, old)
                gain[:, 0] = -np.inf
                best = gain.argmax(axis=1)
                best = np.where(counts.any(axis=1), best, np.where(new, 1 + items % max(1, classes - 1), own[items]))
                went = best != own[items]
                yield pa.RecordBatch.from_pydict({"item": pa.array(items[went], pa.int32()), "class": pa.array(best[went], pa.int32())})

    moved = near.mapInArrow(run, "item int, class int").toPandas()  # at most one row for each item
    out = of.copy()
    out[moved["item"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int64)
    return out


def cluster(pairs: DataFrame, items: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(class of each item, table of class bigrams): exact exchange among the most frequent items, then rounds over all.

    A round that lowers the likelihood of the whole table is undone and ends the search.
    """
    classes, head = settings.class_number(items), min(items, 1 + settings.head)
    first = pairs.filter((F.col("before") < head) & (F.col("item") < head)).toPandas()  # head * head
    follows = np.zeros((head, head))
    follows[first["before"].to_numpy(np.int64), first["item"].to_numpy(np.int64)] = first["n"].to_numpy(np.float64)
    of = np.full(items, -1, np.int64)
    of[:head] = exchange(follows, min(classes, max(2, head // 4)), settings.sweeps)
    near = stored(neighbours(pairs), "neighbours")
    one = np.zeros((head, classes))
    one[np.arange(head), of[:head]] = 1
    table = one.T @ follows @ one  # no other item has a class yet
    for turn in range(settings.rounds if classes > 2 else 1):
        settled = bool((of >= 0).all())
        after = exchange_round(near, of, table, turn)
        new = table + class_table(near, after, classes, of) if settled else class_table(near, after, classes)
        if settled and likelihood(new) <= likelihood(table):
            break
        of, table = after, new
    if (of < 0).any():  # items that no pair has
        of[of < 0] = classes - 1
    discard(near)
    return of, table


def exchange(follows: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each item, from follows[a, b], the count of b after a.

    Items move, one by one, to the class that most raises the likelihood of the class bigrams, until a sweep moves none.
    The end (item 0) keeps class 0 for itself. The start deals items by falling frequency.
    """
    size = len(follows)
    classes = min(classes, size)
    often = np.lexsort((np.arange(size), -follows.sum(axis=0)))
    of = np.zeros(size, np.int64)
    rest = [i for i in often.tolist() if i != END]
    if classes > 1:
        for rank, item in enumerate(rest):
            of[item] = 1 + rank % (classes - 1)
    one = np.zeros((size, classes))
    one[np.arange(size), of] = 1
    right, left = follows @ one, follows.T @ one  # of each item: counts of the classes after and before it
    table = one.T @ right
    ent = _xlogx
    for _ in range(sweeps if classes > 2 else 0):
        moved = 0
        for w in rest:
            old, out, into, self_n = of[w], right[w].copy(), left[w].copy(), follows[w, w]
            # Without w: its counts leave row and column `old`.
            out[old] -= self_n
            into[old] -= self_n
            base = table.copy()
            base[old] -= out
            base[:, old] -= into
            base[old, old] -= self_n
            before, after = base.sum(axis=1), base.sum(axis=0)
            n_out, n_in = out.sum() + self_n, into.sum() + self_n
            # What the likelihood gains if w joins class k: cells of row k and column k change, and (k, k) by both.
            gain = (ent(base + out) - ent(base)).sum(axis=1) + (ent(base + into[:, None]) - ent(base)).sum(axis=0)
            cell = np.diag(base)
            gain += ent(cell + out + into + self_n) - ent(cell) - (ent(cell + out) - ent(cell)) - (ent(cell + into) - ent(cell))
            # Row sums take in what follows w, column sums what is before it; w's own cells move with it.
            gain -= ent(before + n_out) - ent(before) + ent(after + n_in) - ent(after)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table = base
            table[new] += out
            table[:, new] += into
            table[new, new] += self_n
            if new != old:
                moved += 1
                of[w] = new
                for counts, by in ((right, follows[:, w]), (left, follows[w])):
                    counts[:, old] -= by
                    counts[:, new] += by
        if not moved:
            break
    return of


@dataclass
class Model:
    """What scoring needs beside the table of all words' counts."""

    settings: Settings
    words: Words
    of: np.ndarray  # class of each item
    transition: np.ndarray  # probability of class b after class a
    emit: np.ndarray  # 1 / (count + vocabulary + 1) of each class
    tokens: int
    vocabulary: int
    ends: int
    rarest: int  # the smallest count of the broadcast words; every word counted less often is in the other table

    def contexts(self, before: np.ndarray, item: np.ndarray) -> np.ndarray:
        """What count + 1 is multiplied by to give the probability of a token."""
        a, b = self.of[before], self.of[item]
        s = self.settings
        return s.mixed * self.transition[a, b] * self.emit[b] + (1 - s.mixed) / (self.tokens + self.vocabulary + 1)


def fit(rows: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """(model, table of all words' counts) from all rows of `rows` (text).

    Word counts, pair counts, classes, transitions and emissions are of the whole input. The driver holds the broadcast
    words (`table` at most), the class of each item and tables of classes; all else stays in tables.
    """
    counts = stored(word_counts(rows, settings.groups), "words")
    ends = rows.count()
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # The cut of the broadcast table: the least count that keeps it within its bound.
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("v")).orderBy(F.col("n").desc()).filter("n > 1").limit(settings.table).toPandas()
    within = levels[levels["v"].cumsum() <= settings.table]
    rarest = int(within["n"].min()) if len(within) else np.iinfo(np.int64).max
    least = max(rarest, settings.least)
    held = counts.filter(F.col("n") >= rarest).select("word", "n").toPandas()
    hashes, number = held["word"].to_numpy(np.int64).view(np.uint64), held["n"].to_numpy(np.int64)
    ranked = np.lexsort((hashes, -number))
    own = int((number >= least).sum())
    item = np.zeros(len(hashes), np.int32)
    item[ranked[:own]] = np.arange(1, own + 1)
    order = np.argsort(hashes)
    words = Words(hashes[order], number[order], item[order], own, settings.groups)
    pairs = stored(pair_counts(rows, words), "pairs")
    of, table = cluster(pairs, words.total, settings)
    overall = (table.sum(axis=0) + 1) / (table.sum() + table.shape[1])
    transition = (table + settings.backing * overall) / (table.sum(axis=1, keepdims=True) + settings.backing)
    # Distinct words of each class: those of their own, and the rarer ones of its groups.
    rare = counts.filter(F.col("n") < least).groupBy("group").agg(F.count(F.lit(1)).alias("v")).toPandas()
    distinct = np.bincount(of[: 1 + own], minlength=len(table)).astype(np.float64)
    np.add.at(distinct, of[1 + own + rare["group"].to_numpy(np.int64)], rare["v"].to_numpy(np.float64))
    emit = 1 / (table.sum(axis=0) + distinct + 1)
    discard(pairs)
    return Model(settings, words, of, transition, emit, int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends, rarest), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row, whole texts.

    Probabilities are (count of the word + 1) times a context that knows only classes, so both scores are sums over
    tokens of log10(count + 1) and of the contexts' logarithms. The second, and the first for words in the broadcast
    table, come from one pass. Rarer words leave it as (row, word, times) and meet `counts` in a join; these sums
    go back to their rows by a row number, given when the first pass is written out.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sums = f"row bigint, doc_id {kind}, n_tokens bigint, known bigint, logs double, contexts double, words array<bigint>, times array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, out = _documents(batch), []
            for first, last in text_hash.chunks(texts, CHUNK):
                word, tail, number, firsts = _numbered_tokens(texts[first:last])
                items, n = own.words.look_up(word, tail)
                word, items, n = word[number], items[number], n[number]
                before, item = _sequence(items, firsts)
                starts = firsts[:-1] + np.arange(last - first)
                context = np.add.reduceat(np.log10(own.contexts(before, item)), starts)
                logs = np.log10(n + 1.0)  # added up text by text: a running sum over MBs loses digits
                known = np.concatenate([[0], np.cumsum(n > 0)])
                rare = n == 0
                for i in range(last - first):
                    a, b = firsts[i], firsts[i + 1]
                    left, times = np.unique(word[a:b][rare[a:b]], return_counts=True)
                    out.append((b - a + 1, known[b] - known[a] + (own.ends > 0), logs[a:b].sum() + np.log10(own.ends + 1.0), context[i], left.view(np.int64), times.astype(np.int32)))
            frame = pd.DataFrame(out, columns=["n_tokens", "known", "logs", "contexts", "words", "times"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            frame.insert(0, "row", np.arange(row, row + len(frame)))
            row += len(frame)
            yield frame

    found = stored(rows.mapInPandas(run, sums), "scores")
    rare = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rest = counts.filter(F.col("n") < model.rarest).select("word", "n")
    met = rare.join(rest, "word").groupBy("row").agg(F.count(F.lit(1)).alias("_n"), F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = found.select("row", "doc_id", "n_tokens", "known", "logs", "contexts").join(met, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * float(np.log10(model.tokens + model.vocabulary + 1))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), base.alias("base_score"), (logs + F.col("contexts")).alias("score"))


def class_lm(docs: DataFrame, settings: Settings = Settings(), modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    The model learns from the rows whose crc32(id) modulo `modulus` is not `held`. Tokens are words (A-Z lowered, parted
    by white space) and one end. base_score is the add-one unigram log10 probability, score the class model's:
    P(class | class before) * P(word | class), where each class keeps one share for its unknown words, mixed with
    the unigram model. Words are told apart by 64-bit hashes. A null or empty text is its end alone; a null id
    belongs to the training part; repeated rows count as often as they stand there; an empty table gives an empty one.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    model, counts = fit(rows.filter(bucket_of(F.col("doc_id"), modulus) != held).select("text"), settings)
    out = score(rows, model, counts)
    held_out = (bucket_of(F.col("doc_id"), modulus) == held).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
