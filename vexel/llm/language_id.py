"""Language identification by cross-parsing: how few phrases of a language's sample a text is made of."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, bucket_of, held_by, numbered, pick, without_rows

LANE = 512  #: symbols of a text that step together with those of other lanes
BASE = 16  #: letters without a symbol of their own are written in digits of this base


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix automaton of a sequence as a table: next state of (state, symbol), -1 for none; state 0 starts."""
    most = 2 * len(text) + 2
    follow: list[list[int]] = [[-1] * symbols]
    length, link, last = [0], [-1], 0
    for c in text.tolist():
        state = len(follow)
        follow.append([-1] * symbols)
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and follow[at][c] < 0:
            follow[at][c] = state
            at = link[at]
        if at >= 0:
            target = follow[at][c]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                copy = len(follow)
                follow.append(follow[target][:])
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and follow[at][c] == target:
                    follow[at][c] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    assert len(follow) <= most
    return np.array(follow, np.int32)


@dataclass
class Alphabet:
    """Symbols of letters: 0 is a letter that no sample has, 1 a run of anything else, then `single` letters, one symbol
    each, then the BASE digits that write the places of the letters in `rare`, all with the same number of digits."""

    single: np.ndarray
    rare: np.ndarray

    @property
    def size(self) -> int:
        return 2 + len(self.single) + (BASE if len(self.rare) else 0)

    @property
    def digits(self) -> int:
        return max(1, math.ceil(math.log(max(2, len(self.rare)), BASE) - 1e-9))

    def coded(self, text: str) -> np.ndarray:
        """The symbols of the lower-cased text."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.zeros(len(points), np.int32)
        for letters, first in ((self.single, 2), (self.rare, 1 << 20)):
            if len(letters) and len(points):
                at = np.minimum(np.searchsorted(letters, points), len(letters) - 1).astype(np.int32)
                hit = letters[at] == points
                out[hit] = first + at[hit]
        gap = ~_is_letter(points)
        out[gap] = 1
        out = out[~gap | np.concatenate([[True], ~gap[:-1]])[: len(gap)]]
        if len(self.rare):
            far = out >= 1 << 20
            place = np.repeat(np.where(far, out - (1 << 20), 0), np.where(far, self.digits, 1))
            wide = np.repeat(far, np.where(far, self.digits, 1))
            nth = np.arange(len(place)) - np.repeat(np.cumsum(np.where(far, self.digits, 1)) - np.where(far, self.digits, 1), np.where(far, self.digits, 1))
            digit = place // BASE ** (self.digits - 1 - nth) % BASE
            out = np.where(wide, 2 + len(self.single) + digit, np.repeat(out, np.where(far, self.digits, 1)))
        return out.astype(np.uint8 if self.size <= 256 else np.int32)


@dataclass
class Model:
    """languages, the alphabet, a table for each language (from `automaton`), sample sizes in symbols."""

    languages: list[str]
    alphabet: Alphabet
    tables: list[np.ndarray]
    sizes: list[int]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text under each language, shape (texts, languages).

        A phrase is the longest match in the language's sample from where the last one ended; a symbol that the sample
        lacks is a phrase of its own. The count is that of the whole text, though lanes of it step at once: each lane
        first goes from the start of a phrase, then again from the state in which the lane before it ended, until both
        ways are in the same state at the same place; from there on they are one. A text with a lane where they never
        meet, so that the next one began wrongly, is parsed symbol by symbol.
        """
        coded = [self.alphabet.coded(t) for t in texts]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        lanes = [(i, s) for i, c in enumerate(coded) for s in range(0, len(c), LANE)]
        if not lanes:
            return out
        owner, start = (np.array(x) for x in zip(*lanes))
        size = np.minimum(LANE, np.array([len(c) for c in coded])[owner] - start)
        order = np.argsort(-size, kind="stable")
        place = np.argsort(order)  # of each lane in falling size
        owner, start, size = owner[order], start[order], size[order]
        first = start == 0
        before = np.where(first, 0, place[order - 1])  # the lane that ends where this one begins
        last = np.ones(len(size), bool)
        last[before[~first]] = False
        steps = int(size[0])
        grid = np.zeros((steps, len(size)), np.int32)  # a row for each step
        for k, (i, s, n) in enumerate(zip(owner.tolist(), start.tolist(), size.tolist())):
            grid[:n, k] = coded[i][s : s + n]
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        width = self.alphabet.size
        states, counts = np.empty(grid.shape, np.int32), np.empty(grid.shape, np.int16)
        for j, table in enumerate(self.tables):
            flat = table.ravel()
            state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
            for step in range(steps):
                n = live[step]
                _advance(flat, width, state[:n], count[:n], grid[step, :n])
                states[step, :n], counts[step, :n] = state[:n], count[:n]
            whole, ends = count.copy(), state.copy()
            act = np.flatnonzero(~first)
            now = state[before[act]]
            act, now = act[now > 0], now[now > 0]
            seen = np.zeros(len(act), np.int32)
            for step in range(steps):
                over = size[act] <= step
                if over.any():
                    whole[act[over]], ends[act[over]] = seen[over], now[over]
                    act, now, seen = act[~over], now[~over], seen[~over]
                if not len(act):
                    break
                _advance(flat, width, now, seen, grid[step, act])
                met = now == states[step, act]
                if met.any():
                    whole[act[met]] = seen[met] + count[act[met]] - counts[step, act[met]]
                    act, now, seen = act[~met], now[~met], seen[~met]
            whole[act], ends[act] = seen, now
            np.add.at(out[:, j], owner, whole + (last & (ends > 0)))  # and the phrase that is open at the end
            for i in set(owner[act[~last[act]]].tolist()):
                out[i, j] = _one_by_one(coded[i], flat, width)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the least normalised phrases win, the name that sorts first in a tie."""
        have = [isinstance(t, str) and any(map(str.isalpha, t)) for t in texts]
        counts = self.phrases([t if ok else "" for t, ok in zip(texts, have)])
        # A phrase costs about the logarithm of its language's sample size.
        costs = counts * np.log2(np.maximum(self.sizes, 2))
        out = []
        for ok, cost in zip(have, costs):
            if not ok or not len(cost):
                out.append(("und", 0.0))
                continue
            first = int(np.argmin(cost))
            other = min(np.delete(cost, first), default=math.inf)
            out.append((self.languages[first], 1.0 if math.isinf(other) else float(other / (other + cost[first])) if other else 0.5))
        return out


def _advance(flat: np.ndarray, width: int, state: np.ndarray, count: np.ndarray, symbols: np.ndarray) -> None:
    """One symbol for each lane, in place; `count` has the phrases that ended."""
    to = flat[state * width + symbols]
    ended = np.flatnonzero(to < 0)
    if len(ended):
        # The phrase ends before this symbol, which begins the next one, or is one if the sample lacks it.
        count[ended] += state[ended] > 0
        again = flat[symbols[ended]]
        count[ended[again < 0]] += 1
        to[ended] = np.maximum(again, 0)
    state[:] = to


def _one_by_one(symbols: np.ndarray, flat: np.ndarray, width: int) -> int:
    at = count = 0
    for c in symbols.tolist():
        to = int(flat[at * width + c])
        if to < 0:
            count += at > 0
            to = int(flat[c])
            if to < 0:
                count += 1
                to = 0
        at = to
    return count + (at > 0)


def _is_letter(points: np.ndarray) -> np.ndarray:
    if points.size and int(points.max()) >= len(_letters[0]):
        _letters[0] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[0][points]


_letters = [np.fromiter((chr(i).isalpha() for i in range(0x3000)), bool, 0x3000)]


def choose_alphabet(samples: list[str], max_single: int) -> Alphabet:
    """All letters of the samples; those with the largest share in some language get a symbol of their own."""
    shares: dict[int, float] = {}
    for text in samples:
        points, counts = np.unique(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        letter = _is_letter(points)
        for point, n in zip(points[letter].tolist(), (counts[letter] / max(1, counts[letter].sum())).tolist()):
            shares[point] = max(shares.get(point, 0.0), n)
    ranked = sorted(shares, key=lambda c: (-shares[c], c))
    return Alphabet(np.array(sorted(ranked[:max_single]), np.uint32), np.array(sorted(ranked[max_single:]), np.uint32))


def fit(docs: DataFrame, sample_docs: int = 200, sample_chars: int = 60_000, max_single: int = 96, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled rows: for each language, distinct texts in the order of a hash until `sample_chars`.

    At most `sample_docs` texts of a language are looked at, and of a text longer than a quarter of `sample_chars` one
    window of that length, at a place that its hash tells. Both numbers bound what reaches the driver, whatever the size
    of the table: only hashes below a cut leave their task, and the cut is raised until it has enough distinct texts.
    Rows whose text or lang is null teach nothing. All letters of the samples are in the alphabet; beyond `max_single`
    of them letters are written in digits, so scripts of any size stay apart.
    """
    rows = pick(docs, (text_col, "text"), (lang_col, "lang")).filter("text is not null and lang is not null and text <> ''")
    spark, window = docs.sparkSession, max(1, sample_chars // 4)
    wanted = {r["lang"]: min(1.0, 2 * sample_docs / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    found: dict[str, list[tuple[int, int]]] = {}
    while wanted:
        cuts = spark.createDataFrame([(k, min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))) for k, share in wanted.items()], "_lang string, _cut bigint")
        near = hashed.join(F.broadcast(cuts), (F.col("lang") == F.col("_lang")) & (F.col("h") <= F.col("_cut")))  # one row for each language
        seen: dict[str, list[tuple[int, int]]] = {k: [] for k in wanted}
        for r in near.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n")).collect():
            seen[r["lang"]].append((r["h"], r["n"]))
        for lang, own in seen.items():
            if len(own) >= sample_docs or wanted[lang] >= 1:
                found[lang] = sorted(own)[:sample_docs]
                del wanted[lang]
            else:
                wanted[lang] = min(1.0, 8 * wanted[lang])
    keys = []
    for lang, own in found.items():
        total = 0
        for h, n in own:
            if total + min(n, window) <= sample_chars:
                keys.append((lang, h))
                total += min(n, window) + 1
    if not keys:
        return Model([], Alphabet(np.zeros(0, np.uint32), np.zeros(0, np.uint32)), [], [])
    chosen = F.broadcast(spark.createDataFrame(keys, "_lang string, _h bigint"))  # languages x sample_docs rows
    n = F.length("text")
    piece = F.substr("text", (F.pmod(F.col("h"), F.greatest(n - window, F.lit(0)) + 1) + 1).cast("int"), F.lit(window))
    hit = hashed.join(chosen, (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h"))).groupBy("lang", "h").agg(F.min(piece).alias("piece"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in hit.collect():  # sample_chars of each language
        texts.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    samples = {lang: "\n".join(t for _, t in sorted(own)) for lang, own in sorted(texts.items())}
    alphabet = choose_alphabet(list(samples.values()), max_single)
    coded = [alphabet.coded(t) for t in samples.values()]
    return Model(list(samples), alphabet, [automaton(c, alphabet.size) for c in coded], [max(1, len(c)) for c in coded])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1; how clearly the second language needs more phrases).

    Whole texts are parsed, of any length; equal costs give the name that sorts first. `und` with score 0 stands for a null text, one without letters, or a model of no language.
    The model is a few tables of bounded size and is broadcast; no row is shuffled.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model_key = str(shared._jbroadcast.id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held_by("language_id", model_key, lambda: shared.value)
        for batch in batches:
            texts = list(batch["text"])
            found: list[tuple[str, float]] = []
            first = total = 0
            for i, text in enumerate([*texts, None]):
                size = len(text) if isinstance(text, str) else 0
                if i == len(texts) or i > first and total + size > 1_000_000:
                    found += own.predict(texts[first:i])
                    first, total = i, 0
                total += size
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, with a model of the rows whose crc32(id) modulo `modulus` is not `held`.

    A null id is in the training part. lang, source and id are never inputs of a prediction. Repeated rows get equal
    results; an empty table gives an empty one.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"), (lang_col, "lang"))
    model = fit(rows.filter(bucket_of(F.col("doc_id"), modulus) != held))
    out = identify(rows, model)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of `docs` whose language is found, all columns as they are: those of `und` go.

    Rows are told apart by their number, so repeated and null ids are judged row by row. A table without any labelled row
    has no language that could be found: nothing is kept then. An empty table gives an empty one.
    """
    rows = numbered(docs, "numbered")
    model = fit(rows.filter(bucket_of(F.col(id_col), modulus) != held), text_col=text_col, lang_col=lang_col)
    gone = identify(rows, model, ROW, text_col).filter("lang_pred = 'und'").select(F.col("doc_id").alias(ROW))
    return without_rows(rows, gone, "unidentified", max_broadcast_rows)
