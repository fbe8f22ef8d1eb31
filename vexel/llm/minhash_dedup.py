"""Near duplicates: banded MinHash candidates, odd sketches to thin them out, full sets to confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text_hash
from .common import ROW, discard, held_by, numbered, pick, stored, without_rows
from .components import components

WIDTH = 5  #: words in a shingle
BANDS, ROWS = 25, 5  #: of a pair at similarity 0.85, all bands miss with probability (1 - 0.85**5)**25 < 5e-7
BITS = 512  #: of an odd sketch
#: Pairs whose odd sketches estimate less than the threshold by this much are no candidates. Five deviations: at 0.85, 125 samples
#: have one of 0.032 and the collisions of 512 bits add little to it.
MARGIN = 0.18

#: Band keys that more than one in so many rows have are not shuffled; there are fewer of them than this.
HOT = 10_000
#: Nodes of one reference beyond so many are dealt over parts, each of which meets its own copy of the reference's set.
SHARE = 256

_rng = np.random.Generator(np.random.PCG64(7))
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, (1 << 64) - 1, BANDS * ROWS, np.uint64)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last in text_hash.chunks(texts):
        hashes, firsts, _, _ = text_hash.words(texts[first:last])
        found, bounds = text_hash.shingles(hashes, firsts, width)
        for i in range(last - first):
            yield np.unique(found[bounds[i] : bounds[i + 1]])


def minhashes(own: np.ndarray, block: int = 512) -> np.ndarray:
    """The smallest of all shingle hashes under each of the hash functions."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), block):
        np.minimum(out, (own[at : at + block, None] * _TIMES + _PLUS).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of samples; bands have keys of their own."""
    return text_hash.mix((least.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """A bitmap where each sample (with its number) flips one bit: equal samples of two texts cancel out under XOR."""
    bits = (text_hash.mix(least + np.arange(len(least), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(bits, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """The number of set bits in the XOR of two odd sketches that stands for `similarity`: more bits mean less."""
    samples = BANDS * ROWS
    return int(np.floor(BITS / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / BITS))))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, fp, bands, odd) of each row; fp is 128 bits of the whole set, null bands for an empty one."""
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_by("minhash", "", lambda: None)
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in batch["text"]]
            size, fp, bands, odd = [], [], [], []
            for own in shingle_sets(texts, width):
                size.append(len(own))
                fp.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                if len(own):
                    least = minhashes(own)
                    bands.append(band_keys(least))
                    odd.append(odd_sketch(least))
                else:
                    bands.append(None)
                    odd.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "n_shingles": size, "fp": fp, "bands": bands, "odd": odd})

    return rows.mapInPandas(run, f"doc_id {kind}, n_shingles bigint, fp binary, bands array<bigint>, odd array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, few: bool, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp, shingles) of the documents in `wanted` (node), from their whole texts, one row for equal ones.

    The list of ids is broadcast only if it is known to be short (`few`); else rows meet by a shuffle.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"] == wanted["node"], "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in batch["text"]]
            first = 0
            for last in range(256, len(texts) + 256, 256):
                own = list(shingle_sets(texts[first:last], width))
                yield pd.DataFrame({"doc_id": batch["doc_id"].array[first:last], "fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own], "shingles": [s.view(np.int64) for s in own]})
                first = last

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, fp binary, shingles array<bigint>").dropDuplicates(["doc_id", "fp"])


class _Confirm:
    """Decides pairs of nodes on their full sets; `links` has those that are linked so far."""

    def __init__(self, docs: DataFrame, marks: DataFrame, numerator: int, denominator: int, id_col: str, text_col: str, width: int, max_broadcast_ids: int):
        self.docs, self.marks, self.numerator, self.denominator = docs, marks, numerator, denominator
        self.id_col, self.text_col, self.width, self.max_broadcast_ids = id_col, text_col, width, max_broadcast_ids
        self.most = most_odd_bits(max(0.0, numerator / denominator - MARGIN))
        self.links: list[DataFrame] = []

    def sizes_allow(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.denominator >= F.greatest(n, m) * self.numerator

    def sets(self, nodes: DataFrame, number: int) -> DataFrame:
        """(doc_id, fp, shingles) of at most `number` nodes."""
        return stored(full_sets(self.docs, nodes.distinct(), number <= self.max_broadcast_ids, self.id_col, self.text_col, self.width), "sets")

    def pairs(self, pairs: DataFrame) -> None:
        """Pairs (a, b), a < b: odd sketches rule out most that are not similar, full sets decide on the rest."""
        one, two = (self.marks.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
        differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        likely = stored(pairs.join(one, "a").join(two, "b").filter(differ <= self.most).select("a", "b", "fp_a", "fp_b", "n_a", "n_b"), "pairs")
        number = likely.count()
        if number:
            sets = self.sets(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))), 2 * number)
            left, right = (sets.select(F.col("doc_id").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
            common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
            sure = likely.join(right, ["b", "fp_b"]).join(left, ["a", "fp_a"]).withColumn("common", common)
            sure = sure.filter(F.col("common") * self.denominator >= (F.col("n_a") + F.col("n_b") - F.col("common")) * self.numerator)
            self.links.append(stored(sure.select("a", "b"), "links"))
            discard(sets)
        discard(likely)

    def components(self) -> DataFrame | None:
        """(node, component) of the linked nodes, None if there are no links."""
        if not self.links:
            return None
        found = self.links[0]
        for more in self.links[1:]:
            found = found.unionByName(more)
        return stored(components(found), "components")


def _references(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """(key, rows, ref): the node whose set the nodes of a bucket are described by, for each bucket in `mixed` (key, rows).

    A node's home is the pivot that most of its buckets have, the smallest of several; a bucket takes the home that most of its
    nodes have. So the nodes of a family meet at one reference, where each of their many buckets has a pivot of its own.
    """
    votes = rows.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    home = votes.groupBy("node").agg(F.min_by("pivot", F.struct(-F.col("votes"), "pivot")).alias("home"))
    votes = rows.select("key", "node").join(home, "node").groupBy("key", "home").agg(F.count(F.lit(1)).alias("votes"))
    return mixed.join(votes.groupBy("key").agg(F.min_by("home", F.struct(-F.col("votes"), "home")).alias("ref")), "key")


def _with_bases(spokes: DataFrame, bases: DataFrame) -> DataFrame:
    """`spokes` joined by pivot with `bases` (pivot, base), where one pivot may have any share of all rows.

    Pivots of many nodes are fewer than HOT, so their numbers of parts are broadcast; a base has as many rows as its pivot has parts."""
    counts = spokes.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"))
    share = max(SHARE, spokes.count() // HOT)
    parts = F.broadcast(counts.filter(F.col("rows") > share).select("pivot", F.ceil(F.col("rows") / share).alias("parts")))
    whole = F.coalesce("parts", F.lit(1).cast("bigint"))
    left = spokes.join(parts, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("node"), whole)).drop("parts")
    right = bases.join(parts, "pivot", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1))).drop("parts")
    return left.join(right, ["pivot", "part"]).drop("part")


def _candidates(spokes: DataFrame, confirm: _Confirm) -> DataFrame:
    """Pairs (a, b) of nodes of one reference and different components that can be linked, as their gaps tell.

    The gap of a node is the symmetric difference of its set and its reference's; that of two nodes is the one of their
    gaps. A node is linked with its reference if its gap is small enough: this is known at once, and goes to `confirm.links`.
    Linked sets differ in at most T = n * (1 - t) / t elements, so of a gap of more than T elements any T + 1
    hold one that the other's gap has too: its T + 1 rarest do, and are compared with the other's T + 1 rarest. Gaps of g
    and h elements must share (g + h - D) / 2, if linked sets of these sizes differ in at most D; from the first
    shared one on, at places i and j, they can share 1 + min(g - i, h - j). Pairs that can't reach it are not made.

    Linked nodes whose gaps share nothing need no pair: with k = (1 - t) / (1 + t), sizes n and m and the reference's r, they have
    g + h <= (n + m) * k; if h > (m + r) * k then (n - r) * k > g, but n - r <= g. So both are linked with the
    reference. Elements that one gap alone has come first in the order of rarity and lead nowhere, so only their number counts.
    """
    numerator, denominator = confirm.numerator, confirm.denominator
    number = 2 * spokes.count()
    nodes = spokes.select("node").unionByName(spokes.select(F.col("pivot").alias("node")))
    sets = confirm.sets(nodes, number)
    fps = confirm.marks.select("node", "fp")
    own = fps.join(sets.select(F.col("doc_id").alias("node"), "fp", "shingles"), ["node", "fp"])
    bases = own.join(spokes.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("pivot")).agg(F.min_by("shingles", "fp").alias("base"))
    wide = _with_bases(spokes.select("pivot", "node", "component").distinct(), bases).join(own.select("node", "shingles"), "node")
    gap = F.concat(F.array_except("shingles", "base"), F.array_except("base", "shingles"))
    wide = wide.select("pivot", "node", "component", F.size("shingles").cast("long").alias("n"), F.size("base").cast("long").alias("base_n"), gap.alias("gap"))
    most = F.floor(F.col("n") * (denominator - numerator) / numerator)
    size = F.size("gap").cast("long")
    near = size * (denominator + numerator) <= (F.col("n") + F.col("base_n")) * (denominator - numerator)
    gaps = stored(wide.withColumn("size", size).withColumn("near", near).withColumn("most", most).withColumn("gap_no", F.monotonically_increasing_id()), "gaps")
    discard(sets)
    confirm.links.append(stored(gaps.filter(F.col("near") & (F.col("pivot") != F.col("node"))).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")), "links"))
    cells = gaps.select("pivot", "node", "n", "component", "most", "size", "near", "gap_no", F.explode("gap").alias("token"))
    shared = cells.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("found")).filter("found > 1")
    of_node = Window.partitionBy("gap_no")
    place = F.col("size") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("found", "token"))
    rare = cells.join(shared, ["pivot", "token"]).withColumn("place", place).filter(F.col("place") <= F.col("most") + 1)
    kept = stored(rare.select("pivot", "token", "node", "n", "component", "size", "near", "place"), "rarest")
    x, y = (kept.select("pivot", "token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component", "size", "near", "place"))) for s in "ab")
    most_shared = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    differ = (F.col("size_a") + F.col("size_b") - most_shared * 2) * (denominator + numerator)
    enough = differ <= (F.col("n_a") + F.col("n_b")) * (denominator - numerator)
    apart = (F.col("component_a") != F.col("component_b")) & ~(F.col("near_a") & F.col("near_b"))
    met = x.join(y, ["pivot", "token"]).filter((F.col("node_a") < F.col("node_b")) & apart & enough)
    out = stored(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "candidates")
    discard(gaps, kept)
    return out


def _by_key(rows: DataFrame, table: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined by key with `table` (key, rows, ...), one row for each key, `rows` how many of `total` have it.

    A key of more than one in HOT of `total` is met where its rows are: there are fewer than HOT such keys, so they are
    broadcast. All other keys are shuffled, and none of them is many rows."""
    often = F.col("rows") > total // HOT
    hot, rest = F.broadcast(table.filter(often).drop("rows")), table.filter(~often).drop("rows")
    return rows.join(hot, "key", how).unionByName(rows.join(hot.select("key"), "key", "left_anti").join(rest, "key", how))


def minhash_dedup(docs: DataFrame, numerator: int = 85, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set has its distinct shingles of `width` words (A-Z lowered, words parted by white space); a text with
    fewer words is one shingle; one without words, or null, has none and is linked with nothing. Two documents are
    linked if denominator * intersection >= numerator * union (four fifths at least: the bands are laid out for no less, and a
    lower threshold is refused); component_id is the smallest doc_id
    that links reach, kept means doc_id = component_id.

    Texts of equal sets are one node from the start, so copies of any number cost one row each. Nodes that share a band
    of MinHash samples form a bucket. First all nodes of a bucket are held against its pivot, the smallest one: as many
    pairs as rows. Buckets whose nodes are then of one component are done. In the others, nodes of different
    components are paired where the rarest elements of their gaps to a common reference agree (`_references`, `_candidates`),
    which loses no link and makes few pairs even of thousands of texts that all resemble the reference but not each other.
    Sizes and odd sketches thin out pairs, full sets decide. Nothing is capped and no bucket is gathered in one task.

    A doc_id that occurs with two texts counts as two documents of the same id. A null id has component null and is
    not kept. Repeated rows and ties need no rule; an empty table gives an empty one.
    """
    if 5 * numerator < 4 * denominator:
        raise ValueError(f"a similarity of {numerator / denominator} is below the 0.8 that the bands find")
    sigs = stored(signatures(docs, id_col, text_col, width), "signatures")
    first = F.min(F.struct(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "odd")).alias("first")
    nodes = stored(sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(first).select("fp", "first.*"), "nodes")
    confirm = _Confirm(docs, nodes.select("node", "fp", "n", "odd"), numerator, denominator, id_col, text_col, width, max_broadcast_ids)
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    pivots = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    pivots = stored(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), "rows"), "pivots")
    total = pivots.agg(F.sum("rows")).first()[0] or 0
    members = stored(_by_key(members, pivots, total), "members")
    discard(pivots)
    rays = members.filter((F.col("node") != F.col("pivot")) & confirm.sizes_allow(F.col("n"), F.col("pivot_n")))
    confirm.pairs(rays.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    linked = confirm.components()
    part = members if linked is None else members.join(linked, "node", "left")
    part = part.withColumn("component", F.col("node") if linked is None else F.coalesce("component", "node"))
    mixed = part.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high and rows > 2").select("key", "rows")
    mixed = stored(mixed, "mixed")
    inside = stored(_by_key(part, mixed, total, "left_semi"), "inside")
    refs = stored(_references(inside, mixed), "references")
    spokes = _by_key(inside.filter("node <> pivot").drop("pivot"), refs, total).select(F.col("ref").alias("pivot"), "node", "n", "component")
    spokes = stored(spokes.distinct(), "spokes")
    if not spokes.isEmpty():
        found = _candidates(spokes, confirm)
        confirm.pairs(found)
        linked = confirm.components()
        discard(found)
    discard(members, mixed, inside, refs, spokes)
    rows = sigs.select("doc_id", "n_shingles", "fp").join(nodes.select("fp", "node"), "fp", "left")
    if linked is None:
        rows = rows.withColumn("component", F.lit(None).cast(rows.schema["node"].dataType))
    else:
        rows = rows.join(linked, "node", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", whole).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of `docs` of which one stays for each component, all columns as they are; rows without words all stay.

    The one with the smallest id stays (null last), then the first row: rows are told apart by their number, so repeated
    and null ids and rows that are equal in all columns leave one row too. An empty table gives an empty one.
    """
    rows = numbered(docs, "numbered")
    found = minhash_dedup(rows, numerator, denominator, ROW, text_col)
    linked = stored(found.filter("n_shingles > 0").select(F.col("doc_id").alias(ROW), "component_id"), "linked")
    several = linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component_id")
    members = linked.join(several, "component_id", "left_semi").join(rows.select(ROW, F.col(id_col).alias("id")), ROW)
    order = F.struct(F.col("id").isNull().alias("none"), "id", ROW)
    members = stored(members.select("component_id", order.alias("order")), "members")
    best = members.groupBy("component_id").agg(F.min("order").alias("best"))
    gone = members.join(best, "component_id").filter(F.col(f"order.{ROW}") != F.col(f"best.{ROW}")).select(F.col(f"order.{ROW}").alias(ROW))
    out = without_rows(rows, gone, "near-copies", max_broadcast_rows)
    discard(linked, members)
    return out
