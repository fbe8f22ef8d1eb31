"""Cheapest repair of conversations by a scan of 4 x 4 matrices over (cost, audit), min and plus.

What a reader of turns has seen so far is one of four states: nothing, a system turn, a user turn, an answer. A turn is a matrix
of what it costs to get from state to state by keeping, recasting or deleting it, with any number of inserted turns before and
after; an element is (cost, letters of the edits), the smaller is better. The product of matrices is associative, so the
turns of one conversation can lie in many partitions: each reduces its own by a tree, a tree of Spark jobs combines these, and
the way back down tells each partition where the best path enters and leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, WHITE, numbered, pick, stored

START, SYSTEM, USER, ANSWER = range(4)
KEEP, RECAST, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, RECAST: 2, DELETE: 3, INSERT: 2}
#: What a truncated turn that is not deleted costs beside its edit.
TRUNCATED = 1
#: Turns that may follow a state, by the state they lead to: the initial of the role.
STEPS = {(START, SYSTEM): "s", (START, USER): "u", (SYSTEM, USER): "u", (USER, ANSWER): "a", (ANSWER, USER): "u"}
#: States in which a conversation may end.
ENDS = (START, ANSWER)
ROLES = {USER: "user", ANSWER: "assistant"}
_NONE = (1 << 60, "")
#: Elements that can be reached at all, each with the states between.
_REACH = [(i, j) for i in range(4) for j in range(4) if i == j or j in (USER, ANSWER) or (i, j) == (START, SYSTEM)]
_PATHS = [(4 * i + j, [(4 * i + k, 4 * k + j) for k in range(4) if (i, k) in _REACH and (k, j) in _REACH]) for i, j in _REACH]
#: Codes of turns: the role's initial (o: any other), a capital one if truncated; x: has to go.
GONE = "x"

Matrix = tuple


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product: of all states between the one of the least cost, of equal ones the least letters."""
    out = [_NONE] * 16
    for at, ways in _PATHS:
        least = min([a[x][0] + b[y][0] for x, y in ways])
        if least < _NONE[0]:
            out[at] = (least, min([a[x][1] + b[y][1] for x, y in ways if a[x][0] + b[y][0] == least]))
    return tuple(out)


def _better(out: list, at: int, cost: int, letters: str) -> None:
    out[at] = min(out[at], (cost, letters))


def _closure() -> Matrix:
    """No turn at all: what inserted turns alone do."""
    out = [_NONE] * 16
    for i in range(4):
        out[5 * i] = (0, "")
    for _ in range(2):  # a third inserted turn in a row leads nowhere new
        for (i, j), initial in STEPS.items():
            if initial != "s":
                for first in range(4):
                    if out[4 * first + i][0] < _NONE[0]:
                        cost, letters = out[4 * first + i]
                        _better(out, 4 * first + j, cost + COSTS[INSERT], letters + INSERT)
    return tuple(out)


EMPTY = _closure()


@lru_cache(None)
def turn_matrix(code: str) -> Matrix:
    """The matrix of one turn, with inserted turns before and after it."""
    out = [_NONE] * 16
    more = TRUNCATED if code.isupper() else 0
    for i in range(4):
        _better(out, 5 * i, COSTS[DELETE], DELETE)
    for (i, j), initial in STEPS.items() if code != GONE else ():
        if initial == code.lower():
            _better(out, 4 * i + j, COSTS[KEEP] + more, KEEP)
        if initial != "s":
            _better(out, 4 * i + j, COSTS[RECAST] + more, RECAST)
    return times(times(EMPTY, tuple(out)), EMPTY)


def product(codes: str) -> Matrix:
    """The product over turns, as a tree: half by half."""
    if not codes:
        return EMPTY
    return _short(codes) if len(codes) <= 12 else times(product(codes[: len(codes) // 2]), product(codes[len(codes) // 2 :]))


@lru_cache(50_000)
def _short(codes: str) -> Matrix:
    half = len(codes) // 2
    return times(_short(codes[:half]), _short(codes[half:])) if half else turn_matrix(codes)


def best_end(matrix: Matrix) -> int:
    """The state in which the best repaired conversation ends."""
    return min(ENDS, key=lambda end: matrix[4 * START + end])


def route(parts: list[Matrix], enters: int, leaves: int) -> list[tuple[int, int]]:
    """(enters, leaves) of each part on the best path through all of them."""
    ways = {enters: (0, "", ())}
    for part in parts:
        new: dict[int, tuple] = {}
        for i, (cost, letters, path) in ways.items():
            for j in range(4):
                if part[4 * i + j][0] < _NONE[0]:
                    way = (cost + part[4 * i + j][0], letters + part[4 * i + j][1], (*path, (i, j)))
                    new[j] = min(new.get(j, way), way)
        ways = new
    return list(ways[leaves][2])


def edits(letters: str, codes: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, number of the turn or -1 for an inserted one, state after it) of a part, deleted turns left out."""
    at = 0
    for letter in letters:
        if letter == INSERT or letter == RECAST:
            state = ANSWER if state == USER else USER
            yield letter, -1 if letter == INSERT else at, state
        elif letter == KEEP:
            state = {"s": SYSTEM, "u": USER, "a": ANSWER}[codes[at].lower()]
            yield letter, at, state
        at += letter != INSERT


#: What is added up over the turns of a part; `head` and `tail` are the initials at its ends, `low` and `high` its turn numbers.
_SUMMARY = "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"
_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]
_NODE = f"part bigint, costs array<bigint>, letters array<string>, {_SUMMARY}"


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _joined(a: dict, b: dict) -> dict:
    """The summary of two parts, one after the other (turn numbers ascend, null ones first)."""
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += _illegal(a["tail"], b["head"])
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"head": a["head"], "tail": b["tail"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def _matrix_of(row: dict) -> Matrix:
    return tuple(zip(row["costs"], row["letters"]))


def _as_columns(matrix: Matrix) -> dict:
    return {"costs": [c for c, _ in matrix], "letters": [x for _, x in matrix]}


def _leaf(conv, turns: list[tuple]) -> dict:
    """Matrix and summary of the turns (turn, role, row, n, blank, first, cut) of a conversation in one partition."""
    codes, rows, s = [], [], dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0) | dict.fromkeys(("head", "tail", "low", "high"))
    for turn, role, row, n, blank, first, cut in turns:
        initial = role[:1]
        stays = first and not blank
        code = initial if initial in ("s", "u", "a") else "o"
        codes.append((code.upper() if cut else code) if stays else GONE * n)
        rows.append(row)
        if stays and n > 1:
            codes.append(GONE * (n - 1))
        rows.extend([None] * (n - 1))
        s["rows"] += n
        s["blank"] += n if blank else 0
        s["duplicate"] += 0 if blank else n - bool(first)
        s["truncated"] += bool(stays and cut)
        s["illegal"] += (n - 1) * _illegal(initial, initial) + (s["tail"] is not None and _illegal(s["tail"], initial))
        s["head"], s["tail"] = initial if s["head"] is None else s["head"], initial
        if turn is not None:
            s["turns"] += turn != s["high"]
            s["low"], s["high"] = turn if s["low"] is None else s["low"], turn
    codes = "".join(codes)
    return {"conv_id": conv, "codes": codes, "row": rows} | _as_columns(product(codes)) | s


@dataclass
class Repaired:
    """`report` (conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has turns;
    `turns` (conv_id, position, edit, role, text), the repaired conversations."""

    report: DataFrame
    turns: DataFrame


def repair_conversations(rows: DataFrame, per_task: int = 200_000, fan: int = 32) -> Repaired:
    """The cheapest edits that make every conversation `(s?(ua)+)?` by the initials of its roles.

    Turns (conv_id, turn, role, text) are taken in the order of turn (null first), role and SHA-256 of the text. Null roles
    and texts are one space; rows of null conv_id are one conversation. A turn is blank (white space only), else a duplicate
    (role and text seen earlier), else truncated (its last character is not one of `.!?`), else sound. Keep costs 0, recasting as
    user or assistant 2, deleting 3, an inserted empty turn 2; blank and duplicate turns have to go, a truncated one that
    stays costs 1 more. Of equally cheap repairs the one whose letters are least in ASCII is taken.

    Equal rows are one row with a count before they meet, so repeated rows of any number are one; that a text came earlier is
    found by sums over (conversation, role, text), never by gathering a conversation. Turns are dealt by ranges of
    (conversation, turn, role, text): a conversation that holds a third of all rows lies in a third of the partitions, each of
    about `per_task` rows, and `fan` parts at a time are combined. Texts are no part of this; they are joined by row
    number in the end. Other columns are ignored. An empty table gives empty ones.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    one_space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    held = pick(rows, *((c, c) for c in ("conv_id", "turn", "role", "text")))
    held = numbered(held.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text")), "turns")
    end = F.rtrim("text", F.lit(WHITE))
    marks = held.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(*".!?")).alias("cut"), ROW)
    same = marks.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("row"))
    first = same.groupBy("conv_id", "role", "digest", "blank", "cut").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("none"))
    first = first.withColumn("turn", F.when(~F.col("none"), F.col("turn")))
    key = ["conv_id", "turn", "role", "digest", "blank", "cut"]
    both = same.select(*key, "n", "row", F.lit(False).alias("first")).unionByName(first.select(*key, F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("row"), F.lit(True).alias("first")))
    told = both.groupBy(*key).agg(F.sum("n").alias("n"), F.min("row").alias("row"), F.max("first").alias("first"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // per_task))
    dealt = told.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, part = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if own and row["conv_id"] != conv:
                    yield _batch([_leaf(conv, own) | {"part": part}], leaf_schema)
                    own = []
                conv, part = row["conv_id"], row["part"]
                own.append((row["turn"], row["role"], row["row"], row["n"], row["blank"], row["first"], row["cut"]))
        if own:
            yield _batch([_leaf(conv, own) | {"part": part}], leaf_schema)

    spark = rows.sparkSession
    leaf_ddl = f"conv_id {kind}, {_NODE}, codes string, row array<bigint>"
    leaf_schema = _arrow(spark, leaf_ddl)
    level = stored(dealt.select("conv_id", "part", "turn", "role", "row", "n", "blank", "first", "cut").mapInArrow(leaves, leaf_ddl), "leaves")
    # A partition has at most two conversations that others share, so these are no more than twice as many as partitions.
    spread = stored(level.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.max("part").alias("last")).filter("k > 1").select(F.col("conv_id").alias("_c"), "last"), "spread")
    last = spread.agg(F.max("last")).first()[0]
    shared = F.col("conv_id").eqNullSafe(F.col("_c"))
    spread = spread.select("_c")
    alone = level.join(F.broadcast(spread), shared, "left_anti")
    root, places = _ended(alone, kind), _ended(alone, kind).select("conv_id", "part", "enters", "leaves", "before")
    if last is not None:
        top, down = _combined(level.join(F.broadcast(spread), shared, "left_semi").drop("codes", "row"), kind, last + 1, fan)
        root, places = root.unionByName(_ended(top, kind)), places.unionByName(down)
    places = stored(places, "places")
    turns = _applied(level, places, held, kind)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    report = root.select("conv_id", "rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.get("costs", "leaves").alias("cost"), F.get("letters", "leaves").alias("audit"))
    return Repaired(stored(report, "report"), turns)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _ended(nodes: DataFrame, kind: str) -> DataFrame:
    """Whole conversations, entered with nothing seen and left in the state of the best end. The first row of a matrix is START."""
    costs, letters = F.col("costs"), F.col("letters")
    of = lambda end: F.struct(costs[end].alias("c"), letters[end].alias("l"))
    return nodes.select("conv_id", "part", "costs", "letters", *_NAMES, F.lit(START).alias("enters"), F.when(of(ENDS[1]) < of(ENDS[0]), ENDS[1]).otherwise(ENDS[0]).alias("leaves"), F.lit(0).cast("bigint").alias("before"))


def _combined(nodes: DataFrame, kind: str, parts: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(roots, the place of each part on its conversation's best path): up a tree of `fan` parts a node, and down again."""
    spark, levels = nodes.sparkSession, [nodes]
    node_ddl, place_ddl = f"conv_id {kind}, {_NODE}", f"conv_id {kind}, part bigint, enters int, leaves int, before bigint"
    node_schema, place_schema = _arrow(spark, node_ddl), _arrow(spark, place_ddl)

    def up(own: pa.Table) -> pa.Table:
        rows = sorted(own.to_pylist(), key=lambda r: r["part"])
        matrices, summary = [_matrix_of(r) for r in rows], {k: rows[0][k] for k in _NAMES}
        for row in rows[1:]:
            summary = _joined(summary, row)
        while len(matrices) > 1:
            matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "part": rows[0]["part"] // fan} | _as_columns(matrices[0]) | summary], node_schema)

    def down(own: pa.Table) -> pa.Table:
        rows, out = sorted(own.to_pylist(), key=lambda r: r["part"]), []
        before = rows[0]["before"]
        for row, (i, j) in zip(rows, route([_matrix_of(r) for r in rows], rows[0]["enters"], rows[0]["leaves"])):
            out.append({"conv_id": row["conv_id"], "part": row["part"], "enters": i, "leaves": j, "before": before})
            letters = row["letters"][4 * i + j]
            before += len(letters) - letters.count(DELETE)
        return pa.Table.from_pylist(out, place_schema)

    above = F.expr(f"part div {fan}")
    width = parts
    while width > 1:
        levels.append(stored(levels[-1].groupBy("conv_id", above).applyInArrow(up, node_ddl), "up"))
        width = -(-width // fan)
    places = _ended(levels[-1], kind).select("conv_id", "part", "enters", "leaves", "before")
    for level in reversed(levels[:-1]):
        own = places.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "enters", "leaves", "before")
        children = level.select("conv_id", "part", "costs", "letters").join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (above == F.col("_p")))
        places = stored(children.drop("_c", "_p").groupBy("conv_id", above).applyInArrow(down, place_ddl), "down")
    return levels[-1], places


def _applied(leaves: DataFrame, places: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """The repaired turns (conv_id, position, edit, role, text) of all parts."""
    out_ddl = f"conv_id {kind}, position bigint, edit string, cast string, {ROW} bigint"
    schema = _arrow(leaves.sparkSession, out_ddl)
    places = places.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "enters", "leaves", "before")
    way = F.get("letters", 4 * F.col("enters") + F.col("leaves")).alias("letters")
    parts = leaves.join(places, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).select("conv_id", "codes", "row", way, "enters", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for part in batch.to_pylist():
                for k, (edit, at, state) in enumerate(edits(part["letters"], part["codes"], part["enters"])):
                    out.append({"conv_id": part["conv_id"], "position": part["before"] + k, "edit": edit, "cast": None if edit == KEEP else ROLES[state], ROW: None if at < 0 else part["row"][at]})
                    if len(out) >= 10_000:
                        yield _batch(out, schema)
                        out = []
        yield _batch(out, schema)

    done = stored(parts.mapInArrow(run, out_ddl), "edits")
    new = done.filter(F.col(ROW).isNull()).select("conv_id", "position", "edit", F.col("cast").alias("role"), F.lit("").alias("text"))
    old = done.filter(F.col(ROW).isNotNull()).join(held.select(ROW, "role", "text"), ROW)
    return old.select("conv_id", "position", "edit", F.coalesce("cast", "role").alias("role"), "text").unionByName(new)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(`conv_id:turn`) modulo 20: 0 drops the row, 1 empties its text, 2 takes away its
    full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. A null is one space."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    out = pick(rows, *((c, c) for c in ("conv_id", "turn", "role", "text"))).withColumn("_fault", fault).filter("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(one_space("text"), ".!?", "")).otherwise(one_space("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(one_space("role"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of `role:text` of the turns in order, joined by newlines.

    SHA-256 of one text is a chain, so a conversation is read by one task; it streams through it and is never held.
    """
    ddl = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    schema = _arrow(turns.sparkSession, ddl)
    lines = turns.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, out = None, None, []
        for batch in batches:
            for own, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is None or own != conv:
                    if sha is not None:
                        out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                    conv, sha = own, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            yield _batch(out, schema)
            out = []
        yield _batch([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}] if sha is not None else [], schema)

    return stored(lines.mapInArrow(run, ddl), "digests")


def conversation_repair(rows: DataFrame, per_task: int = 200_000, fan: int = 32) -> DataFrame:
    """Every conversation of `rows` damaged (`damaged`) and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. A conversation that lost all rows has zeros, an empty audit and the digest of nothing."""
    done = repair_conversations(damaged(rows), per_task, fan)
    ids = rows.select(rows["conv_id"].alias("conv_id")).distinct()
    sha = digests(done.turns).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    report = done.report.select(F.col("conv_id").alias("_c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    out = ids.join(report, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
