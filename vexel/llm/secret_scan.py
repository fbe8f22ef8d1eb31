"""Secrets in texts: strong patterns, and weak parts of credentials that are reported where complementary parts meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, numbered, pick, text_of

#: Strong patterns. Runs shorter than the least length of `access` and `hex` hold no longer one, so the length is in the pattern;
#: a short match of `assign` may hide a longer one, so its length is looked at afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: an identifier that is assigned, an address, a long run of letters and digits.
IDENT = r"""(?i)(?:client|account|access|app|tenant|user|key)[_-]?(?:key[_-]?)?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
ENDPOINT = r"""https?://[^\s"'<>]+"""
BLOB = r"[A-Za-z0-9+/]{40,}={0,2}"
WEAK = f"(?:{ENDPOINT})|(?:{IDENT})|(?:{BLOB})"
#: A paragraph ends at a blank line.
BREAK = r"\n[ \t\r]*\n"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "endpoint", "blob")
#: Code points on both sides of an identifier that are its scope.
REACH = 300


def _parts(text: Column, pattern: str, kind: Column | None, least: int = 0) -> Column:
    """Of each match of a pattern (kind, gap, breaks, length): the gap is what lies between the match before and this one.

    Texts without a match take one search; those with some are split at them, so places are sums of lengths.
    """
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    gap = lambda x: F.struct(F.length(x).alias("gap"), (F.size(F.split(x, BREAK, -1)) - 1).alias("breaks"))
    if kind is None:
        own = lambda x: F.when(x.rlike("^" + ENDPOINT), KINDS.index("endpoint")).when(x.rlike(f"^{BLOB}$"), F.when(x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]"), KINDS.index("blob"))).otherwise(KINDS.index("ident"))
        kinds = F.transform(found, own)
    elif least:
        kinds = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.when(F.length(x) >= least, kind))
    else:
        kinds = F.transform(found, lambda x: kind)
    match = F.arrays_zip(kinds.alias("kind"), F.transform(found, lambda x: F.length(x)).alias("length"), F.transform(rest, gap).alias("rest"))
    return F.transform(match, lambda x: F.struct(x["kind"].alias("kind"), x["rest"]["gap"].alias("gap"), x["rest"]["breaks"].alias("breaks"), x["length"].alias("length")))


@dataclass
class Scan:
    """`docs` (doc_id, row number), a row for each document; `spans` (row number, kind, start, end), kinds by their place in KINDS,
    places in code points, ends exclusive."""

    docs: DataFrame
    spans: DataFrame


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> Scan:
    """Spans of secrets in every whole text; a null text is empty.

    `assign`, `access` and `hex` are reported wherever they stand, leftmost and not overlapping for each kind. An identifier
    (`access`, or a weak `ident`) has a scope: `reach` code points on both sides within its paragraph. It is joined
    with the secrets (`assign`, `hex`, weak `blob`) and addresses (`endpoint`) in it. The scope is complete where there is a
    secret, and one of identifier and secrets is strong (`access`, `assign`) or an address stands by. Weak parts are reported
    where they belong to a complete scope, and only there. Weak parts that overlap a strong span are no parts.

    A text is read once; it is neither shuffled nor stored, only lengths are. Scopes and parts meet by (row, piece of `reach` code
    points), so a very long text is many keys, and as parts do not overlap a scope holds no more of them than it is wide.
    Repeated and null ids are told apart row by row. Other columns are ignored; an empty table gives empty ones.
    """
    text = F.col("text")
    kinds = {k: F.lit(i) for i, k in enumerate(KINDS)}
    searched = [(ASSIGN, ASSIGN, kinds["assign"], ASSIGN_LEAST), (ACCESS, ACCESS, kinds["access"], 0), (HEX, HEX, kinds["hex"], 0), (f"{ACCESS}|(?:{IDENT})", WEAK, None, 0)]
    none = F.array().cast("array<struct<kind:int,gap:int,breaks:int,length:int>>")
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text")).withColumn("text", text_of(text))
    held = numbered(rows.select("doc_id", *(F.when(text.rlike(has), _parts(text, p, kind, least)).otherwise(none).alias(f"p{i}") for i, (has, p, kind, least) in enumerate(searched))), "parts")
    exploded = None
    for i in range(len(searched)):
        own = held.select(ROW, F.lit(i).alias("search"), F.posexplode(f"p{i}").alias("pos", "x")).select(ROW, "search", "pos", "x.*")
        exploded = own if exploded is None else exploded.unionByName(own)
    before = W.partitionBy(ROW, "search").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = exploded.select(ROW, "kind", "length", F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(before).alias("end"), F.sum("breaks").over(before).alias("block"))
    placed = placed.filter("kind is not null and length is not null").select(ROW, "kind", (F.col("end") - F.col("length")).alias("start"), "end", "block")
    strong = F.col("kind") < len(BASE)
    ahead = W.partitionBy(ROW).orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy(ROW).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    clear = placed.select("*", F.max(F.when(strong, F.col("end"))).over(ahead).alias("_to"), F.min(F.when(strong, F.col("start"))).over(behind).alias("_from"))
    clear = clear.filter(strong | (F.coalesce(F.col("_to") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_from") >= F.col("end"), F.lit(True)))).drop("_to", "_from")
    linked = _linked(clear, reach)
    return Scan(held.select("doc_id", ROW), clear.filter(strong).select(ROW, "kind", "start", "end").unionByName(linked))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts of complete scopes, each once."""
    of = lambda *names: F.col("kind").isin(*(KINDS.index(n) for n in names))
    scopes = parts.filter(of("access", "ident")).select(ROW, "kind", "start", "end", "block")
    own = scopes.select(ROW, F.col("kind").alias("of_kind"), F.col("start").alias("of_start"), F.col("end").alias("of_end"), F.col("block").alias("of_block"))
    pieces = own.withColumn("piece", F.explode(F.sequence(F.expr(f"greatest(of_start - {reach}, 0) div {reach}"), F.expr(f"(of_end + {reach}) div {reach}"))))
    around = parts.filter(of("assign", "hex", "blob", "endpoint")).withColumn("piece", F.expr(f"start div {reach}"))
    inside = (F.col("block") == F.col("of_block")) & (F.col("start") >= F.col("of_start") - reach) & (F.col("end") <= F.col("of_end") + reach)
    met = around.join(pieces, [ROW, "piece"]).filter(inside)
    some = lambda *names: F.max(of(*names))
    scope = [ROW, "of_kind", "of_start", "of_end"]
    seen = met.groupBy(*scope).agg(some("assign", "hex", "blob").alias("secret"), some("assign").alias("strong"), some("endpoint").alias("address"))
    complete = seen.filter(F.col("secret") & (F.col("strong") | F.col("address") | (F.col("of_kind") == KINDS.index("access")))).select(scope)
    weak = met.filter(of("blob", "endpoint")).select(*scope, "kind", "start", "end").join(complete, scope).select(ROW, "kind", "start", "end")
    idents = complete.filter(F.col("of_kind") == KINDS.index("ident")).select(ROW, F.col("of_kind").alias("kind"), F.col("of_start").alias("start"), F.col("of_end").alias("end"))
    return weak.unionByName(idents).distinct()


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; spans are `kind:start:end` by start, then kind."""
    scan = secret_spans(docs, id_col, text_col, reach)
    names = F.array(*map(F.lit, KINDS))
    told = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{BASE[k]}")
    own = scan.spans.groupBy(ROW).agg(*(count(k) for k in range(len(BASE))), F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    out = scan.docs.join(own, ROW, "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    base = told(F.filter("s", lambda s: s["kind"] < len(BASE)))
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in BASE), F.sha2(base, 256).alias("base_sha256"), told(F.col("s")).alias("spans"))
