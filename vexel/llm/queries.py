"""The registered queries of the corpus operators, and the SQL that states the same results."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepiece_codec
from .chat_format import Template, chat_format, read_loss, read_turns
from .class_lm import class_lm
from .exact_dedup import exact_dedup
from .fingerprint import fingerprint_stability
from .language_id import language_id
from .license_scan import HEAD, SPELLINGS, known_digests, license_scan
from .minhash_dedup import minhash_dedup
from .packing import pack_documents
from .secret_scan import ASSIGN, ASSIGN_LEAST, ACCESS, BLOB, BREAK, ENDPOINT, HEX, IDENT, REACH, WEAK, secret_scan
from .sort_means import centroid_clusters
from .turn_repair import conversation_repair
from .url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_stability(table(spark, sf_dir, "documents"))


def _piece_digests(ids: np.ndarray, bounds: np.ndarray, codec: sentencepiece_codec.Codec) -> tuple:
    """Digests of a document's ids, of what they decode to, and of the pieces' bounds in the text."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return len(ids), sha(codec.listed(ids)), sha(codec.decode(ids.tolist()).encode()), zlib.crc32(bounds.astype("<u4").tobytes())


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint"
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"), derive=_piece_digests, columns=columns)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted conversations, read back into turns and loss text; the digests come from what was read."""
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format(rows).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_class_lm": op2_class_lm,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_fingerprint": op4_fingerprint,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_chat_format": op6_chat_format,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_license_scan": op10_license_scan,
    "op11_turn_repair": op11_turn_repair,
    "op12_sort_means": op12_sort_means,
    "op13_secret_scan": op13_secret_scan,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op3_sql() -> str:
    return r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as form from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by form) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(form) as text_sha256
from d window w as (partition by form order by n desc, doc_id rows between unbounded preceding and unbounded following)"""


def _op6_sql() -> str:
    t = Template()
    rests = t.rests
    escaped = lambda x: rf"regexp_replace({x}, '([<\[])(~*)({rests})', '\1~\2\3', 'g')"
    marks = "case role " + " ".join(f"when '{r}' then {len(a) + len(b)}" for r, a, b in t.roles) + f" else {len(t.other_open) + len(t.says) + len(t.other_close)} + length({escaped('role')}) end"
    return rf"""
with r as (select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, null, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) t(i)),
s as (select *, lag(role) over (partition by conv_id, own order by turn, role, text) as before, length({escaped('text')}) as n from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(n + case when before is null or before <> role then {marks} else {len(t.more)} end)::bigint as formatted_chars
from s group by conv_id, own"""


def _op9_sql() -> str:
    """For pages whose links all stay on their host, as in the test tables: scores are then the seeds."""
    return r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules(h, pre, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j as (select p.*, (select {'rule': h || pre, 'verdict': v} from rules where (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, pre)
                   order by length(h || pre) desc, length(h) desc, h || pre desc limit 1) as fit from p),
s as (select host, avg(coalesce((fit.verdict = 'allow')::int, 0)) as good, avg(coalesce((fit.verdict = 'block')::int, 0)) as bad from j where host <> '' group by host)
select page_id, j.host, path, fit.rule as rule, coalesce(fit.verdict, case when bad - good >= 0.5 then 'block' end, 'allow') as verdict
from j left join s on j.host = s.host"""


def _op10_sql() -> str:
    low = f"regexp_replace(lower(coalesce(text, '')), {_quoted(HEAD.replace('*+', '*').replace('++', '+'))}, '{chr(92)}1')"
    form = rf"regexp_replace({low}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for pattern, kept in SPELLINGS:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(kept.replace('$', chr(92)))}, 'g')"
    values = ", ".join(f"({_quoted(d)}, {_quoted(n)}, {_quoted(c)})" for d, n, c, _ in known_digests())
    return rf"""
with known(digest, license_id, category) as (values {values}),
d as (select doc_id, regexp_replace({form}, ' *\n[ \n]*', chr(10), 'g') as form from documents),
n as (select doc_id, count(*) as n_notices, string_agg(distinct license_id, ',' order by license_id) as notices
      from (select doc_id, unnest(string_split(form, chr(10))) as line from d) join known on known.digest = md5(trim(line, ' ')) group by doc_id)
select d.doc_id, md5(trim(replace(form, chr(10), ' '), ' ')) as digest, license_id, category, coalesce(notices, '') as notices, coalesce(n_notices, 0)::bigint as n_notices
from d left join known on known.digest = md5(trim(replace(form, chr(10), ' '), ' ')) left join n on n.doc_id = d.doc_id"""


def _op11_sql() -> str:
    """A search forward, turn by turn: of each state the least (cost, letters), with the lines so far."""
    add = lambda x, cost, letter, line=None: f"case when {x} is not null then {{'c': {x}.c + {cost}, 'l': {x}.l || '{letter}', 't': {f'{x}.t || [{line}]' if line else f'{x}.t'}}} end"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    only = lambda cond, x: f"case when {cond} then {x} end"
    closed = lambda src: f"select conv, i, s0, s1, u, {least('a', add('u', 2, 'I', chr(39) + 'assistant:' + chr(39)))} as a from (select conv, i, s0, s1, {least('u', *(add(x, 2, 'I', chr(39) + 'user:' + chr(39)) for x in ('s0', 's1', 'a')))} as u, a from ({src}))"
    kept, cast = "role || ':' || text", lambda role: f"'{role}:' || text"
    stays = lambda who, x: only(f"not gone and role[1] = '{who}'", add(x, "cut", "K", kept))
    recast = lambda role, x: only("not gone", add(x, "2 + cut", "R", cast(role)))
    step = f"""select conv, r.i as i, {add('s0', 3, 'D')} as s0, {least(add('s1', 3, 'D'), stays('s', 's0'))} as s1,
        {least(add('u', 3, 'D'), *(f(x) for x in ('s0', 's1', 'a') for f in (lambda x: stays('u', x), lambda x: recast('user', x))))} as u,
        {least(add('a', 3, 'D'), stays('a', 'u'), recast('assistant', 'u'))} as a from f join r using (conv) where r.i = f.i + 1"""
    first = "select conv, 0::bigint as i, {'c': 0::bigint, 'l': '', 't': []::varchar[]} as s0, null::struct(c bigint, l varchar, t varchar[]) as s1, null::struct(c bigint, l varchar, t varchar[]) as u, null::struct(c bigint, l varchar, t varchar[]) as a from convs"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive tbl as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) as t),
k as (select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
x as (select k.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, tbl.t[xor(c & 255, b) + 1]))) % 20 as fault from k, tbl),
d as (select conv, turn, case fault when 4 then 'user' else role end as role, case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
      from x, range(case fault when 0 then 0 when 3 then 2 else 1 end)),
o as (select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text)) as i, rtrim(text, {white}) as body from d),
q as (select *, row_number() over (partition by conv, role, text order by i) as seen from o),
r as (select conv, turn, i, role, text, body = '' as blank, body <> '' and seen > 1 as duplicate, body = '' or seen > 1 as gone, (body <> '' and seen = 1 and right(body, 1) not in ('.', '!', '?'))::bigint as cut,
             lag(role[1]) over (partition by conv order by i) || role[1] as pair from q),
convs as (select distinct conv from r),
f as ({closed(first)} union all {closed(step)}),
best as (select conv, list_min([s0, a]) as b from f where i = (select max(i) from r where r.conv is not distinct from f.conv)),
n as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, sum(cut) as truncated,
             count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by conv)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
       coalesce(b.c, 0)::bigint as cost, coalesce(b.l, '') as audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join best on best.conv is not distinct from c.conv_id left join n on n.conv is not distinct from c.conv_id"""


def _op12_sql() -> str:
    return """
with recursive kept as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
                        where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
seeds as (select v, row_number() over (order by sha256('3:' || vec_id), v) - 1 as k from kept where vec_id is not null qualify row_number() over (order by sha256('3:' || vec_id), v) <= 8),
c(r, k, v) as (
    select 0, k, v from seeds
    union all
    select c.r + 1, c.k, coalesce(m.v, c.v) from c left join (
        select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from (
            select k, i, sum(v[i])::hugeint as s, count(*) as n from (
                select row_number() over () as own, kept.v as v, arg_min(c.k, {'d': list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': c.k}) as k
                from (select *, row_number() over () as own from kept) kept, c group by kept.own, kept.v), range(1, 65) g(i) group by k, i) group by k
    ) m on m.k = c.k where c.r < 10),
a as (select vec_id, min({'d': list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': c.k}) as b
      from (select *, row_number() over () as own from kept) kept, c where c.r = 10 group by own, vec_id)
select vec_id, b.k::int as cluster, b.d::bigint as distance, (sum(b.d) over (partition by b.k))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a join c on c.r = 10 and c.k = b.k"""


def _op13_sql() -> str:
    kinds = {"assign": (ASSIGN, 2, f"case when length(m.g) >= {ASSIGN_LEAST} then 0 end"), "access": (ACCESS, 0, "1"), "hex": (HEX, 0, "2")}
    weak = f"case when regexp_matches(m.x, {_quoted('^' + ENDPOINT)}) then 4 when regexp_matches(m.x, {_quoted('^' + BLOB + '$')}) then case when regexp_matches(m.x, '[0-9]') and regexp_matches(m.x, '[a-z]') and regexp_matches(m.x, '[A-Z]') then 5 end else 3 end"
    searches = [*kinds.values(), (WEAK, 0, weak)]
    found = " union all ".join(
        f"""select own, {i} as search, m.pos, {kind} as kind, length(m.gap) as gap, len(regexp_extract_all(m.gap, {_quoted(BREAK)})) as breaks, length(m.x) as n from (
            select own, unnest(list_transform(range(1, len(xs) + 1), lambda j: {{'pos': j, 'x': xs[j], 'g': gs[j], 'gap': rest[j]}})) as m from (
                select own, regexp_extract_all(text, {_quoted(p)}) as xs, regexp_extract_all(text, {_quoted(p)}, {group}) as gs, string_split_regex(text, {_quoted(p)}) as rest from d))"""
        for i, (p, group, kind) in enumerate(searches)
    )
    names = "['assign', 'access', 'hex', 'ident', 'endpoint', 'blob']"
    told = lambda cond: f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter ({cond}), '')"
    return f"""
with d as (select row_number() over () as own, doc_id, coalesce(text, '') as text from documents),
f as ({found}),
p as (select own, kind, e - n as s, e, block from (select *, sum(gap + n) over w as e, sum(breaks) over w as block from f window w as (partition by own, search order by pos)) where kind is not null),
t as (select * from p a where kind < 3 or not exists (select 1 from p b where b.own = a.own and b.kind < 3 and b.s < a.e and b.e > a.s)),
i as (select own, kind as ik, s as i_s, e as i_e, block as ib from t where kind in (1, 3)),
j as (select i.*, kind, s, e from i join t on t.own = i.own and block = ib and s >= i_s - {REACH} and e <= i_e + {REACH} where kind in (0, 2, 4, 5)),
c as (select own, ik, i_s, i_e from j group by all having bool_or(kind in (0, 2, 5)) and (bool_or(kind = 0) or bool_or(kind = 4) or ik = 1)),
o as (select own, kind, s, e from t where kind < 3 union all select distinct own, kind, s, e from j join c using (own, ik, i_s, i_e) where kind > 3 union all select own, ik, i_s, i_e from c where ik = 3)
select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, sha256({told('kind < 3')}) as base_sha256, {told('kind is not null')} as spans
from d left join o on o.own = d.own group by d.own, doc_id"""


SQL: dict[str, str] = {"op3_exact_dedup": _op3_sql(), "op6_chat_format": _op6_sql(), "op9_url_filter": _op9_sql(), "op10_license_scan": _op10_sql(), "op11_turn_repair": _op11_sql(), "op12_sort_means": _op12_sql(), "op13_secret_scan": _op13_sql()}
