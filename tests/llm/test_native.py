"""Exact dedup, chat formatting, URL filter and licence scan."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.harness import compare
from tests.llm.conftest import frame
from vexel.llm import exact_dedup as X
from vexel.llm import license_scan as L
from vexel.llm import queries as Q
from vexel.llm import url_filter as U
from vexel.llm.chat_format import Template, chat_format, read_loss, read_turns

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, name):
    rows, bad = compare(spark, name, Q.QUERIES[name], Q.SQL[name], SF)
    assert rows and not bad, bad[:3]


def python_plans(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op6_chat_format", "op9_url_filter", "op10_license_scan", "op13_secret_scan"])
def test_native_operators_run_no_python(spark, name):
    assert not python_plans(Q.QUERIES[name](spark, SF))


def dedup_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_dedup_by_brute_force(spark, words):
    rows = list(enumerate(words)) + [(900, "a b"), (901, "a  b"), (902, "ab"), (899, "a  b")]
    got = X.exact_dedup(frame(spark, rows, "keep_id digest form")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == dedup_by_hand(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == {v[0] for v in dedup_by_hand(rows).values()}
    assert {r["doc_id"]: r["keep_id"] for r in got}[900] == 899  # the longest, then the smallest id


def test_bytes_decide_where_digests_collide(spark, words):
    rows = list(enumerate(words))
    weak = X.exact_dedup(frame(spark, rows), digest=lambda c: F.length(c) % 3)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in weak.collect()} == dedup_by_hand(rows)


def test_exact_dedup_of_empty_table_repeated_rows_and_long_text(spark):
    assert X.exact_dedup(frame(spark, [])).count() == 0
    rows = [(1, "same"), (1, "same"), (2, "y " * 200_000), (3, "y" * 200_000), (None, "same")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_dedup(frame(spark, rows)).collect()}
    assert got == {(1, 1, 3, True), (None, 1, 3, False), (2, 2, 2, True), (3, 2, 2, False)}


def test_entire_license_texts(spark):
    whole = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense"}
    texts = [(i, L._text(name)) for name, i in whole.items()]
    texts += [("BSD-2-Clause", "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + L._BSD_2), ("BSD-3-Clause", L._BSD_3.replace("3. ", "* ").replace("2. ", "* ").replace("1. ", "* "))]
    texts += [("Zlib", L._ZLIB), ("GPL-3.0", "\n".join(f"# {x}" for x in L._GPL_HEADER.replace("https", "http").split("\n"))), ("Apache-2.0", "/*\n" + L._APACHE_HEADER + "\n*/"), ("Unlicense", L._text("Unlicense").upper())]
    texts += [(None, L._BSD_3 + " Or not."), (None, L._text("GPL-3")[:20_000])]
    got = {r["doc_id"]: r["license_id"] for r in L.license_scan(frame(spark, [(k, t) for k, (_, t) in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_drop_exact_copies_with_and_without_broadcast(spark, limit):
    docs = frame(spark, [(1, "a b"), (2, "ab"), (3, "c"), (4, None), (4, "ab"), (5, "z"), (5, "z"), (None, "c"), (None, "only"), (1, "other")], "_gone")
    out = X.drop_exact_copies(docs, max_broadcast_rows=limit)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, "a b"), (1, "other"), (3, "c"), (4, None), (5, "z"), (None, "only")], key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_chat_round_trip_and_loss(spark):
    controls = Template().controls
    nasty = ["", None, *controls, "".join(controls), "<~s>", "[~~INST]", "x<", "<", "[", "[INST", "</s>[INST] ok [/INST]", "~<s>~", "é😀\n", "a" * 5000, "<<<SYS>>>", "<s><s>"]
    roles = ["user", "assistant", "system", "tool", "<s>", None, "assistant"]
    rows = [(c, n, roles[(n * 3 + c) % 7], nasty[(n * 5 + c) % len(nasty)]) for c in range(12) for n in range(30)]
    rows += [(99, 0, "assistant", "one"), (99, 1, "assistant", "two"), (99, 2, "user", "u"), (99, 2, "user", "u"), (99, None, "user", "first")]
    out = chat_format(turns(spark, rows)).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()
    key = lambda r: ((r[1] is not None, r[1]) if r[1] is not None else (False, 0), r[2] or "", r[3] or "")
    for r in out:
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=key)
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    merged = next(r for r in out if r["conv_id"] == 99)
    assert merged["formatted"] == "[INST]first[/INST]<s>one<<MORE>>two</s>[INST]u<<MORE>>u[/INST]" and len(merged["loss_spans"]) == 2


def test_chat_of_many_turns_takes_time_by_their_number(spark):
    import time

    rows = [(1, n, ["user", "assistant"][n % 2], f"turn {n} é") for n in range(20_000)] + [(2, n, "assistant", f"part {n}") for n in range(5000)]
    began = time.time()
    out = {r["conv_id"]: r for r in chat_format(turns(spark, rows)).select("conv_id", F.size("loss_spans").alias("n"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert time.time() - began < 30
    assert out[1]["n"] == 10_000 and out[1]["loss"] == "".join(x[3] for x in rows if x[0] == 1 and x[2] == "assistant")
    assert out[2]["n"] == 5000 and out[2]["loss"] == "".join(x[3] for x in rows if x[0] == 2)


def test_rows_without_a_conversation_stay_apart(spark):
    got = sorted(r["formatted"] for r in chat_format(turns(spark, [(None, 0, "user", "a"), (None, 1, "user", "b"), (None, 1, "user", "b")])).collect())
    assert got == ["[INST]a[/INST]", "[INST]b[/INST]", "[INST]b[/INST]"]


def test_chat_of_nothing(spark):
    assert chat_format(turns(spark, [])).count() == 0
    assert chat_format(turns(spark, [(None, None, None, None)])).first()["formatted"] == "<<ROLE>><<SAYS>><</ROLE>>"


PAGES = "page_id bigint, url string, html string, host string, rule string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://Example.COM/en/a?b", None), (2, "https://www.example.com/en/", ""), (3, "x://sub.www.example.com/en/q#z", ""), (4, "http://a.net/es/", ""), (5, "http://net/fr/x", ""),
        (6, "http://bad.network/es/", ""), (7, None, ""), (8, "no scheme", ""), (9, "http://example.com", ""), (10, "http://example.com?en/", ""), (11, "http://e.org/x://y/z", ""), (12, "http://notexample.com/en/", ""),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.url_filter(pages(spark, rows)).collect()}
    assert got[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][0] == "sub.www.example.com" and got[3][2] == "www.example.com/en/"
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == ("net/fr/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8] and got[9] == ("example.com", "", None, "allow") and got[10][1] == ""  # a third of the host's pages is blocked
    assert got[11][:2] == ("e.org", "/x://y/z") and got[12][2] == "com/"


def test_distrust_runs_against_links(spark):
    link = lambda h: f'<a href="https://{h}/p">x</a>'
    rows = [(1, "http://spam.net/es/1", ""), (2, "http://farm.org/1", link("spam.net")), (3, "http://good.com/1", link("fine.org")), (4, "http://fine.org/1", link("good.com") + '<a href="/own">y</a>'), (5, "http://apart.org/", link("nowhere.org"))]
    got = {r["page_id"]: r["verdict"] for r in U.url_filter(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


@pytest.mark.parametrize("farms", [1, 2, 10])
def test_all_hosts_that_link_to_a_blocked_host_are_blocked(spark, farms):
    """bad.net is blocked by all its ruled pages; a page of it without a rule, and all its farms', are told by links."""
    link = lambda h: f'<a href="https://{h}/p">x</a>'
    rows = [(k, f"http://bad.net/es/{k}", "") for k in range(9)] + [(9, "http://bad.net/other", "")]
    rows += [(100 + k, f"http://farm{k}.org/", link("bad.net")) for k in range(farms)]
    rows += [(200, "http://shop.com/", link("fine.org")), (201, "http://fine.org/", ""), (202, "http://a.net/es/", ""), (203, "http://a.net/x", ""), (204, "http://a.net/y", "")]
    got = {r["page_id"]: r["verdict"] for r in U.url_filter(pages(spark, rows)).collect()}
    assert got[9] == "block" and {got[100 + k] for k in range(farms)} == {"block"}
    assert got[201] == "allow" and got[202] == "block" and got[203] == got[204] == "allow"  # a third of a.net is blocked, and nobody links


def pagerank(seeds, edges, rounds=300):
    score = dict(seeds)
    for _ in range(rounds):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for h, s in score.items():
            out = [(d, w) for (c, d), w in edges.items() if c == h] or [(h, 1)]
            for d, w in out:
                new[d] = new.get(d, 0) + 0.85 * s * w / sum(x for _, x in out)
        score = new
    return score


def test_pagerank_by_brute_force(spark):
    edges = {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 2, ("d", "c"): 5, ("c", "e"): 1}
    seeds = {"a": 1.0, "d": 0.5}
    links = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight bigint")
    got = {r["host"]: r["score"] for r in U.spread(spark.createDataFrame(list(seeds.items()), "host string, seed double"), links, 0.85, 1e-7, 12).collect()}
    want = pagerank(seeds, edges)
    assert {h for h, s in want.items() if s > 1e-9} <= got.keys() and all(abs(got[h] - want.get(h, 0)) < 1e-5 for h in got)


def verdicts_by_hand(rows):
    """The verdict of each page without a rule, from links between hosts: what op9 is to give."""
    low = lambda h: "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
    parts = {i: re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "") for i, u, _ in rows}
    place = {i: (low(m[1]), m[2]) if m else ("", "") for i, m in parts.items()}

    def rule(host, path):
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    fit = {i: rule(*p) for i, p in place.items()}
    own, edges = {}, {}
    for i, _, html in rows:
        host = place[i][0]
        if host:
            own.setdefault(host, []).append(fit[i].verdict if fit[i] else None)
            for to in {low(h) for h in re.findall(r"""(?is)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "")} - {host}:
                edges[host, to] = edges.get((host, to), 0) + 1
    seed = {v: {h: x.count(v) / len(x) for h, x in own.items()} for v in ("allow", "block")}
    against = {(b, a): w for (a, b), w in edges.items()}
    got = {}
    for v, links in (("allow", edges), ("block", against)):
        score = pagerank({h: s for h, s in seed[v].items() if s > 0}, links)
        total = {}
        for (a, _), w in links.items():
            total[a] = total.get(a, 0) + w
        got[v] = {}
        for (a, b), w in links.items():
            got[v][b] = got[v].get(b, 0) + score.get(a, 0) * w / total[a]
    out = {}
    for i, (host, path) in place.items():
        verdict = fit[i].verdict if fit[i] else "allow"
        if not fit[i] and host:
            good, bad = got["allow"].get(host, 0), got["block"].get(host, 0)
            trust, distrust = seed["allow"][host], seed["block"][host]
            others = (bad - good) / (bad + good) if bad > good else 0
            verdict = "block" if distrust - trust + (1 - trust - distrust) * others >= 0.5 else "allow"
        out[i] = (host, path, fit[i].name if fit[i] else None, verdict)
    return out


def test_url_query_on_linked_hosts(spark, tmp_path):
    """The registered query on pages that link to other hosts: verdicts by links alone go both ways, and weights count."""
    import random

    rng = random.Random(2)
    names = [f"{n}.{d}" for d in ("com", "net", "org", "info") for n in ("a", "b", "c", "d", "e", "WWW.f")]
    rows = []
    for i in range(300):
        host = rng.choice(names)
        links = "".join(f"<a HREF='https://{rng.choice(names)}/x{k}'>y</a>" for k in range(rng.choice([0, 0, 1, 2, 4])))
        rows.append((i, f"http://{host}/{rng.choice(['es', 'en', 'fr', 'de', ''])}/p{i}?q", rng.choice([links, links + '<a href="/own">z</a>', None])))
    # two.org links once to a blocked host and trusted shop.com often to it; three.org the other way round.
    rows += [(400, "http://bad.net/es/1", ""), (401, "http://two.org/", '<a href="http://bad.net/">x</a>'), (402, "http://three.org/", "")]
    rows += [(410 + k, f"http://shop.com/{k}", '<a href="http://two.org/">x</a>' if k < 9 else '<a href="http://three.org/">x</a>') for k in range(10)]
    rows += [(430 + k, f"http://three.org/{k}", '<a href="http://bad.net/">x</a>') for k in range(9)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in Q.QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()}
    want = verdicts_by_hand(rows)
    assert got == want
    without = {i: v for i, v in want.items() if v[2] is None}
    assert {v[3] for v in without.values()} == {"allow", "block"} and want[401][3] != want[402][3]


def test_urls_odd_rows(spark):
    rows = [(None, "http://a.net/es/", ""), (1, "http://a.net/es/", ""), (1, "http://a.net/es/", ""), (2, "http://" + "x" * 50_000 + ".org/", "<a href='//a.net'>" * 5000)]
    got = [(r["page_id"], r["verdict"]) for r in U.url_filter(pages(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "block"), (1, "block"), (1, "block"), (2, "block")], key=repr)


def test_url_filter_of_nothing(spark):
    assert U.url_filter(pages(spark, [])).count() == 0


def rewrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in re.split(r"\n[ \t\f]*\n", text))


def test_known_texts_at_any_width(spark):
    rows, want, known = [], [], L.by_form()
    for name, _, text in L.KNOWN:
        own = known[L._form(text)]
        for width in range(40, 121, 1 if len(text) < 2500 else 27):
            rows.append((len(rows), rewrapped(text, width)))
            want.append(own)
            if len(text) > 400 and "GNU" not in text and width % 8 == 0:
                rows.append((len(rows), f"Copyright (c) 2019-2021 A. Person\n(c) 2018 Another\n\n{rows[-1][1]}"))
                want.append(want[-1])
    got = {r["doc_id"]: r["license_id"] for r in L.license_scan(frame(spark, rows)).select("doc_id", "license_id").collect()}
    missed = [(i, w, rows[i][1][:200]) for i, w in enumerate(want) if got[i] != w]
    assert len(want) > 4000 and not missed, missed[:3]


def test_license_query_on_entire_texts(spark, tmp_path):
    """The registered query and its SQL over whole texts, notices, odd rows."""
    texts = [t for _, _, t in L.KNOWN] + ["Copyright 2001 X\n" + L._MIT, "The MIT License (MIT)\n\nCopyright (c) 2020 Y\nAll rights reserved.\n\n" + L._MIT, "\n" * 20_000 + "x", None, "", "copyright", "Copyright holders be liable\nfor nothing", "a version\n2 of it"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    n, bad = compare(spark, "op10", Q.QUERIES["op10_license_scan"], Q.SQL["op10_license_scan"], str(tmp_path))
    assert n == len(rows) and not bad, bad[:2]
    got = {r["doc_id"]: r["license_id"] for r in Q.QUERIES["op10_license_scan"](spark, str(tmp_path)).collect()}
    assert all(got[i] for i in range(len(L.KNOWN) + 1))


def test_licences_in_other_dress(spark):
    mit = next(t for n, _, t in L.KNOWN if n == "MIT" and len(t) > 900)
    dressed = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;")
    rows = [(1, dressed), (2, "Some prose.\nLicensed under the Apache Licence, v2.0!\nMore."), (3, "RELEASED UNDER THE MIT LICENSE"), (4, None), (5, ""), (6, "licensed, but not to you"), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License."), (8, "x " * 100_000)]
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notices"]) for r in L.license_scan(frame(spark, rows, "digest notices license_id")).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "Apache-2.0", 1) and got[3] == ("MIT", "MIT", 1)
    assert got[4] == got[5] == got[6] == got[8] == (None, "", 0) and got[7] == (None, "CC-BY-NC-4.0,MIT", 3)
    assert L.license_scan(frame(spark, [])).count() == 0


def test_any_number_of_copyright_lines(spark):
    mit = next(t for n, _, t in L.KNOWN if n == "MIT" and t.startswith("MIT License"))
    title, body = mit.split("\n", 1)
    heads = [*range(1, 41), 5000]
    rows = [(n, title + "\n\n" + "".join(f"Copyright (c) {1980 + k % 40} Person {k}\n" for k in range(n)) + body) for n in heads]
    wrapped = [(10_000 + n, "".join(f"(c) {2000 + k} A Person of a long name,\nand of a longer one\n\n" for k in range(n)) + body) for n in (1, 12, 300)]
    odd = [(20_000, "!" * 300_000 + "\nx"), (20_001, "license " * 50_000), (20_002, "a" * 100_000 + " license\nCopyright 2020 X\n" + body)]
    got = {r["doc_id"]: r["license_id"] for r in L.license_scan(frame(spark, rows + wrapped + odd)).select("doc_id", "license_id").collect()}
    assert all(got[i] == "MIT" for i, _ in rows + wrapped)
    assert got[20_000] is None and got[20_001] is None and got[20_002] is None


def test_running_sums_of_any_length(spark):
    from pyspark.sql import functions as F

    from vexel.llm import chat_format as C

    sizes = [[], [3], list(range(128)), list(range(129)), [(k * 37) % 11 for k in range(40_001)]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s array<int>")
    for r in rows.select("i", C.running(F.col("s"), 4).alias("few"), C.running(F.col("s")).alias("many")).collect():
        want, total = [], 0
        for x in sizes[r["i"]]:
            want.append(total)
            total += x
        assert r["few"] == want and r["many"] == want


def test_chat_of_many_turns_takes_time_in_proportion(spark):
    import time

    from pyspark.sql import functions as F

    from vexel.llm import chat_format as C

    spent = {}
    for count in (1_000, 20_000, 80_000):
        turns = spark.range(count).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("says "), F.col("id").cast("string")).alias("text"))
        began = time.time()
        out = C.chat_format(turns).select(C.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(C.read_turns(F.col("formatted"))).alias("n")).first()
        spent[count] = time.time() - began
        assert out["n"] == count and out["loss"] == "".join(f"says {k}" for k in range(1, count, 2))
    print(spent)
    assert spent[80_000] < 8 * max(spent[20_000], 1.0)
