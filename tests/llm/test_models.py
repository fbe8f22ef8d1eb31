"""MinHash dedup, class language model, fingerprints, SentencePiece, packing, language identification, pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import frame
from vexel.llm import class_lm as C
from vexel.llm import components as K
from vexel.llm import fingerprint as P
from vexel.llm import language_id as I
from vexel.llm import minhash_dedup as M
from vexel.llm import packing as B
from vexel.llm import queries as Q
from vexel.llm import sentencepiece_codec as S
from vexel.llm import text_hash

SF = "/root/testdata/sf0.001"
MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(text_hash.LOWER.tolist())))


def shingle_set(text, width=5):
    w = split(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def linked_by_hand(rows, numerator=85, denominator=100):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and denominator * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_word_and_shingle_hashes(words):
    raw = [(w or "").encode() for w in words] + [b"A b", b"a\tB ", "é É".encode()]
    seen = {}
    hashes, firsts, starts, ends = text_hash.words(raw)
    joined = b" ".join(raw).translate(bytes(text_hash.LOWER.tolist()))
    for h, a, b in zip(hashes.tolist(), starts.tolist(), ends.tolist()):
        assert seen.setdefault(h, joined[a:b]) == joined[a:b]
    assert len(set(seen.values())) == len(seen)
    found, bounds = text_hash.shingles(hashes, firsts, 5)
    for i, text in enumerate(raw):
        assert len(np.unique(found[bounds[i] : bounds[i + 1]])) == len(shingle_set(text.decode()))
    assert text_hash.words([])[0].size == 0 and text_hash.words([b""])[0].size == 0


def test_minhash_components_by_brute_force(spark, words):
    rows = list(enumerate(words))
    got = M.minhash_dedup(frame(spark, rows, "component_id node fp")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked_by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_of_near_copies_in_one_bucket(spark):
    """Neighbours are linked, the ends are not: the rounds must find the links that the first chosen one has no part in."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(base)))
        for j in range(2):
            base[(k * 7 + j * 53) % 120] = f"n{k}-{j}"
    got = {r["doc_id"]: r["component_id"] for r in M.minhash_dedup(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in linked_by_hand(rows).items()}


def test_minhash_edges_of_the_input(spark):
    assert M.minhash_dedup(frame(spark, [])).count() == 0
    rows = [(5, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (9, None), (8, ""), (None, "a b c d e f"), (7, "z"), (6, "z")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.minhash_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (9, 0, 9, True), (8, 0, 8, True), (None, 2, None, False), (7, 1, 6, False), (6, 1, 6, True)], key=repr)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8, 0.95):
        bits = []
        for _ in range(60):
            common = int(400 * 2 * similarity / (1 + similarity))
            x = text_hash.mix(rng.integers(0, 1 << 63, 800 - common, np.uint64))
            a, b = np.sort(x[:400]), np.sort(np.concatenate([x[:common], x[400:]]))
            bits.append(sum(int(v).bit_count() for v in (M.odd_sketch(M.minhashes(a)) ^ M.odd_sketch(M.minhashes(b))).view(np.uint64)))
        assert abs(np.mean(bits) - M.most_odd_bits(similarity)) < 5


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, i) for i in range(201, 230)]
    got = {r["node"]: r["component"] for r in K.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 230)}
    assert K.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def scores_by_hand(model, rows, train):
    """Word by word from the model's tables: P(class | class before) * P(word | class), mixed with single words."""
    out, w = {}, model.words
    place = {h: k for k, h in enumerate(w.hashes.tolist())}
    for i, text in rows:
        before, total = C.END, 0.0
        for word in [*split(text), None]:
            if word is None:
                item, n = C.END, model.ends
            else:
                hashes, tail, _ = C._tokens([word])
                k = place.get(int(hashes[0]))
                item = int(w.items[k]) if k is not None and w.items[k] else 1 + w.own + int(C._group(tail, w.groups)[0])
                n = train[word]
            a, b = model.of[before], model.of[item]
            p = model.settings.mixed * model.transition[a, b] * (n + 1) * model.emit[b] + (1 - model.settings.mixed) * (n + 1) / (model.tokens + model.vocabulary + 1)
            total, before = total + math.log10(p), item
        out.setdefault(i, total)
    return out


def test_class_model_by_brute_force(spark, words):
    """Counts, base scores and scores of all rows; probabilities of all words and the unknown one come to 1."""
    rows = [*enumerate(words), (3, words[3]), (500, "new words never seen before"), (501, "aa " * 21_000)]
    small = C.Settings(least=6, groups=8, classes=5, head=20, table=60)  # most words then go through the join
    docs = frame(spark, rows, "row known score")
    got = {r["doc_id"]: r for r in C.class_lm(docs, small).collect()}
    learnt = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    train = Counter(w for _, t in learnt for w in [*split(t), "END"])
    n = sum(train.values())
    model, _ = C.fit(docs.filter(F.col("doc_id").isin([i for i, _ in learnt])).select("text"), small)
    want = scores_by_hand(model, rows, train)
    for i, t in rows:
        r, own = got[i], [*split(t), "END"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(train[w] > 0 for w in own), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + len(train) + 1)) for w in own))
        assert r["score"] == pytest.approx(want[i], rel=1e-9)
    assert np.allclose(model.transition.sum(axis=1), 1)
    emitted = Counter()
    for word, k in train.items():
        if word != "END":
            hashes, tail, _ = C._tokens([word])
            emitted[int(model.of[model.words.look_up(hashes, tail)[0][0]])] += (k + 1) * model.emit[model.of[model.words.look_up(hashes, tail)[0][0]]]
    emitted[int(model.of[C.END])] += (model.ends + 1) * model.emit[model.of[C.END]]
    for c, p in emitted.items():  # what is left is the unknown word's
        assert p + model.emit[c] == pytest.approx(1)


def test_class_model_beats_single_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = C.class_lm(docs).filter("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("own")).first()
    assert got["own"] > got["base"]
    assert C.class_lm(frame(spark, [])).count() == 0
    assert C.class_lm(frame(spark, [(1, None), (None, "a")])).count() == 2


def test_distinct_words_are_hashed_once(monkeypatch):
    texts, seen, words = [b"Ab ab\x0bc", b"", b" \n", b"c ab \xc3\x89\xc3\xa9 " * 50], [], text_hash.words
    expected = C._tokens(texts)
    monkeypatch.setattr(text_hash, "words", lambda own: (seen.append(b" ".join(own).split()), words(own))[1])
    hashes, tail, number, firsts = C._numbered_tokens(texts)
    assert sorted(seen[0]) == [b"ab", b"c", b"\xc3\x89\xc3\xa9"]
    assert all((x == y).all() for x, y in zip((hashes[number], tail[number], firsts), expected))
    assert C._numbered_tokens([b"", b" "])[3].tolist() == [0, 0, 0]


@pytest.mark.parametrize("classes,rows", [(5, 700), (40, 333)])
def test_joining_by_every_cell(classes, rows, monkeypatch):
    rng = np.random.default_rng(classes)
    counts = (rng.geometric(0.4, (rows, 2 * classes)) - 1).astype(float)
    table = rng.integers(0, 90, (classes, classes)).astype(float)
    expected = np.zeros((rows, classes))
    for part, cells in ((counts[:, :classes], table.T), (counts[:, classes:], table)):
        tokens = cells.sum(axis=0)
        expected += (C._xlogx(cells + part[:, :, None]) - C._xlogx(cells)).sum(axis=1) - C._xlogx(tokens + part.sum(axis=1)[:, None]) + C._xlogx(tokens)
    gathered, nonzero = [], np.nonzero
    monkeypatch.setattr(C.np, "nonzero", lambda x: gathered.append(nonzero(x)) or gathered[-1])
    np.testing.assert_allclose(C._joining(counts, table), expected, rtol=0, atol=1e-9)
    assert sum(len(x[0]) for x in gathered if len(x) == 2) == (counts > 3).sum()  # frequent counts need no row of changes for each cell


def test_rounds_over_all_items_raise_the_likelihood(spark):
    """Items of two kinds that follow each other in turn: rounds find kinds that the head does not hold."""
    rng = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "xyz"]
    texts = [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(40))) for i in range(150)]
    model, _ = C.fit(frame(spark, texts).select("text"), C.Settings(least=3, groups=4, classes=4, head=30))
    word = {}
    for k, own in enumerate(kinds):
        for w in own:
            hashes, tail, _ = C._tokens([w.encode()])
            word[w] = int(model.of[model.words.look_up(hashes, tail)[0][0]])
    for own in kinds:
        top = Counter(word[w] for w in own).most_common(1)[0][1]
        assert top >= 57


def test_exchange_ends_where_no_move_helps():
    x = np.random.default_rng(0).integers(0, 9, (12, 12)).astype(float)

    def likelihood(of):
        one = np.eye(int(of.max()) + 1)[of]
        t = one.T @ x @ one
        e = lambda v: np.sum(v[v > 0] * np.log(v[v > 0]))
        return e(t) - e(t.sum(axis=0)) - e(t.sum(axis=1))

    of = C.exchange(x, 4, 50)
    best = likelihood(of)
    for w in range(1, 12):
        for k in range(1, 4):
            other = of.copy()
            other[w] = k
            assert likelihood(other) <= best + 1e-6


def fingerprints_by_hand(rows):
    ids = sorted(rows, reverse=True)
    out = {}
    for k, i in enumerate(ids):
        text, after = rows[i] or "", rows[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("per_range", [3, 50, 10_000])
def test_fingerprints_and_the_next_document(spark, words, per_range, monkeypatch):
    rows = {i * 3 - 100: t for i, t in enumerate(words)}
    near = P.with_next.__defaults__
    monkeypatch.setattr(P.with_next, "__defaults__", (per_range, *near[1:]))
    got = {r["doc_id"]: r for r in P.fingerprint_stability(frame(spark, list(rows.items()), "key range guest")).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == fingerprints_by_hand(rows)
    by_text = {}
    for i, t in rows.items():
        assert by_text.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1


def test_fingerprint_single_empty_and_merge(spark):
    assert P.fingerprint_stability(frame(spark, [])).count() == 0
    r = P.fingerprint_stability(frame(spark, [(4, "one two three four five six")])).first()
    assert r["near_next"] == 1
    one, two = [f"a{i}" for i in range(3000)], [f"b{i}" for i in range(300)]
    a, b, both = P.sketches([" ".join(one), " ".join(two), " ".join([*one, *two])])
    assert b.containment(both) > 0.95 and both.containment(b) < 0.2 and a.resemblance(b) == 0
    assert len(np.setxor1d(a.merge(b).values, both.values)) < 10  # only shingles across the seam
    for s in (a, b, *P.sketches(["", "tiny", "A few words only"])):
        assert str(P.Sketch.parse(str(s))) == str(s)


def values_by_hand(text):
    """The retained values of a text, from the hashes of single shingles."""
    own = set()
    for shingle in shingle_set(text):
        hashes, firsts, _, _ = text_hash.words([b" ".join(shingle)])
        own.add(int(text_hash.shingles(hashes, firsts, 5)[0][0]))
    return {h >> 14 for h in own if h < 1 << 62}, min(own, default=0)


def test_fingerprint_query_by_brute_force(spark, words, tmp_path):
    rows = [(i, t) for i, t in enumerate(words[:110])] + [(200, None), (201, "  "), (202, " ".join(f"w{i % 977}" for i in range(21_000)))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in Q.QUERIES["op4_fingerprint"](spark, str(tmp_path)).collect()}
    ids = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    near = lambda x, y: len(x[0] & y[0]) / len(x[0]) if x[0] else float(x[1] == y[1])
    for k, i in enumerate(ids):
        own, after = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        mine, new, following = values_by_hand(own), values_by_hand(own[: len(own) - half] + after[:half]), values_by_hand(after)
        assert set(P.Sketch.parse(got[i]["fingerprint"]).values.tolist()) == mine[0]
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((near(mine, new), near(mine, following)))


def test_stored_fingerprints_merge_and_contain(spark, words):
    texts = [w or "" for w in words]
    docs = frame(spark, list(enumerate(texts)))
    prints = P.fingerprints(docs).withColumn("half", F.col("doc_id") % 2)
    merged = {r["half"]: P.Sketch.parse(r["fingerprint"]) for r in P.merge(prints, "half").collect()}
    for half in (0, 1):
        own = P.sketches(texts[half::2])
        want = own[0]
        for s in own[1:]:
            want = want.merge(s)
        assert str(merged[half]) == str(want)
    pairs = prints.alias("a").join(P.merge(prints, "half").withColumnRenamed("fingerprint", "all").alias("b"), "half")
    assert pairs.select(P.containment(F.col("fingerprint"), F.col("all")).alias("c"), "fingerprint").filter("length(fingerprint) > 19 and c < 1").count() == 0
    assert P.merge(P.fingerprints(frame(spark, [])).withColumn("g", F.lit(1)), "g").count() == 0


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_fingerprints_of_string_ids_repeated_rows(spark, words, per_range, monkeypatch):
    near = P.with_next.__defaults__
    monkeypatch.setattr(P.with_next, "__defaults__", (per_range, *near[1:]))
    rows = {i * 3 + 100: t for i, t in enumerate(words[:60])}
    docs = frame(spark, list(rows.items())).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = {int(r["doc_id"]): (r["n_chars"], r["edited_sha256"]) for r in P.fingerprint_stability(docs).collect()}
    assert got == fingerprints_by_hand(rows)
    twice = P.fingerprint_stability(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "z")])).collect()
    assert sorted(r["n_chars"] for r in twice) == [1, 5, 5]


ODD = ["▁", "▁▁a", " a", "a ", "  ", "a\n\n b", "\x00a\x00", "<s></s><unk> <0x0A>", "é", "日本語 テキスト 😀👩‍👩‍👧", "a▁b ▁ c", "　x y", "ﬁ", " " * 40 + "x" + " " * 17, "", None, "J̌ x", "<|endoftext|> A<|EndOfText|>B", "don't CAN'T we'll", "a\x1cb\x85c", "İstanbul ΑΣ", "x!!!y,,z  1234", "É" * 3000]


def test_sentencepiece_equals_the_library(spark, words):
    texts = [*words, *ODD]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = S.encode(frame(spark, list(enumerate(texts)), "ids starts ends"), MODEL)
    for r in got.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(r["starts"], r["ends"])) == raw  # the spans tile the text
    back = {r["doc_id"]: r["text"] for r in S.decode(got, MODEL).collect()}
    assert back == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}
    assert S.encode(frame(spark, []), MODEL).count() == 0


def test_own_merges_equal_the_library(words):
    own, library = S.Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCE  .,-'\"()0123456789\n\täöüßéèçñ日本"
    texts = [*words[:60], *ODD, *("".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(500)), "y " * 20_000, "n" * 5000]
    for text, (ids, _) in zip(texts, own.encode_all([t or "" for t in texts])):
        assert ids.tolist() == library.encode(text or "")
    small = S.Codec(MODEL, max_bytes=20_000)  # remembers next to nothing
    for text in texts:
        assert small.encode(text or "")[0].tolist() == library.encode(text or "")


@pytest.mark.parametrize("whole", [False, True])
def test_distinct_segments_are_looked_up_once(whole, monkeypatch):
    own, asked = S.Codec(MODEL), []
    own.cut &= not whole
    rng = random.Random(5)
    texts = ["".join(rng.choices(" \n\r\tab▁éß日🙂.", k=rng.randrange(12))) for _ in range(400)] + ["", " ", "  a ", "▁ ▁", "\n\n a\t", "a b a b a b"]
    forms = [S.normalise(t.encode(), own.charmap, own.dummy_prefix, own.squeeze)[0] for t in texts]
    data, ends, number, firsts = own._cut(forms)
    found = [data[a:b].tobytes().decode().replace(" ", S.SPACE) for a, b in zip(ends, ends[1:])]
    for form, a, b in zip(forms, firsts, firsts[1:]):
        assert [found[k] for k in number[a:b]] == ([form.decode()] if whole and form else own.segments.findall(form.decode()))
    many = own.recent.many
    monkeypatch.setattr(own.recent, "many", lambda keys, learn: (asked.append(keys), many(keys, learn))[1])
    for text, (ids, _) in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == own.library.encode(text)
        assert own.listed(ids).decode() == ",".join(map(str, ids.tolist()))
    assert len(asked[0]) == len(set(asked[0])) == len(set(found))


def test_character_map_equals_the_library():
    """The longest-prefix lookup in a compiled map, with a source for every byte."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for k, v in S.fields(library.serialized_model_proto()) if k == 3)
    charmap = S.CharacterMap(dict(S.fields(spec))[2])
    for text in ["ＡＢＣ①ﬁ ㌀", "e\u0301 é", "a\u3000b\tc", "½ … ™", "カ\u3099", "plain text", "한글 각"]:
        form, source = S.normalise(text.encode(), charmap, False, False)
        assert form.decode().replace("▁", " ").strip() == library.normalize(text).replace("▁", " ").strip()
        assert len(source) == len(form) + 1 and (np.diff(source) >= 0).all() and source[-1] == len(text.encode())


def test_packing_ids_and_places(spark, words):
    texts = [*words, *ODD, "word " * 7000]
    library = Tokenizer.from_file(VOCABULARY)
    got = B.pack_documents(frame(spark, list(enumerate(texts)), "piece length offset"), VOCABULARY, 64).toPandas()
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        cuts = range(0, len(ids), 64)
        assert own.piece.tolist() == list(range(len(cuts))) and own.start.tolist() == list(cuts)
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()) for s in cuts]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 64
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 64) * 1.05 + 1
    assert B.pack_documents(frame(spark, []), VOCABULARY).count() == 0


def test_packed_sequences_hold_every_id(spark, words):
    texts = [*words[:40], *ODD, "word " * 700]
    library = Tokenizer.from_file(VOCABULARY)
    docs = frame(spark, [*enumerate(texts), (3, texts[3]), (None, "no number")], "ids offset length")
    got = B.packed_sequences(docs, VOCABULARY, 64).collect()
    want = sorted(str([*library.encode(t or "", add_special_tokens=False).ids, 0]) for t in [*texts, texts[3], "no number"])
    parts: dict = {}
    for r in got:
        assert len(r["ids"]) <= 64 and sum(p["length"] for p in r["pieces"]) == len(r["ids"])
        assert [p["offset"] for p in r["pieces"]] == [sum(q["length"] for q in r["pieces"][:k]) for k in range(len(r["pieces"]))]
        for p in r["pieces"]:
            parts.setdefault((p["doc_id"], p["piece"]), []).append(r["ids"][p["offset"] : p["offset"] + p["length"]])
    assert len(parts[3, 0]) == 2 and parts[3, 0][0] == parts[3, 0][1]
    made = [sum((parts[i, k][copy] for k in range(99) if (i, k) in parts), []) for i in [*range(len(texts)), None] for copy in range(2 if i == 3 else 1)]
    assert sorted(map(str, made)) == want
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert B.packed_sequences(frame(spark, []), VOCABULARY).count() == 0


def test_words_are_encoded_once_and_as_the_library_does():
    class Counted(B.Recent):
        asked = 0

        def many(self, keys, learn):
            self.asked += len(keys)
            return super().many(keys, learn)

    rng, letters = random.Random(7), "abcxyzABZäßçÿŠſ\u00ad¡÷0129.,-'&*</|"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(30)) for _ in range(60)]
    texts += ["", " \n", "it's we'll <|endoftext|> <| x", "日本 e\u0301 İx Ǆ κόσμος\x0b\x1cA\u0327", "the cat " * 500]
    own, library = B.WordEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    own.recent = Counted(20_000)
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    own.recent.asked = 0
    own.encode(["the cat the " * 100] * 3)
    assert own.recent.asked == 2  # each distinct word is looked up once
    assert own.encode([]) == []


def test_memory_of_recent_values_is_bounded():
    own = B.Recent(4000, entry=100)
    size = lambda held: sum(100 + len(k) + len(v) for k, v in held.items())
    for at in range(0, 1000, 10):
        assert own.many([b"%03d" % k for k in range(at, at + 10)] * 2, lambda new: [k * 2 for k in new]) == [b"%03d" % k * 2 for k in range(at, at + 10)] * 2
        assert size(own.young) <= 2000 and size(own.old) <= 2000 and own.size == size(own.young)


def test_packing_of_more_long_pieces_than_open_bins(spark):
    rng = random.Random(8)
    lengths = [rng.randint(1025, 1500) for _ in range(6000)] + [rng.randint(100, 900) for _ in range(9000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = B.pack(pieces).toPandas()
    assert sorted(got.doc_id) == list(range(len(lengths))) and got.groupby("sequence_id").length.sum().max() <= 2048
    sorted_free = max(B.best_fit(sorted(lengths, reverse=True), 2048, len(lengths))[0]) + 1
    assert got.sequence_id.nunique() <= sorted_free * 1.002 + 1


def test_best_fit_by_brute_force():
    rng = random.Random(3)
    for limit in (1, 2, 5, 1000):
        items = [rng.randint(1, 20) for _ in range(200)]
        bins, offsets = B.best_fit(items, 20, limit)
        free, opened = {}, 0
        for n, at, off in zip(items, bins, offsets):
            fits = [f for f in free.values() if f >= n]
            if fits:
                assert free[at] == min(fits)
            else:
                if len(free) >= limit:
                    least = min(free.values())
                    gone = {k for k, f in free.items() if f == least}
                    free.pop(next(k for k in gone if k not in bins[opened + 1 :]) if len(gone) > 1 and any(k not in bins[opened + 1 :] for k in gone) else gone.pop())
                free[at] = 20
            assert off == 20 - free[at]
            free[at] -= n
            if not free[at]:
                del free[at]
            opened += 1


def phrases_by_hand(text, sample):
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + max(size, 1), n + 1
    return n


@pytest.mark.parametrize("lane", [2, 7, 64, 512])
def test_language_phrases_by_brute_force(lane, monkeypatch):
    """Lanes of any width, also such as phrases do not fit in, give the parse of the whole text."""
    monkeypatch.setattr(I, "LANE", lane)
    rng = random.Random(1)
    sample = "".join(rng.choice("abc") for _ in range(200))
    alphabet = I.Alphabet(np.array([97, 98, 99], np.uint32), np.zeros(0, np.uint32))
    model = I.Model(["x"], alphabet, [I.automaton(alphabet.coded(sample), 5)], [200])
    texts = [" ".join("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))).split()) for _ in range(60)]
    texts.append(" ".join("".join(rng.choice("abcd") for _ in range(5)) for _ in range(25_000)))  # over 20,000 words
    assert model.phrases(texts)[:, 0].tolist() == [phrases_by_hand(t, sample) for t in texts]


def test_letters_beyond_the_single_symbols_stay_apart():
    alphabet = I.choose_alphabet(["aaaa bbb", "".join(chr(0x4E00 + i) for i in range(300)) + "жж"], 4)
    codes = {c: tuple(alphabet.coded(c).tolist()) for c in ["a", "b", *(chr(0x4E00 + i) for i in range(300)), "ж", "q", "1"]}
    assert len(set(codes.values())) == len(codes) and codes["q"] == (0,) and codes["1"] == (1,)
    mixed = "a" + chr(0x4E05) + " " + chr(0x4E07)
    assert alphabet.coded(mixed).tolist() == [*codes["a"], *codes[chr(0x4E05)], 1, *codes[chr(0x4E07)]]


def test_language_query_by_brute_force(spark, tmp_path):
    """The registered query over one text of each language, so that the order of the samples cannot matter."""
    rng = random.Random(4)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(30)] for k, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "efghi"))}
    rows, learnt = [], {}
    for i in range(90):
        lang = "abc"[i % 3] * 2
        train = zlib.crc32(str(i).encode()) % 4 != 2
        text = " ".join(rng.choices(vocabulary[lang], k=rng.choice([1, 3, 40])))
        if train and lang not in learnt:
            learnt[lang] = text = " ".join(rng.choices(vocabulary[lang], k=200))
            rows.append((i, text, lang))
        else:
            rows.append((i, text, None if train else lang))
    rows += [(200, "", None), (201, None, None), (202, "12 3", None), (203, rows[0][1], None), (203, rows[0][1], None), (204, " ".join(rng.choices(vocabulary["bb"], k=21_000)), None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op8_language_id"](spark, str(tmp_path)).collect()
    text_of = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        text = text_of[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cost = sorted((phrases_by_hand(text, own) * math.log2(len(own)), k) for k, own in learnt.items())
        assert r["lang_pred"] == cost[0][1] and r["score"] == pytest.approx(cost[1][0] / (cost[0][0] + cost[1][0]))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = I.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and length(text) > 40")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_edges_of_the_input(spark):
    docs = frame(spark, [(0, "der und die", "de"), (1, "the and of", "en"), (4, "und der", "de"), (5, None, "de"), (6, "123 !!", "en"), (7, "the of", None), (8, "", "en"), (None, "the", "en")], "lang_pred score held_out")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in I.language_id(docs).collect()}
    assert got[5] == got[6] == got[8] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    kept = I.drop_unidentified(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "4", "7", "None"]
    assert I.language_id(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in I.language_id(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_pipeline_by_brute_force(spark, words, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(words)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    alive = {i: t for i, t, _ in rows if t and any(map(str.isalpha, t))}
    best = {}
    for i, t in alive.items():
        form = re.sub("[\x20\x09-\x0d]", "", t)
        best[form] = min(best.get(form, (0, i)), (-len(t), i))
    alive = {i: alive[i] for _, i in best.values()}
    kept = {i for i, (_, c) in linked_by_hand(list(alive.items()), 80, 100).items() if i == c}
    assert set(got.doc_id) == kept
    library = Tokenizer.from_file(VOCABULARY)
    assert got.length.sum() == sum(len(library.encode(alive[i], add_special_tokens=False).ids) + 1 for i in kept)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_drop_near_copies_by_row(spark):
    """Repeated and null ids, equal rows and a unique text whose id also stands on a copy."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "end"])
    text = " ".join(base)
    rows = [(3, text), (7, near), (7, "something else of seven words in all"), (3, text), (None, near), (None, "one of a kind"), (8, ""), (8, None), (9, "tiny"), (10, "tiny"), (2, text + " " + " ".join(f"x{i}" for i in range(30)))]
    docs = frame(spark, rows, "kept component_id")
    out = M.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(3, text), (7, rows[2][1]), (None, "one of a kind"), (8, ""), (8, None), (9, "tiny"), (2, rows[-1][1])], key=repr)


@pytest.mark.parametrize("rows", [[], [(1, "the end of it all", "en"), (1, "the end of it all", "en"), (None, "the end of it all", "en"), (None, None, None), (2, "", "en"), (3, "1 2 3", "en"), (4, "word " * 30_000, "en")]])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    frame(spark, rows, "kept piece offset _row text_sha256").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == ({1, 4} if rows else set())
    if rows:
        assert sum(r["length"] for r in got if r["doc_id"] == 4) == 30_001 and sum(r["piece"] == 0 for r in got) == 2


def test_registry_has_all_ten():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("hot", [1, 20, 10_000])
def test_near_dedup_with_keys_shuffled_split_and_broadcast(spark, words, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT", hot)
    rng = random.Random(hot)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(words)) + [(500 + k, " ".join(base[:k % 3] + [f"x{k}"] + base[k % 3 + 1 :])) for k in range(40)]  # one bucket of many
    rows += [(700, "long " + " ".join(f"v{i}" for i in range(150_000))), (701, "longer " + " ".join(f"v{i}" for i in range(150_000)))]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.minhash_dedup(frame(spark, rows)).collect()}
    want = linked_by_hand(rows)
    assert {i: (n, c) for i, (n, c) in got.items() if n} == {i: x for i, x in want.items() if x[0]}


def test_near_dedup_refuses_thresholds_it_cannot_hold(spark):
    with pytest.raises(ValueError, match="below the 0.8"):
        M.minhash_dedup(frame(spark, [(1, "a b c d e f")]), 79, 100)
