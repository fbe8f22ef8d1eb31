"""Token sequences packed by bounded-space best-fit."""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held_by, pick, stored
from .text_hash import chunks, distinct_words, strung


_id = attrgetter("id")


class WordEncoder:
    """Ids of the tokenizers library, put together from remembered words.

    The vocabulary's pre-tokenizer never joins across white space, so text is cut at ASCII white space, a word is looked
    up once for some MB of text, and one that was met lately needs no encoding (`Recent`; its bytes are bounded for each
    worker). New words are cut at the pre-tokenizer's own pattern, and their parts go to the library's model alone, with
    bytes written as signs as the pre-tokenizer does it. A-Z are lowered before the lookup, as the normaliser does it
    anyway, except where that could change a result.
    Words of other scripts than Latin, and such that may hold a special token, go whole. All this holds for a
    vocabulary file whose normaliser, pre-tokenizer and model say so (`_cuts_at_white_space`); with any other file whole
    texts go through the library.
    """

    #: Fixed value: the pattern of the vocabulary's pre-tokenizer.
    _pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _unsafe = re.compile("[A-Z](?=[^\x00-\u02ff])")
    _latin = re.compile("[\x20-\x3b\x3d-\x7e\xa1-\u017f]+")
    def __init__(self, path: str, max_bytes: int = 160_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.recent = Recent(max_bytes)
        self.parts = regex.compile(self._pattern)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = self._cuts_at_white_space(spec)
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_word &= all(s.startswith("<|") for s in specials)
        self.tokenize = self.library.model.tokenize
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        #: Fixed value: the sign of each byte in the "ByteLevel" pre-tokenizer.
        self.signs = "".join(chr(b if b in plain else next(others)) for b in range(256))

    @classmethod
    def _cuts_at_white_space(cls, spec: dict) -> bool:
        """Whether the file's own rules are those that remembered words rely on."""
        normaliser, cutter, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        steps = [x.get("type") for x in normaliser.get("normalizers", [])]
        cuts = cutter.get("pretokenizers", [])
        first = cuts[0] if cuts else {}
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
            and (first.get("pattern") or {}).get("Regex") == cls._pattern
            and first.get("behavior") == "Removed"
            and bool(first.get("invert"))
            and not cuts[1].get("add_prefix_space")
            and model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not model.get("dropout")
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some words, parted by no white space."""
        if not words:
            return []
        forms = unicodedata.normalize("NFC", b" ".join(words).decode()).lower()
        latin = self._latin.fullmatch(forms) is not None and "<|" not in forms
        ids: list[int] = []
        ends = [0]
        signs: dict[str, list[int]] = {}  # the ids of parts that are no letters: few, and met again and again
        for word, form in zip(words, forms.split(" ")):
            if not latin and ("<|" in form or not self._latin.fullmatch(form)):
                ids += self.library.encode(word.decode(), add_special_tokens=False).ids
            elif form.isalpha():
                ids += self._of_part(form)
            else:
                for part in self.parts.findall(form):
                    if part.isalpha():
                        ids += self._of_part(part)
                    else:
                        known = signs.get(part)
                        if known is None:
                            known = signs[part] = self._of_part(part)
                        ids += known
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _of_part(self, part: str) -> list[int]:
        """The ids of what the normaliser and the pre-tokenizer leave whole."""
        return list(map(_id, self.tokenize(part if part.isascii() else charmap_decode(part.encode(), "strict", self.signs)[0])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        raws = []
        for text in texts:
            raw = text.encode()
            raws.append(raw.lower() if "<|" not in text and (raw.isascii() or not self._unsafe.search(text)) else raw)
        data, ends, number, firsts = distinct_words(raws)
        raw, cuts = data.tobytes(), ends.tolist()
        ids, offsets = strung(self.recent.many([raw[a:b] for a, b in zip(cuts, cuts[1:])], self._learn), number)
        raw, cuts = ids.tobytes(), (4 * offsets[firsts]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and `end_id`, cut into pieces of `size` if longer.

    A null or empty text is the end id alone. No row is shuffled.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held_by("packing", tokenizer_path, lambda: WordEncoder(tokenizer_path))
        collecting = gc.isenabled()
        gc.disable()  # lists of words are long and hold no cycles
        try:
            for batch in batches:
                yield cut(batch, own)
        finally:
            if collecting:
                gc.enable()

    def cut(batch: pd.DataFrame, own: WordEncoder) -> pd.DataFrame:
        at, out = [], []
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        encoded = (ids for a, b in chunks(texts, 1 << 21) for ids in own.encode(texts[a:b]))
        for i, ids in enumerate(encoded):
            ids += end
            for k, start in enumerate(range(0, len(ids), 4 * size)):
                piece = ids[start : start + 4 * size]
                at.append(i)
                out.append((k, start // 4, len(piece) // 4, zlib.crc32(piece), *([np.frombuffer(piece, "<u4").astype(np.int32)] if with_ids else [])))
        frame = pd.DataFrame(out, columns=names[1:])
        frame.insert(0, "doc_id", batch["doc_id"].array[at])
        return frame

    return rows.mapInPandas(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item in turn.

    An item goes to the open bin with the least free space that holds it. `room` has a bit for each free space that
    some open bin has, so that bin is the lowest set bit from the item's length on. With `open_bins` open and none
    that fits, the fullest of them closes.
    """
    room, with_room, count, made = 0, [[] for _ in range(size + 1)], 0, 0
    bins, offsets = [], []
    for n in lengths:
        fits = room >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = with_room[space].pop()
            if not with_room[space]:
                room ^= 1 << space
        else:
            if count >= open_bins:
                full = (room & -room).bit_length() - 1
                with_room[full].pop()
                if not with_room[full]:
                    room ^= 1 << full
                count -= 1
            at, space, made, count = made, size, made + 1, count + 1
        bins.append(at)
        offsets.append(size - space)
        if space > n:
            with_room[space - n].append(at)
            room |= 1 << (space - n)
        else:
            count -= 1
    return bins, offsets


def mixed_order(rows: int, open_bins: int) -> np.ndarray:
    """Positions of `rows` sorted items, dealt in turn into parts of at most half of `open_bins`, one part after the other.

    Each part is sorted and has the lengths of the whole. A part opens no more bins than it has items, so long items
    never take all open bins before short ones arrive.
    """
    parts = max(1, -(-rows // max(1, open_bins // 2)))
    return np.concatenate([np.arange(k, rows, parts) for k in range(parts)])


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = 4096, group_rows: int = 100_000) -> DataFrame:
    """The columns of `pieces` with sequence_id and offset: pieces of at most `size` tokens share sequences.

    `pieces` (doc_id, piece, start, length, ids_crc32 and any more columns) is a stored table. Its rows are dealt by a
    hash of their number into groups of about `group_rows`, so that equal rows part too, and each group goes through
    best-fit with `open_bins` open bins in the order of `mixed_order`. Groups are independent, so the work grows evenly,
    and each leaves at most its last few bins unfilled. Order is fixed by length, doc_id (null last), piece, digest and
    row number: a task that is run again deals the same. An empty table gives an empty one.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id bigint, offset bigint"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32", "_row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        frame = frame.iloc[mixed_order(len(frame), open_bins)].reset_index(drop=True)
        bins, offsets = best_fit(frame["length"].tolist(), size, open_bins)
        frame["sequence_id"] = np.array(bins, np.int64) + (int(frame["_group"].iloc[0]) << 32)
        frame["offset"] = np.array(offsets, np.int64)
        return frame.drop(columns=["_group", "_row"])

    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than `size` tokens are cut. Null and empty texts are one end id. Repeated rows are
    packed as often as they stand there; rows of null ids are packed like any other. An empty table gives an empty one.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, size, id_col=id_col, text_col=text_col), "pieces")
    out = pack(pieces, size)
    out.scratch = [pieces]
    return out


def packed_sequences(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training rows themselves: sequence_id, ids (array of at most `size` token ids), pieces (array of doc_id, piece, offset, length).

    The places are those of `pack_documents`. Only lengths and digests go through best-fit; token ids stay in the stored
    pieces and meet their places by the number of their row, each once, and a sequence's pieces are gathered by sequence_id,
    which `size` bounds. `scratch` of the result has the tables that it reads.
    """
    pieces = token_pieces(docs, tokenizer_path, size, with_ids=True, id_col=id_col, text_col=text_col)
    pieces = stored(pieces.withColumn("_number", F.monotonically_increasing_id()), "pieces-ids")
    places = pack(pieces.drop("ids"), size).select("_number", "sequence_id", "offset")
    there = pieces.select("_number", "doc_id", "piece", "length", "ids").join(places, "_number")
    whole = there.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "_number", "doc_id", "piece", "length", "ids"))).alias("p"))
    pieces_of = F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    out = whole.select("sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"), pieces_of.alias("pieces"))
    out.scratch = [pieces]
    return out
