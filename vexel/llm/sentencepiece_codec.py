"""SentencePiece encoding that keeps every piece's byte span in the original text, and decoding."""

from __future__ import annotations

import gc
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Recent, held_by, pick
from .text_hash import chunks, numbered, strung

SPACE = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map from character sequences to their normal form: a double-array trie and the forms it points to."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.forms = compiled[4 + size :] if compiled else b""

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(bytes taken, their form) of the longest mapped prefix of text[at:]; (0, b"") if there is none."""
        units = self.units

        def children(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node, found = children(units[0]), (0, 0)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= children(unit)
            if unit & 256:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if not found[0]:
            return 0, b""
        return found[0], self.forms[found[1] : self.forms.index(b"\0", found[1])]


def normalise(text: bytes, charmap: CharacterMap, dummy_prefix: bool, squeeze: bool) -> tuple[bytes, np.ndarray]:
    """The normal form in UTF-8, and for each of its bytes (and its end) the byte of `text` that it comes from.

    Spaces become U+2581. `squeeze` drops spaces at both ends and all but one inside; `dummy_prefix` puts one in front.
    """
    mark = SPACE.encode()
    if not charmap and not squeeze:  # only spaces change: done for all bytes at once
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        source = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
        front = np.zeros(3 * dummy_prefix, np.int64)
        return mark * dummy_prefix + text.replace(b" ", mark), np.concatenate([front, source, [len(raw)]])
    out, source, at, spaced = bytearray(), [], 0, squeeze
    while at < len(text):
        taken, form = charmap.longest(text, at) if charmap else (0, b"")
        if not taken:
            lead = text[at]
            taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            form = text[at : at + taken]
        for char in form.decode("utf-8", "replace"):
            if char == " ":
                if squeeze and spaced:
                    continue
                spaced, piece = True, mark
            else:
                spaced, piece = False, char.encode()
            out += piece
            source += [at] * len(piece)
        at += taken
    end = len(text)
    if squeeze:
        while out.endswith(mark):
            del out[-3:]
            end = source[-3]
            del source[-3:]
    if out and dummy_prefix:
        out[:0] = mark
        source[:0] = [source[0]] * 3
    return bytes(out), np.array([*source, end], np.int64)


@dataclass
class Codec:
    """A BPE model with its own normaliser, record of sources, merges and byte fallback.

    No piece has a U+2581 behind another character, and some characters are in no longer piece, so no merge crosses the
    places before the one and around the others: the normal form is cut there and each segment merged on its own. What
    was merged lately is remembered (`Recent`, bounded in bytes); all new segments of some texts are merged at once, as rows
    of a matrix (`merge_all`).
    """

    path: str
    max_bytes: int = 96_000_000
    longest: int = 32  #: segments of more characters, or with characters that have no piece, are merged one by one
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)

    def __post_init__(self):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)  # decodes
        charsmap, self.dummy_prefix, self.squeeze = b"", True, True
        for number, value in fields(self.library.serialized_model_proto()):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(fields(value))
                charsmap, self.dummy_prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.charmap = CharacterMap(charsmap)
        self.known = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        self.sizes = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)])
        inside = {c for p in self.known if len(p) > 1 for c in p}
        hard = "".join(re.escape(c) for c in "\n\r\t" if c not in inside)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}{hard}]*|[^{SPACE}{hard}]+" + (f"|[{hard}]" if hard else ""))
        self.is_hard = np.isin(np.arange(256), [ord(c) for c in "\n\r\t" if c not in inside])
        self.recent = Recent(self.max_bytes)
        # Tables of the merges: characters with a piece, and every pair of pieces that makes a piece.
        single = sorted((ord(p), i) for p, i in self.known.items() if len(p) == 1)
        self.points, self.point_ids = (np.array([x[k] for x in single], np.int64) for k in (0, 1))
        pairs = {self.known[p[:k]] * len(self.pieces) + self.known[p[k:]]: i for p, i in self.known.items() for k in range(1, len(p)) if p[:k] in self.known and p[k:] in self.known}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.rank = np.array(self.scores, np.float32)
        signs = np.array([b"%d," % i for i in range(len(self.pieces))])
        self.decimals = signs.view(np.uint8).reshape(len(signs), -1)

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the piece that two neighbours make, its score); -1 and -inf where they make none or one is missing (-1)."""
        made = np.full(left.shape, -1, np.int64)
        if len(self.pairs):
            key = left * len(self.pieces) + right
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
            made[hit] = self.joined[at[hit]]
        return made, np.where(made >= 0, self.rank[made], -np.inf).astype(np.float32)

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as little-endian 32-bit numbers: merges of many segments step together.

        A segment is a row of pieces, first its characters. In each step every row joins its best-scored neighbours, the
        left ones in a tie, until no row has any that make a piece.
        """
        out: list[bytes] = [b""] * len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), max(0, len(self.points) - 1))
        ids = np.where(self.points[at] == points, self.point_ids[at], -1) if len(self.points) else np.full(len(points), -1)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        alone = (sizes > self.longest) | (unknown[starts[1:]] > unknown[starts[:-1]])
        for i in np.flatnonzero(alone).tolist():
            out[i] = np.array([p for p, _ in self.merge(segments[i])], "<u4").tobytes()
        for low, high in ((1, 4), (5, 8), (9, 14), (15, self.longest)):
            group = np.flatnonzero(~alone & (sizes >= low) & (sizes <= high))
            for first in range(0, len(group), 1 << 14):
                rows = group[first : first + (1 << 14)]
                col = np.arange(high)
                have = col < sizes[rows][:, None]
                grid = np.where(have, ids[np.minimum(starts[rows][:, None] + col, len(ids) - 1)], -1)
                left = sizes[rows].copy()
                made, score = self._join(grid[:, :-1], grid[:, 1:])
                live = np.flatnonzero((made >= 0).any(axis=1))
                while len(live):
                    best = score[live].argmax(axis=1)
                    grid[live, best] = made[live, best]
                    left[live] -= 1
                    # What is behind the joined pair moves up by one.
                    tail = np.minimum(col + (col > best[:, None]), high - 1)
                    grid[live] = np.take_along_axis(grid[live], tail, 1)
                    grid[live, left[live]] = -1
                    tail = tail[:, : high - 1].clip(max=high - 2)
                    made[live], score[live] = np.take_along_axis(made[live], tail, 1), np.take_along_axis(score[live], tail, 1)
                    made[live, high - 2], score[live, high - 2] = -1, -np.inf
                    for side in (-1, 0):
                        place = best + side
                        ok = (place >= 0) & (place < high - 1)
                        row, place = live[ok], place[ok]
                        made[row, place], score[row, place] = self._join(grid[row, place], grid[row, place + 1])
                    live = live[(made[live] >= 0).any(axis=1)]
                flat, width = grid.astype("<u4").tobytes(), 4 * high
                for k, (row, n) in enumerate(zip(rows.tolist(), left.tolist())):
                    out[row] = flat[k * width : k * width + 4 * n]
        return out

    def merge(self, segment: str) -> list[tuple[int, int]]:
        """(id, bytes of the segment) of each piece: the best-scored neighbours join first, the left ones in a tie."""
        parts: list[str] = list(segment)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts) and (i := self.known.get(parts[left] + parts[right])) is not None:
                heapq.heappush(queue, (-self.scores[i], left, right, len(parts[left]) + len(parts[right])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, size = heapq.heappop(queue)
            if not parts[left] or not parts[right] or after[left] != right or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[tuple[int, int]] = []
        for part in filter(None, parts):
            raw = part.encode()
            if part in self.known:
                out.append((self.known[part], len(raw)))
            elif self.byte_ids:
                out += [(self.byte_ids[b], 1) for b in raw]
            elif out and out[-1][0] == self.unknown:
                out[-1] = (self.unknown, out[-1][1] + len(raw))
            else:
                out.append((self.unknown, len(raw)))
        return out

    def _cut(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the distinct segments, their offsets, number of every segment among them, first segments of the texts and the end).

        U+2581 is written as a space, which no normal form has.
        """
        short = [form.replace(SPACE.encode(), b" ") for form in forms]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, short), np.int64, len(short)))])
        data = np.frombuffer(b"".join(short), np.uint8)
        begins = np.zeros(len(data) + 1, bool)
        if self.cut:
            space, hard = data == 32, self.is_hard[data]
            begins[:-1] = space | hard
            begins[1:-1] &= ~(space[1:] & space[:-1])
            begins[1:] |= hard
        begins[bounds] = True
        starts = np.flatnonzero(begins)
        return *numbered(data, starts), np.searchsorted(starts, bounds)

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) of each text: piece i spans the original bytes bounds[i] to bounds[i + 1]."""
        forms = [normalise(t.encode(), self.charmap, self.dummy_prefix, self.squeeze) for t in texts]
        data, ends, number, firsts = self._cut([form for form, _ in forms])
        raw, cuts = data.tobytes(), ends.tolist()
        learn = lambda keys: self.merge_all([k.decode().replace(" ", SPACE) for k in keys])
        ids, offsets = strung(self.recent.many([raw[a:b] for a, b in zip(cuts, cuts[1:])], learn), number)
        ids, cuts = ids.astype(np.int64), offsets[firsts].tolist()
        sums = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        out = []
        for (form, source), a, b in zip(forms, cuts, cuts[1:]):
            own, at = ids[a:b], sums[a : b + 1] - sums[a]
            if len(own) and (not self.byte_ids and (own == self.unknown).any() or at[-1] != len(form)):
                norm = form.decode()
                whole = self._pieces(self.segments.findall(norm) if self.cut else [norm])  # an unknown piece does not tell its size
                own, at = np.array([i for i, _ in whole]), np.cumsum([0, *(n for _, n in whole)])
            out.append((own, source[at] if len(own) else np.zeros(1, np.int64)))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def _pieces(self, segments: list[str]) -> list[tuple[int, int]]:
        """(id, bytes) of the pieces of one text; neighbouring unknown ones are one."""
        out: list[tuple[int, int]] = []
        for i, n in (x for s in segments for x in self.merge(s)):
            if out and i == self.unknown == out[-1][0]:
                out[-1] = (i, out[-1][1] + n)
            else:
                out.append((i, n))
        return out

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        signs = self.decimals[ids].ravel()
        return signs[signs > 0].tobytes()[:-1]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(path: str) -> Codec:
    """One codec for each worker process, as long as it encodes or decodes with this model."""
    return held_by("sentencepiece", path, lambda: Codec(path))


#: From a document's ids, bounds and codec to the values of the columns wanted.
Derive = Callable[[np.ndarray, np.ndarray, Codec], tuple]


def _pieces(ids: np.ndarray, bounds: np.ndarray, own: Codec) -> tuple:
    return ids.astype(np.int32), bounds[:-1], bounds[1:]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", derive: Derive = _pieces, columns: str = "ids array<int>, starts array<bigint>, ends array<bigint>") -> DataFrame:
    """One row per input row: doc_id and, unless `derive` and `columns` say otherwise, ids, starts, ends.

    Ids are those of the sentencepiece library without begin and end ids; starts and ends are byte offsets in the
    original UTF-8 text, projected through the normaliser's record of sources. The pieces of a character that has no
    piece of its own are its bytes. A null text is empty; an empty one has no pieces. `model_path` is opened on
    the executors, where the tokenizer files are installed. No row is shuffled; memory follows the longest text.
    Repeated rows give repeated results, a null id is carried through, an empty table gives an empty one.
    """
    rows = pick(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, collecting = codec(model_path), gc.isenabled()
        gc.disable()  # lists of segments are long and hold no cycles
        try:
            for batch in batches:
                texts = [t if isinstance(t, str) else "" for t in batch["text"]]
                done = [derive(*x, own) for a, b in chunks(texts, 1 << 21) for x in own.encode_all(texts[a:b])]
                out = pd.DataFrame({n: list(v) for n, v in zip(names[1:], zip(*done))} if done else {n: [] for n in names[1:]})
                out.insert(0, "doc_id", batch["doc_id"].array)
                yield out[names]
        finally:
            if collecting:
                gc.enable()

    return rows.mapInPandas(run, f"doc_id {kind}, {columns}")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text: the library's decoding of each row's ids; null ids give an empty text."""
    rows = pick(encoded, (id_col, "doc_id"), (ids_col, "ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode([int(i) for i in ids]) if ids is not None else "" for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "text": texts})

    return rows.mapInPandas(run, f"doc_id {kind}, text string")
