"""Encoding and decoding with a merge-type sentencepiece vocabulary.

A text becomes segments (white-space marks and the run of other characters
behind them); no piece of the vocabulary has a mark after another character
(checked when it is loaded), so no merge crosses a segment border and each
distinct segment is encoded once. Within a segment an agenda of adjacent
symbol pairs, ordered by score and then by place, gives the next merge. Short
segments of an Arrow batch are worked off together, the agenda held in arrays
(one row a segment, one column a pair); long ones use a heap. What the agenda
gives for new segments is compared with the sentencepiece library, batch by
batch, and a difference raises. What a worker remembers of segments is bounded
in bytes and forgotten at the end of each partition.

Defined results: null counts as the empty text (no ids, decodes to ""); ids
may be null or repeated; each row is encoded alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, at_partition_end, batch_of, field, session, texts

MARK = "▁"
#: Symbols of the longest segment that the arrays take; beyond, the heap.
ARRAY_SYMBOLS = 40
#: Widths of the arrays; a segment goes into the next wider one.
WIDTHS = (4, 6, 8, 10, 13, 17, 24, ARRAY_SYMBOLS)
#: Bytes of segments remembered by a worker within a partition, and the longest that is remembered.
MEMORY_BYTES, LONGEST = 32 << 20, 48
#: Segments that the library encodes as one text when they are compared with it.
VERIFY_ROWS = 64
#: Bytes of text worked off at once.
PART_BYTES = 1 << 20

_segments = re.compile(r" *[^ ]+| +\Z").findall
_loaded: dict[str, PieceCodec] = {}
_NONE = np.int32(np.iinfo(np.int32).max)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.digits = list(map(str, range(n)))
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        own = set(plain)
        self.ids = {self.names[i]: i for i in plain}
        self.spaced = [x.replace(MARK, " ") if i in own else "\0" for i, x in enumerate(self.names)]
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or lib.encode("  a \t") != lib.encode("  a ") + [self.byte_ids[9]]:
            raise ValueError("the vocabulary must have byte fallback, keep white space and have no piece with an inner space")
        # Pairs of pieces whose joint text is a piece; ranks order pieces by score.
        scores = np.array([lib.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = sorted((self.ids[p[:k]] * n + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_piece = np.array([i for _, i in pairs] + [0], np.int32)
        self.pair_rank = np.concatenate([rank[self.pair_piece[:-1]], [_NONE]]).astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        unknown = np.flatnonzero(self.of_char < 0)
        self.of_char[unknown] = n + unknown  # no pair has them; they become bytes at the end
        self.pair_map: dict[int, tuple[int, int]] = {}  # for the heap, made when first needed
        self.memory: dict[str, Remembered] = {}

    # -- the agenda ---------------------------------------------------------
    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs; negative symbols and those beyond the vocabulary pair with nothing."""
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        hit = (self.pair_keys[at] == keys) & (right >= 0) & (right < self.size)
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_piece[at]

    def _by_arrays(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of segments, one row each, -1 behind a row's end; the ids after all merges, end to end, and how many of each row.

        Symbols are linked within a row (a merged one becomes -1), so a merge touches three places of a row only.
        """
        rows, n = symbols.shape
        width = n + 2  # a border of -1 on both sides
        sym = np.full((rows, width), -1, np.int32)
        sym[:, 1:-1] = symbols
        ranks, piece = np.full((rows, width), _NONE, np.int32), np.zeros((rows, width), np.int32)
        if n > 1:
            ranks[:, 1:n], piece[:, 1:n] = self._look_up(sym[:, 1:n], sym[:, 2 : n + 1])
        done, place = np.empty_like(sym), np.arange(rows)
        after = np.arange(rows * width, dtype=np.int32) + 1
        before = after - 2
        while len(place):
            f = ranks.argmin(axis=1) + np.arange(0, sym.size, width)  # the first of equal ranks is the leftmost
            live = ranks.ravel()[f] != _NONE
            if not live.all():
                if live.sum() <= 0.6 * len(live):  # rows without a pair left go, the rest is packed
                    done[place[~live]] = sym[~live]
                    links = [(x.reshape(-1, width)[live] - (np.flatnonzero(live) * width)[:, None] + (np.arange(live.sum()) * width)[:, None]).astype(np.int32).ravel() for x in (after, before)]
                    place, sym, ranks, piece, (after, before) = place[live], sym[live], ranks[live], piece[live], links
                    continue
                f = f[live]
            s, r, p = sym.ravel(), ranks.ravel(), piece.ravel()
            gone = after[f]
            right, left = after[gone], before[f]
            s[f], s[gone], r[gone] = p[f], -1, _NONE
            after[f], before[right] = right, f
            at = np.concatenate([f, left])  # the pairs on both sides of the new symbol
            r[at], p[at] = self._look_up(s[at], np.concatenate([s[right], s[f]]))
        there = done >= 0
        return done[there], there.sum(axis=1)

    def _by_heap(self, symbols: list[int]) -> list[int]:
        if not self.pair_map:
            self.pair_map = dict(zip(self.pair_keys[:-1].tolist(), zip(self.pair_rank.tolist(), self.pair_piece.tolist(), strict=True), strict=False))
        n, get = len(symbols), self.pair_map.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbols[b] < self.size and (found := get(symbols[a] * self.size + symbols[b])):
                heapq.heappush(agenda, (found[0], a, symbols[a], symbols[b], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, x, y, piece = heapq.heappop(agenda)
            b = after[a]
            if symbols[a] != x or b < 0 or symbols[b] != y:
                continue  # one of the two has been merged meanwhile
            symbols[a], symbols[b] = piece, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s >= 0]

    def _bytes(self, ids: list[int]) -> list[int]:
        """Unknown characters as the ids of their UTF-8 bytes."""
        if not ids or max(ids) < self.size:
            return ids
        return [y for x in ids for y in ([x] if x < self.size else [self.byte_ids[b] for b in chr(x - self.size).encode()])]

    def _agenda(self, segments: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Place and ids of every segment."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        group = np.searchsorted(WIDTHS, sizes)
        for k, width in enumerate((*WIDTHS, 0)):
            places = np.flatnonzero(group == k).tolist()
            if not places:
                continue
            n = sizes[places]
            codes = self.of_char[np.frombuffer("".join([segments[i] for i in places]).replace(" ", MARK).encode("utf-32-le"), np.uint32)]
            if not width:
                yield from zip(places, [self._bytes(self._by_heap(x.tolist())) for x in np.split(codes, np.cumsum(n)[:-1])], strict=True)
                continue
            symbols = np.full((len(places), width), -1, np.int32)
            symbols[np.arange(width) < n[:, None]] = codes
            ids, n = self._by_arrays(symbols)
            ends = np.cumsum(n)
            odd = set(np.searchsorted(ends, np.flatnonzero(ids >= self.size), side="right").tolist())
            ids = ids.tolist()
            for k, (i, a, b) in enumerate(zip(places, (ends - n).tolist(), ends.tolist(), strict=True)):
                yield i, self._bytes(ids[a:b]) if k in odd else ids[a:b]

    def encode_segments(self, segments: list[str], verify: bool = True) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(segments)
        for i, ids in self._agenda(segments):
            out[i] = ids
        if verify and segments:
            self._verify(segments, out)
        return out

    def _verify(self, segments: list[str], ids: list[list[int]]) -> None:
        """Against the library: segments joined to texts of ``VERIFY_ROWS`` (a last one of spaces only stands alone)."""
        joined = [i for i, s in enumerate(segments) if s[-1] != " "]
        alone = [i for i, s in enumerate(segments) if s[-1] == " " and len(s) > 1]
        several = [joined[k : k + VERIFY_ROWS] for k in range(0, len(joined), VERIFY_ROWS)] + [[i] for i in alone]
        found = self.library.encode(["".join([segments[i] for i in part])[1:] for part in several], num_threads=1)
        for part, theirs in zip(several, found, strict=True):
            if list(chain.from_iterable([ids[i] for i in part])) != theirs:
                raise ValueError("the agenda and the library differ on a batch of segments")

    # -- texts --------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """Pieces to text: marks are spaces, runs of byte pieces are UTF-8, invalid bytes U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.names[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if ids and self.names[ids[0]].startswith(MARK) else text

    def split(self, text: str) -> list[str]:
        return _segments(" " + text.replace(MARK, " ")) if text else []

    def encode_texts(self, several: list[str], verify: bool = True, form: str = "text") -> Iterator[tuple[str | bytes, str]]:
        """Of each text: its ids (joined by commas, or as the bytes of 32-bit integers), and the decoded text."""
        digits = self.digits
        joined = (lambda ids: ",".join([digits[i] for i in ids])) if form == "text" else (lambda ids: np.array(ids, "<i4").tobytes())
        comma = "," if form == "text" else b""
        piece = self.spaced.__getitem__
        split = [self.split(t) for t in several]
        known = self.memory.setdefault(form, Remembered(MEMORY_BYTES))
        found, new = known.look_up(set().union(*split))
        odd: dict[str, str] = {}  # what comes back different; never remembered
        for s, ids in zip(new, self.encode_segments(new, verify), strict=True):
            found[s] = v = joined(ids)
            if "".join(map(piece, ids)) != s and (back := " " + self.decode(ids)) != s:  # a byte is no text by itself
                odd[s] = back
            elif len(s) <= LONGEST:
                known.add(s, v)
        for x in split:
            text = "".join(x) if odd.keys().isdisjoint(x) else "".join([odd.get(s, s) for s in x])
            yield comma.join([found[s] for s in x]), text[1:]

    def forget(self) -> None:
        self.memory.clear()
        self.pair_map.clear()


class Remembered:
    """What segments become, in two generations of half ``size`` bytes each; what is asked for again lives on."""

    def __init__(self, size: int):
        self.most, self.bytes, self.young, self.old = size // 2, 0, {}, {}

    def add(self, segment: str, value: str | bytes) -> None:
        if self.bytes > self.most:
            self.young, self.old, self.bytes = {}, self.young, 0
        self.young[segment] = value
        self.bytes += 200 + 2 * len(segment) + len(value)

    def look_up(self, segments: set[str]) -> tuple[dict[str, str | bytes], list[str]]:
        """The known ones of these with their values, and the new ones."""
        young, old = self.young, self.old
        found = {s: young[s] for s in segments & young.keys()}
        again = {s: old[s] for s in (segments & old.keys()) - found.keys()}
        found |= again
        new = list(segments - found.keys())
        for s, v in again.items():
            self.add(s, v)
        return found, new


def load(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


@at_partition_end
def _forget() -> None:
    for codec in _loaded.values():
        codec.forget()


def piece_codec(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """One row per document: id, ids (array), n_tokens, decoded text."""
    schema = T.StructType([field(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    session(docs)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(load(path).encode_texts(texts(batch), verify, "bytes"))
        n = np.array([len(x[0]) // 4 for x in found], np.int64)
        flat = pa.array(np.frombuffer(b"".join([x[0] for x in found]), "<i4"), pa.int32())
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
        return batch_of(schema, [batch.column(0), ids, pa.array(n), [x[1] for x in found]])

    return arrow_map(docs.select(id_col, text_col), encode, schema, PART_BYTES)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, SHA-256 of the joined ids and of the decoded text."""
    schema = T.StructType([field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    session(docs)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(ids.count(",") + 1 if ids else 0, sha(ids), sha(text)) for ids, text in load(path).encode_texts(texts(batch), verify)]
        return batch_of(schema, [batch.column(0), *map(list, zip(*found, strict=True))])

    return arrow_map(docs.select(id_col, text_col), encode, schema, PART_BYTES)
