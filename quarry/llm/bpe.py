"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the split pattern is encoded on its own. Its bytes are the leaves of a
segment tree; a leaf holds ``rank * size + position`` of the pair that starts there,
so the root is the leftmost pair of minimum rank. A merge updates at most three
leaves (the merged pair, its live left neighbour and the swallowed right one), each
in logarithmic time, so a match of n bytes takes O(n log n) however long it is.

Matches are found by the kinds of code points for all texts of a batch together, and
each distinct match is merged once. The ids of known matches are kept in a table of
bounded size per Python worker: it changes speed, never results.

Defined results: a null text is an empty one, which has no tokens; special tokens
are ordinary text; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices, whole_text

NONE = 1 << 62


def ranks_from_lines(lines: list[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))  # where the live token to the left starts
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            value = a if a < b else b
            if tree[at] == value:
                return
            tree[at] = value
            at >>= 1

    def pair(at: int) -> int:
        mid = end[at]
        if mid >= n:
            return NONE
        r = get(piece[at : end[mid]])
        return NONE if r is None else r * size + at

    while tree[1] < NONE:
        at = tree[1] % size
        gone = end[at]
        end[at] = end[gone]
        put(gone, NONE)
        if end[at] < n:
            before[end[at]] = at
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Pairs:
    """Rank of the concatenation of two tokens, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        split = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array(sorted(split) or [(-1, 0)], np.int64)
        self.keys, self.ranks = pairs[:, 0].copy(), pairs[:, 1].copy()

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[list[int]]:
    """``merge_piece`` of many matches of at most 64 bytes: one segment tree per row of an array, merged in step."""
    out: list[list[int]] = [[]] * len(pieces)
    byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (r := ranks.get(piece)) is not None:
            out[i] = [r]
        else:
            classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for size, members in classes.items():
        length = np.array([len(pieces[i]) for i in members])
        n, place = len(members), np.arange(size)
        data = np.frombuffer(b"".join(pieces[i].ljust(size, b"\0") for i in members), np.uint8).reshape(n, size)
        token = byte_id[data]
        live = place[None, :] < length[:, None]
        after = np.broadcast_to(place + 1, (n, size)).copy()
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, np.int64)
        rank = pairs(token[:, :-1], token[:, 1:])
        tree[:, size:-1] = np.where(live[:, 1:] & (rank < NONE), rank * size + place[:-1], NONE)
        low = size // 2
        while low:
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
            low //= 2

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            at = at + size  # noqa: B023
            tree[row, at] = value  # noqa: B023
            while at[0] > 1:  # all rows are on one level
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])  # noqa: B023

        def pair(row: np.ndarray, at: np.ndarray) -> np.ndarray:
            right = after[row, at]  # noqa: B023
            inside = right < length[row]  # noqa: B023
            right = np.where(inside, right, 0)
            r = pairs(token[row, at], token[row, right])  # noqa: B023
            return np.where(inside & (r < NONE), r * size + at, NONE)  # noqa: B023

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            at = best & (size - 1)
            gone = after[row, at]
            token[row, at] = best // size
            live[row, gone] = False
            follows = after[row, gone]
            after[row, at] = follows
            inner = follows < length[row]
            before[row[inner], follows[inner]] = at[inner]
            put(row, gone, NONE)
            put(row, at, pair(row, at))
            left = before[row, at]
            has = left >= 0
            if has.any():
                put(row[has], left[has], pair(row[has], left[has]))
            row = row[tree[row, 1] < NONE]
        ids, stop = token[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        start = 0
        for i, end in zip(members, stop, strict=True):
            out[i] = ids[start:end]
            start = end
    return out


#: Fixed value: the split pattern of the public byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """Kind of every code point, by the same expressions as the pattern's."""
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, expression in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(expression, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def match_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of ``SPLIT`` start in the code points of some texts; ``first`` marks each text's first one.

    A match is a run of one kind, and a run that follows a single blank takes that blank.
    White space before another kind gives up its last character, which is that blank or
    a match of its own. An apostrophe that is a run and a match of its own takes the
    letters of a contraction, and what follows these starts a match.
    """
    n = len(codes)
    kind = kinds()[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    inside = ~first[1:]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inside)
    start[last] = True
    blank = last[codes[last] == 32]
    start[blank + 1] = False
    quote = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & inside)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one = padded[quote + 1]
        two = np.where(np.concatenate([first, [True, True]])[quote + 2], 0, padded[quote + 2])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, width in ((short, 2), (long, 3)):
            at = quote[chosen]
            start[at + 1] = False
            start[(at + width)[at + width < n]] = True
    return np.flatnonzero(start)


def _gathered(first: np.ndarray, count: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs ``values[first : first + count]`` one after another."""
    ends = np.cumsum(count)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)]


class Codec:
    """Encoder and decoder for one vocabulary and one split pattern.

    The ids of known strings are runs of one array; ``known`` has the place of each
    string's run in ``first`` and ``count``. The vocabulary's own strings are always
    known. Where more than ``KEEP`` others are, those of the last batch are kept.
    """

    KEEP, LONGEST = 200_000, 64

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.pattern = pattern
        self.finder = regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for token, i in ranks.items():
            words[i] = token
        self.words = pa.array(words, pa.large_binary())
        self.names = pa.array([b"%d " % i for i in range(size)], pa.large_binary())
        self.own: dict[str, int] = {}
        for token, i in ranks.items():
            try:
                self.own[token.decode("utf-8")] = i
            except UnicodeDecodeError:  # part of a character: never a whole match
                pass
        self._forget()

    def _forget(self, kept: dict[str, np.ndarray] | None = None) -> None:
        kept = kept or {}
        n = len(self.words)
        self.known = dict(self.own)
        self.known.update(zip(kept, range(n, n + len(kept)), strict=True))
        lengths = np.fromiter(map(len, kept.values()), np.int64, len(kept))
        self.flat = np.concatenate([np.arange(n, dtype=np.int32), *kept.values()])
        self.count = np.concatenate([np.ones(n, np.int64), lengths])
        self.first = np.cumsum(self.count) - self.count

    def _add(self, strings: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(strings, range(len(self.first), len(self.first) + len(strings)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths) - lengths])
        self.count = np.concatenate([self.count, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))])

    def _learn(self, strings: list[str]) -> None:
        raw = [m.encode("utf-8") for m in strings]
        small = [i for i, x in enumerate(raw) if len(x) <= 64]
        ids: list[list[int]] = [[]] * len(raw)
        for i, found in zip(small, merge_many([raw[i] for i in small], self.ranks, self.pairs), strict=True):
            ids[i] = found
        for i, x in enumerate(raw):
            if len(x) > 64:
                ids[i] = merge_piece(x, self.ranks)
        self._add(strings, ids)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The matches of texts in UTF-8 bytes, and the number of each text's first match (and one past the last)."""
        if self.pattern != SPLIT:
            found = [self.finder.findall(data[a:b].tobytes().decode("utf-8")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return pa.array([m for f in found for m in f], pa.large_string()), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(codes):
            return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point starts
        first = np.zeros(len(codes), bool)
        begins = np.searchsorted(at, offsets)
        first[begins[begins < len(codes)]] = True
        start = match_starts(codes, first)
        cut = np.append(at[start], len(data))
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)), np.searchsorted(start, begins)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in UTF-8 bytes, one after another, and where each text's begin (and the last's end)."""
        matches, of = self.matches(np.ascontiguousarray(data), offsets)
        coded = matches.dictionary_encode()
        strings = coded.dictionary.to_pylist()
        get = self.known.get
        place = [get(x, -1) for x in strings]
        unknown = [x for x, p in zip(strings, place, strict=True) if p < 0]
        if unknown:
            self._learn(unknown)
            get = self.known.get
            place = [get(x, -1) for x in strings]
        slot = np.array(place, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if strings else np.empty(0, np.int64)
        count = self.count[slot]
        out = _gathered(self.first[slot], count, self.flat)
        ends = np.concatenate([[0], np.cumsum(count)])
        if unknown and len(self.known) > self.KEEP + len(self.own):
            self._forget({x: self.flat[self.first[p] : self.first[p] + self.count[p]] for x, p in zip(strings, place, strict=True) if x not in self.own and len(x) <= self.LONGEST})
        else:
            for x in unknown:
                if len(x) > self.LONGEST:  # bounds what is kept; its run stays unused until the next clearing
                    del self.known[x]
        return out, ends[of]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.ids(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return _bytes(self.words.take(pa.array(ids, pa.int32())))[0].tobytes()


def _bytes(taken: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Content and offsets of an array of large binaries."""
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    raw = taken.buffers()[2] if len(taken) else None
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """Pieces of whole texts (first text, and its start and end in ``data``), a longer one cut before a blank and an ASCII letter, where a match of any text starts."""
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > most:
            far = data[a + most : b]
            letter = (far[1:] | 32) - 97 < 26  # unsigned
            ok = np.flatnonzero((far[:-1] == 32) & letter)
            if not len(ok):
                break
            yield i, a, a + most + int(ok[0])
            a += most + int(ok[0])
        yield i, a, b


def _codec(data: bytes, pattern: str) -> Codec:
    """Made by each task, so that a worker that goes on to other stages doesn't hold it."""
    return Codec(ranks_from_lines(data.decode("ascii").splitlines()), pattern)


def vocabulary(path: str) -> bytes:
    """The rank file's content, read once on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def _columns(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``."""
    return round_trip(docs, ranks_path, pattern, text, with_ids=True).select("doc_id", "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, content binary`` from ``doc_id, ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(np.array(x or [], np.int32)) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of text encoded at once in a Python worker.
SLICE = 1 << 20


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of strings without nulls, and the offsets of each in them."""
    large = texts.cast(pa.large_string())
    return _bytes(large.view(pa.large_binary()))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes whole texts, decodes the ids and digests both, in one pass; with ``with_ids``, also the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))
    schema = DIGEST + ", ids array<int>" * with_ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in slices(batches, "text", SLICE):
            data, offsets = _utf8(b.column(1))
            n = b.num_rows
            counts, names, decoded = np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            packed = []
            parts = list(_parts(data, offsets, 4 * SLICE)) if len(data) > 4 * SLICE and pattern == SPLIT else None
            groups = [([i], np.array([x, y])) for i, x, y in parts] if parts else [(range(n), offsets)]
            for rows, at in groups:
                ids, ends = codec.ids(data[at[0] : at[-1]], at - at[0])
                taken = pa.array(ids, pa.int32())
                for table, digests, cut in ((codec.names, names, 1), (codec.words, decoded, 0)):
                    content, places = _bytes(table.take(taken))
                    for k, i in enumerate(rows):
                        x, y = int(places[ends[k]]), int(places[ends[k + 1]])
                        if y > x:
                            if cut and counts[i]:
                                digests[i].update(b" ")
                            digests[i].update(content[x : y - cut])
                for k, i in enumerate(rows):
                    counts[i] += ends[k + 1] - ends[k]
                packed.append(ids)
            cols = [b.column(0), pa.array(counts), pa.array([x.hexdigest() for x in names]), pa.array([x.hexdigest() for x in decoded])]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(packed), pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return _columns(docs, text).mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
