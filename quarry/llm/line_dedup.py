"""Line dedup by a segment-partition edit join.

A line of ``min_chars`` code points or more goes if an equal line, or one within
``threshold`` edits (insert, delete, replace a code point), stands earlier in the
table; order is by id, then by place. Shorter lines stay, or with ``copies`` go if an
equal line stands earlier and they have that many code points and are not blank. With
``words``, a line also goes if an earlier one is within one edit of a word (insert,
delete, replace) for every ``words`` words of the shorter of both. ``WHOLE`` has what
the query and the pipeline use.

1. Occurrences ``(hash, id, place)`` of lines are aggregated to distinct lines with
   their first occurrence; no text is shuffled for exact copies.
2. Each line is cut into threshold + 1 segments: a line within the threshold holds one
   of them unchanged. A line's segments are index entries under (length, segment number,
   segment hash); it probes the indexes of its own and each shorter length within the
   threshold with the substrings at the starts that the numbers of edits left and right
   of the segment allow. Entries meet by key in one shuffle of narrow rows; keys with a
   single line go.
3. Edits of words are found alike, with words for code points, where up to ``SEGMENTED``
   are allowed. Longer lines share a run of words of a known least length, and so the
   smallest hash of word n-grams in a window of that run; lines meet under these hashes
   in buckets of length, each line in its own and, if a shorter one can be near, the lower.
4. Of keys with the same lines one stays. A line's sketch, its numbers of words by classes,
   bounds its edits to another: of each key only lines with such a partner stay, and no
   text moves for the others, however many share a key.
5. Lines that are left get their text, and each key's lines are compared with the earlier
   ones, by character or word counts and then by a banded bit-parallel edit distance, until
   one is near.

Hot keys: a key that many lines of one batch share is salted (a marker row keeps the
unsalted rest alive), and a key with more than ``BLOCK`` lines is compared in pairs of
blocks, so no task holds a whole hot key, and no pair is left out. Copies of a line
meet only as aggregates.

Defined results: a null text is empty (a filter leaves null as it is); rows that repeat
an id and a line at the same place are one occurrence; rows without an id come first; a
document that loses all its text goes with it, one that had none stays; columns of the
input are passed on unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bit_map, drop_scratch, in_bit_map, lean, scratch_made, slices, stored, whole_text
from quarry.llm.fingerprints import mix

BLOCK = 512
#: Lines of one batch that share a key before it is salted, and the number of salts.
HOT_LINES, SALTS = 32, 256
#: Bytes of text cut at once in a Python worker.
SLICE = 2 << 20
INDEX, PROBE, MARK, WORDS, HOT = 1, 2, 4, 8, 16
#: What of a line's hash names it in entries; lines with equal bits there are told apart when they are compared.
LINE = (1 << 48) - 32
#: Entries of a line, about, and entries of a bucket that meet at once in a Python worker.
ENTRIES, BUCKET = 32, 1 << 18
#: Classes of words in a line's sketch, of 4 bits each; coarse ones, of so many, are looked at first. Lengths in a band of a large key differ by this factor at most.
CLASSES, COARSE, BAND = 64, 8, 1.25
#: Pairs of sketches that are looked at together.
PAIRS = 1 << 18
#: Lines that are compared as one group; a line is found near once in it.
ROUTE = 4096
#: Edits that are looked for along diagonals.
DIAGONAL = 4
#: Largest number of word edits that is found by segments.
SEGMENTED = 3
#: Parameters of the query and the pipeline.
WHOLE = {"min_chars": 12, "copies": 1, "words": 12}
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
NO_ID = -(1 << 63)


def line_hashes(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first two 60 bits of the SHA-256 digest of each line."""
    high, low = np.frombuffer(b"".join([hashlib.sha256(x.encode("utf-8")).digest()[:16] for x in lines]), ">u8").reshape(-1, 2).T.astype(np.uint64)
    return (high >> np.uint64(4)).view(np.int64), ((high & np.uint64(15)) << np.uint64(56) | low >> np.uint64(8)).view(np.int64)


def within(a: Sequence[str], b: Sequence[str], k: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is ``k`` or less.

    Equal ends are cut off. Up to ``DIAGONAL`` edits are found by the furthest place that each number of
    edits reaches on each diagonal; more go through a bit-parallel dynamic program (vertical differences as
    bit vectors) restricted to the 2k + 1 diagonals of the band.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    i, m = 0, len(a)
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : m - j], b[i : len(b) - j]
    m, n = len(a), len(b)
    if n <= k:
        return True
    if not m:
        return False
    if m == n and sum(map(ne, a, b)) <= k:  # replacements alone
        return True
    few, gap = min(k, DIAGONAL), n - m
    # reach[x] is the row reached on diagonal x; places before -few are past few, as lists count from the end.
    reach = [-2] * (2 * few + 3)
    reach[0] = 0
    for d in range(1, few + 1):
        last, reach = reach, [-2] * (2 * few + 3)
        for x in range(max(-d, gap - k + d), min(d, gap + k - d) + 1):
            i = min(max(last[x] + 1, last[x + 1] + 1, last[x - 1]), m, n - x)
            if i < 0 or i + x < 0:
                continue
            while i < m and i + x < n and a[i] == b[i + x]:
                i += 1
            if i == m and x == gap:
                return True
            reach[x] = i
    if few == k:
        return False
    # Bit r of the window for column j is row j - k + r; rows outside 1..m are padding.
    width = 2 * k + 1
    full = (1 << width) - 1
    place: dict[str, int] = {}
    for r, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << (r + 1)
    plus, minus = full >> (k + 1) << (k + 1), 0  # column 0: each row from 1 on is one more than the row above
    score = k  # value at the band's lowest row of the column
    bottom = 1 << (width - 1)
    for j in range(1, n + 1):
        low = j - k
        match = place.get(b[j - 1], 0)
        match = (match >> low if low >= 0 else match << -low) & full
        # The window moves down by one row: differences of the last column shift towards bit 0,
        # and the row that enters is above the last column's reach.
        vp, vn = (plus >> 1) | bottom, minus >> 1
        zero = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(zero | vp)) & full
        hn = zero & vp
        score += 0 if zero & bottom else 1
        shifted_p, shifted_n = ((hp << 1) | 1) & full, (hn << 1) & full  # above the window each column is taken to be one more
        plus = (shifted_n | ~(zero | shifted_p)) & full
        minus = zero & shifted_p
        if not j & 7 and score - plus.bit_count() > k:  # no value of the column is within k
            return False
    # Walk up from the lowest row of the band to row m.
    row = n + k
    for r in range(width - 1, -1, -1):
        if row == m:
            break
        bit = 1 << r
        score -= 1 if plus & bit else -1 if minus & bit else 0
        row -= 1
    return score <= k


def cuts(length: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the even partition, the longer segments last; one column per segment."""
    base, longer = length // parts, length % parts
    i = np.arange(parts)
    size = base[:, None] + (i[None, :] >= (parts - longer)[:, None])
    return np.cumsum(size, axis=1) - size, size


_KNOWN = mix(np.arange(1 << 16, dtype=np.uint64))
#: White space as str.split() has it; it ends before the table does.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])


class Lines:
    """Some lines as one array of code points: running sums for hashes of substrings, and the words.

    The hash of code points s to e is ``(total[e] - total[s]) * inverse[s]``.
    """

    def __init__(self, lines: list[str]):
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.base = np.cumsum(self.length) - self.length
        self.codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = _KNOWN.take(self.codes.astype(np.intp), mode="clip")  # indexing by the type of addresses is faster
        if self.codes.max(initial=0) > 0xFFFF:
            high = np.flatnonzero(self.codes > 0xFFFF)
            symbols[high] = mix(self.codes[high].astype(np.uint64))
        self.total, self.inverse = _sums(symbols)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words of each line."""
        blank = self.codes == 32
        other = np.flatnonzero(self.codes - np.uint32(32) >= 96)  # neither blank nor a sign of ASCII
        blank[other] = _BLANK.take(self.codes[other], mode="clip")
        edge = np.ones(len(blank) + 1, bool)
        edge[1:] = blank
        edge[self.base] = True
        start = np.flatnonzero(edge[:-1] & ~blank)
        edge[:-1] = blank
        edge[-1] = True
        edge[self.base] = True
        end = np.flatnonzero(edge[1:] & ~blank) + 1
        hashes = mix((self.total[end] - self.total[start]) * self.inverse[start] ^ (end - start).astype(np.uint64))
        return hashes, np.diff(np.append(np.searchsorted(start, self.base), len(start)))


def _sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of symbols times powers, and inverse powers."""
    n = len(symbols)
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(symbols, power[:n], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return total, inverse


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to ``n`` and more; kept for the usual sizes only, so that a long text's are freed with it."""
    size = max(SLICE, n)
    if size in _powers:
        return _powers[size]
    tables = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, r)])) for r in (_R, _R_INVERSE))
    if size == SLICE:
        _powers[size] = tables
    return tables


def entries(lines: Lines, of: np.ndarray, hashes: np.ndarray, threshold: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line hashes and roles of all index and probe entries of the lines ``of`` by code points."""
    length, base, hashes, total, inverse = lines.length[of], lines.base[of], hashes[of], lines.total, lines.inverse
    parts = threshold + 1
    keys, owners, roles = [], [], []
    for less in range(threshold + 1):
        other = length - less
        start, size = cuts(np.maximum(other, 0), parts)
        for i in range(parts):
            for move in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1):
                at = start[:, i] + move
                ok = (other >= min_chars) & (at >= 0) & (at + size[:, i] <= length)
                s = (base + at)[ok]
                h = (total[s + size[ok, i]] - total[s]) * inverse[s]
                keys.append(mix(h ^ mix((other[ok] * parts + i).astype(np.uint64))).view(np.int64))
                owners.append(hashes[ok])
                roles.append(np.full(len(s), PROBE | (INDEX if less == 0 and move == 0 else 0), np.int8))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)


def word_entries(found: np.ndarray, length: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line hashes and roles of the entries for edits of words, one for every ``words`` of a line. ``found``: hashes of all words; ``length``: words of each line."""
    base = np.cumsum(length) - length
    total, inverse = _sums(found)
    keys, owners, roles = [], [], []

    def add(h: np.ndarray, tag: np.ndarray, owner: np.ndarray, role: int) -> None:
        keys.append(mix(h ^ mix(tag.astype(np.uint64) ^ _R)).view(np.int64))
        owners.append(owner)
        roles.append(np.full(len(h), WORDS | role, np.int8))

    for k in range(1, SEGMENTED + 1):
        for less in range(k + 1):
            other = length - less
            of = np.flatnonzero(other // words == k)
            start, size = cuts(other[of], k + 1)
            for i in range(k + 1):
                for move in range(max(-i, less - (k - i)), min(i, less + k - i) + 1):
                    at = start[:, i] + move
                    ok = (at >= 0) & (at + size[:, i] <= length[of])
                    s = (base[of] + at)[ok]
                    add((total[s + size[ok, i]] - total[s]) * inverse[s], other[of][ok] * 64 + i, hashes[of][ok], PROBE | (INDEX if less == 0 and move == 0 else 0))
    # k edits leave a run of (n - k) / (k + 1) words, which is shortest for the least n and k.
    k = SEGMENTED + 1
    run = -(-(words - 1) * k // (k + 1))
    gram = run // 2
    window = run - gram + 1
    long = length >= words * k
    if long.any():
        line = np.repeat(np.arange(len(length)), length)
        last = len(found) - run + 1
        at = np.flatnonzero(long[line[:last]] & (line[:last] == line[run - 1 :]))
        grams = len(found) - gram + 1
        h = mix((total[gram : gram + grams] - total[:grams]) * inverse[:grams])
        least, place = h[:last].copy(), np.zeros(last, np.int8)
        for j in range(1, window):
            less = h[j : j + last] < least
            np.minimum(least, h[j : j + last], out=least)
            np.maximum(place, less.view(np.int8) * np.int8(j), out=place)
        s = at + place[at]  # the first smallest of each window, which never moves back
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        bucket = np.floor(np.log2(length[line[s]])).astype(np.int64)
        add(h[s], bucket * 64 + 63, hashes[line[s]], PROBE | INDEX)
        near = length[line[s]] < 2.0**bucket * (1 + 1 / words)
        add(h[s[near]], (bucket[near] - 1) * 64 + 63, hashes[line[s[near]]], PROBE)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), whole_text(text).alias("text"))


def _places(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of every line."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


def occurrences(docs: DataFrame, min_chars: int, text: str = "text", copies: int | None = None) -> DataFrame:
    """``h1, h2, id, place`` of every line that takes part."""
    least = min_chars if copies is None else max(1, min(copies, min_chars))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            texts = [t.split("\n") for t in b.column(1).to_pylist()]
            row, place = _places(texts)
            lines = [x for t in texts for x in t]
            takes_part = [i for i, x in enumerate(lines) if len(x) >= min_chars or (len(x) >= least and not x.isspace())]
            if takes_part:
                h1, h2 = line_hashes([lines[i] for i in takes_part])
                ids = b.column(0).to_numpy()[row[takes_part]]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids), pa.array(place[takes_part].astype(np.int32))], ["h1", "h2", "id", "place"])

    return _keyed(docs, text).mapInArrow(run, "h1 long, h2 long, id long, place int")


def _batch_lines(b: pa.RecordBatch, min_chars: int) -> list[str]:
    """Distinct lines of a batch that take part."""
    return list(dict.fromkeys(x for t in b.column(1).to_pylist() for x in t.split("\n") if len(x) >= min_chars))


def sketches(names: np.ndarray, found: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row of bytes for each line: its name, its number of words, and how many words of each class it has, up to 15.

    A word that comes or goes changes one of these numbers by one at most, so they say that lines are far, never that they are near.
    """
    of = np.repeat(np.arange(len(length)) * CLASSES, length)
    counts = np.minimum(np.bincount(of + (found & np.uint64(CLASSES - 1)).astype(np.int64), minlength=len(length) * CLASSES), 15).astype(np.uint8).reshape(-1, CLASSES)
    out = np.empty((len(length), 12 + CLASSES // 2), np.uint8)
    out[:, :8] = names.astype("<i8").view(np.uint8).reshape(-1, 8)
    out[:, 8:12] = length.astype("<i4").view(np.uint8).reshape(-1, 4)
    out[:, 12:] = counts[:, ::2] | counts[:, 1::2] << 4
    return out


def _packed(key: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Twelve bytes a row: the upper 48 bits of the key, the lower 48 of the entry."""
    out = np.empty((len(key), 12), np.uint8)
    out[:, :6] = key.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, 2:]
    out[:, 6:] = entry.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6]
    return out


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 12)
    key, entry = np.zeros((2, len(raw), 8), np.uint8)
    key[:, 2:], entry[:, :6] = raw[:, :6], raw[:, 6:]
    return key.view("<i8").reshape(-1), entry.view("<i8").reshape(-1)


class Meeting:
    """The entries of one bucket as they come: rows of keys with partners go out, the others wait.

    What waits is one row for each key and line without a partner, however many lines a hot key has.
    """

    def __init__(self) -> None:
        self.key = self.entry = self.alive = np.empty(0, np.int64)
        self.parts = 0

    def add(self, key: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and entries that go out, and whether other buckets have rows of such a key."""
        self.parts += 1
        key, entry = np.concatenate([self.key, key]), np.concatenate([self.entry, entry])
        order = np.argsort(key)
        key, entry = key[order], entry[order]
        same = key[1:] == key[:-1]
        some = entry & (MARK | HOT) != 0
        some[1:] |= same
        some[:-1] |= same
        if len(self.alive):
            some |= self.alive[np.minimum(np.searchsorted(self.alive, key), len(self.alive) - 1)] == key
        waits = key[~some], entry[~some]
        key, entry = key[some], entry[some]
        if not len(key):
            self.key, self.entry = waits
            return key, entry, np.zeros(0, bool)
        order = np.lexsort((entry, key))
        key, entry = key[order], entry[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (entry[1:] != entry[:-1])])
        key, entry = key[fresh], entry[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own = entry & MARK == 0
        line = entry & LINE
        low = np.minimum.reduceat(np.where(own, line, np.iinfo(np.int64).max), first)
        high = np.maximum.reduceat(np.where(own, line, np.iinfo(np.int64).min), first)
        bits = np.bitwise_or.reduceat(entry & ~LINE, first)
        good = ((low < high) & (bits & INDEX > 0)) | (bits & (MARK | HOT) > 0) | np.isin(key[first], self.alive)
        self.alive = np.union1d(self.alive, key[first[good]])
        good, salted = (np.repeat(x, np.diff(np.append(first, len(key)))) for x in (good, bits & (MARK | HOT) > 0))
        self.key, self.entry = np.concatenate([waits[0], key[~good]]), np.concatenate([waits[1], entry[~good]])
        return key[good & own], entry[good & own], salted[good & own]


def met_entries(docs: DataFrame, threshold: int, min_chars: int, text: str = "text", words: int = 0, lines: int = 1 << 20) -> DataFrame:
    """``key, h1, role`` of the entries whose key has two lines or more, one of them in the index; ``h1`` is 43 bits of a line's hash."""
    return _entries_of(_met(docs, threshold, min_chars, text, words, lines))


def _entries_of(met: DataFrame) -> DataFrame:
    rows = met.where("key IS NOT NULL")
    # Most rows are known to be the only ones of their kind.
    again = rows.where("again").select("key", "h1", "role").distinct()
    return rows.where("NOT again").select("key", "h1", "role").unionByName(again)


def _met(docs: DataFrame, threshold: int, min_chars: int, text: str, words: int, lines: int) -> DataFrame:
    """``key, h1, role, again, of, sketch``: entries as in ``met_entries``, those with ``again`` perhaps repeated, and rows ``h1, of, sketch`` of all lines, which have no key; ``of``: number of words.

    ``lines``: about how many distinct lines there are; they set the number of buckets.
    """
    buckets = 1 << max(6, (lines * ENTRIES // BUCKET).bit_length())

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            lines = _batch_lines(b, min_chars)
            if not lines:
                continue
            hashes = line_hashes(lines)[0]
            cut = Lines(lines)
            found, length = cut.words()
            sketched = sketches(hashes & LINE, found, length)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - (int(hashes[0]) & (buckets - 1))]), pa.array([sketched.tobytes()], pa.binary())], ["bucket", "packed"])
            if words:
                # An edit of a code point is two of words at most, and changes their number by one: longer lines need no entries of code points.
                few = np.flatnonzero(length < words * 2 * threshold + threshold)
                key, h1, role = (np.concatenate(x) for x in zip(entries(cut, few, hashes, threshold, min_chars), word_entries(found, length, hashes, words), strict=True))
            else:
                key, h1, role = entries(cut, np.arange(len(lines)), hashes, threshold, min_chars)
            # Only keys that share their lowest bits with so many entries can be hot.
            low = key & ((1 << 18) - 1)
            maybe = np.flatnonzero((np.bincount(low, minlength=1 << 18) >= HOT_LINES)[low])
            values, at, n = np.unique(key[maybe], return_inverse=True, return_counts=True)
            values, rows = values[n >= HOT_LINES], maybe[(n >= HOT_LINES)[at]]
            entry = h1 & LINE | role
            where = key.view(np.uint64).copy()
            if len(values):
                entry[rows] |= HOT
                where[rows] += (1 + (h1[rows] & (SALTS - 1))).astype(np.uint64)
                key, entry = np.concatenate([key, values]), np.concatenate([entry, np.full(len(values), MARK)])
                where = np.concatenate([where, values.view(np.uint64)])
            bucket = (mix(where) & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            offsets = pa.py_buffer((np.append(first, len(bucket)) * 12).astype(np.int64))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, offsets, pa.py_buffer(_packed(key[order], entry[order]))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), packed.cast(pa.binary())], ["bucket", "packed"])

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h1", "role", "again", "of", "sketch"]
        waiting: list[bytes] = []
        at, held, meeting = None, 0, Meeting()

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            key, entry, again = meeting.add(*_unpacked(b"".join(waiting)))
            waiting.clear()
            if len(key):
                again |= not last or meeting.parts > 1  # another part of the bucket may give a row too
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(entry & LINE), pa.array((entry & (INDEX | PROBE | WORDS)).astype(np.int8)), pa.array(again), pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary())], names)

        for b in batches:
            for bucket, packed in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if bucket < 0:
                    raw = np.frombuffer(packed, np.uint8).reshape(-1, 12 + CLASSES // 2)
                    n, rest = len(raw), np.ascontiguousarray(raw[:, 12:])
                    sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * rest.shape[1]), pa.py_buffer(rest)])
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.ascontiguousarray(raw[:, :8]).view("<i8").reshape(-1)), pa.nulls(n, pa.int8()), pa.nulls(n, pa.bool_()), pa.array(np.ascontiguousarray(raw[:, 8:12]).view("<i4").reshape(-1)), sketch], names)
                    continue
                if bucket != at or held > 12 * max(4 * BUCKET, 2 * len(meeting.key)):
                    yield from give(bucket != at)
                    held = 0
                    if bucket != at:
                        at, meeting = bucket, Meeting()
                waiting.append(packed)
                held += len(packed)
        yield from give(True)

    # Entries move as blocks of bytes, one for each batch and bucket: no row for each of them.
    rows = _keyed(docs, text).mapInArrow(emit, "bucket long, packed binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, h1 long, role byte, again boolean, of int, sketch binary")


def passing(first: np.ndarray, size: np.ndarray, n: np.ndarray, by_word: np.ndarray, counts: np.ndarray, threshold: int, words: int) -> np.ndarray:
    """Which lines have a partner in their group that their sketches leave room for. Groups are rows ``first`` on, ``size`` of them, in order of ``n``.

    An edit of a word takes one and adds one; an edit of a code point changes three words at most, as where a blank goes.
    """
    some_words, all_words = (np.repeat(x.reduceat(by_word, first), size) for x in (np.logical_or, np.logical_and))
    most = np.maximum(2 * (n // max(1, words)) * some_words, 3 * threshold * ~all_words)  # to a line of as many words or more
    coarse = np.ascontiguousarray(counts.reshape(len(n), COARSE, -1).sum(axis=2, dtype=np.int16).T)
    good = np.zeros(len(n), bool)

    def look(x: np.ndarray, y: np.ndarray) -> None:
        apart = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.int16)
        for c in coarse:
            apart += np.abs(c[x] - c[y])
        ok = (apart <= most[x]) & (x < y)
        x, y = (np.broadcast_to(v, ok.shape)[ok] for v in (x, y))
        for at in range(0, len(x), PAIRS >> 3):
            i, j = x[at : at + (PAIRS >> 3)], y[at : at + (PAIRS >> 3)]
            a, b = counts[i], counts[j]
            near = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int32) <= most[i]
            good[i[near]] = good[j[near]] = True

    for length in np.unique(size[(size > 1) & (size <= 16)]).tolist():
        i, j = np.triu_indices(length, 1)
        at = first[size == length]
        for some in np.array_split(at, max(1, len(at) * len(i) // PAIRS)):
            look((some[:, None] + i).ravel(), (some[:, None] + j).ravel())
    for start, rows in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        of, end = n[start : start + rows], start + rows
        # Lines with more words than these edits allow are not looked at.
        reach = start + np.searchsorted(of, np.maximum(of + 2 * threshold, of + of // words if words else 0), "right")
        at = start
        while at < end:
            step = max(1, PAIRS // max(1, int(reach[min(at + 255, end - 1) - start]) - at))
            to = min(end, at + min(256, step))
            look(np.arange(at, to)[:, None], np.arange(at, int(reach[to - 1 - start]))[None, :])
            at = to
    return good


def near_members(met: DataFrame, members: DataFrame, threshold: int, words: int) -> DataFrame:
    """``key, h1, role`` of ``members`` (key, h1, role, n: lines of the key) with a partner by their sketches, which ``met`` has."""
    sketched = met.where("sketch IS NOT NULL").select("h1", "of", "sketch").repartition("h1").dropDuplicates()
    # Lines of one band of a large key, and those that may be near the band below, meet there.
    band = lambda n: F.floor(F.log(F.greatest(F.lit(1.0), n)) / F.log(F.lit(BAND)))
    bands = F.sequence(band(F.col("of") * F.lit(1 - 1 / max(1, words)) - 1), band(F.col("of").cast("double")))
    wide = (F.col("n") > BLOCK) & (F.col("role").bitwiseAND(WORDS) > 0)
    rows = members.join(sketched, "h1").select("key", F.explode(F.when(wide, bands).otherwise(F.array(F.lit(0).cast("long")))).alias("band"), "of", "h1", "role", "sketch")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def give(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, band, n, h1, role = (table.column(i).to_numpy() for i in range(5))
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
            raw = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(len(key), -1)
            counts = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(key), -1)
            good = passing(first, np.diff(np.append(first, len(key))), n.astype(np.int64), role & WORDS > 0, counts, threshold, words)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (key, h1, role)], ["key", "h1", "role"])

        for b in batches:
            if not b.num_rows:
                continue
            # The last group may go on; what is before it is looked at.
            key, band = b.column(0).to_numpy(), b.column(1).to_numpy()
            other = np.flatnonzero((key != key[-1]) | (band != band[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if not cut and waiting:
                last = waiting[-1].slice(waiting[-1].num_rows - 1)
                if (last.column(0)[0].as_py(), last.column(1)[0].as_py()) != (key[-1], band[-1]):
                    yield from give(pa.Table.from_batches(waiting))
                    waiting = []
            if cut:
                yield from give(pa.Table.from_batches([*waiting, b.slice(0, cut)]))
                waiting = []
            waiting.append(b.slice(cut))
        if waiting:
            yield from give(pa.Table.from_batches(waiting))

    return rows.repartition("key", "band").sortWithinPartitions("key", "band", "of").mapInArrow(run, "key long, h1 long, role byte").distinct()


def line_texts(docs: DataFrame, lines: DataFrame, min_chars: int, text: str = "text") -> DataFrame:
    """``h1, h2, line`` of distinct lines; all that stand at an ``id, place`` of ``lines``, and few others. Only these are hashed again."""
    at = F.shiftleft("id", 7).bitwiseXOR(F.col("place").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(lines.select(at.alias("at")), "at"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in slices(batches, "text", SLICE):
            texts = [t.split("\n") for t in b.column(1).to_pylist()]
            row, place = _places(texts)
            hit = np.flatnonzero(in_bit_map(bits, b.column(0).to_numpy()[row] << 7 ^ place))
            lines = list(dict.fromkeys(x for r, i in zip(row[hit].tolist(), place[hit].tolist(), strict=True) if len(x := texts[r][i]) >= min_chars))
            if lines:
                h1, h2 = line_hashes(lines)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(lines, pa.string())], ["h1", "h2", "line"])

    return _keyed(docs, text).mapInArrow(run, "h1 long, h2 long, line string").groupBy("h1", "h2").agg(F.first("line").alias("line"))


class Route:
    """Lines that are compared with each other, by the keys that some of them share."""

    FEW = 6

    def __init__(self, threshold: int, words: int):
        self.threshold, self.words = threshold, words
        self.lines: dict[int, list[tuple]] = {}  # by the bits that name it: id, place, h1, h2, line
        self.near: set[tuple[int, int]] = set()
        self.far: set[tuple] = set()
        self.split: dict[tuple[int, int], list[str]] = {}
        self.sets: dict[tuple, frozenset[str]] = {}
        self.repeats: dict[tuple, frozenset] = {}
        self.counts: dict[tuple, np.ndarray] = {}

    def _symbols(self, line: tuple, by_word: bool) -> Sequence[str]:
        """The line's words or code points."""
        if not by_word:
            return line[4]
        name = line[2:4]
        if name not in self.split:
            self.split[name] = line[4].split()
        return self.split[name]

    def _counts(self, line: tuple, by_word: bool) -> np.ndarray:
        """Numbers of the line's words or code points by classes."""
        name = (*line[2:4], by_word)
        if name not in self.counts:
            x = self._symbols(line, by_word)
            codes = np.fromiter(map(hash, x), np.int64, len(x)) & 63 if by_word else np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) & 63
            self.counts[name] = np.minimum(np.bincount(codes, minlength=64), 30000).astype(np.int16)
        return self.counts[name]

    def _distinct(self, line: tuple, by_word: bool) -> frozenset[str]:
        name = (*line[2:4], by_word)
        if name not in self.sets:
            self.sets[name] = frozenset(self._symbols(line, by_word))
        return self.sets[name]

    def _repeated(self, line: tuple) -> frozenset:
        """The line's words, a word's second place and later ones beside it."""
        name = line[2:4]
        if name not in self.repeats:
            x, found = self._symbols(line, True), set(self._distinct(line, True))
            if len(found) < len(x):
                found.update([(w, i) for w, n in Counter(x).items() if n > 1 for i in range(1, n)])
            self.repeats[name] = frozenset(found)
        return self.repeats[name]

    def _near(self, a: tuple, b: tuple, by_word: bool) -> bool:
        """Whether two lines are near; pairs that are not are remembered."""
        name = (*a[2:4], *b[2:4], by_word)
        if a[4] == b[4] or name in self.far:
            return False
        x, y = self._symbols(a, by_word), self._symbols(b, by_word)
        most = min(len(x), len(y)) // self.words if by_word else self.threshold
        if abs(len(x) - len(y)) <= most:
            one, other = self._distinct(a, by_word), self._distinct(b, by_word)
            # An edit takes one distinct symbol away at most, and adds one.
            if max(len(one), len(other)) - len(one & other) <= most:
                if len(x) == len(y) and sum(map(ne, x, y)) <= most:  # replacements alone
                    return True
                # Nor does it take more than one word of all, repeats included: that tells most lines apart.
                if by_word and most > DIAGONAL:
                    one, other = self._repeated(a), self._repeated(b)
                if max(len(one), len(other)) - len(one & other) <= most and within(x, y, most):
                    return True
        self.far.add(name)
        return False

    def compare(self, group: dict[int, tuple[int, int]], across: bool) -> None:
        """Adds to ``near`` the lines of one key with an earlier one within the threshold. ``group``: role and block of each name; ``across``: only of different blocks."""
        rows = sorted((*line, role, own) for name, (role, own) in group.items() for line in self.lines.get(name, ()))
        open_ = [k for k in range(1, len(rows)) if rows[k][2:4] not in self.near]
        if not open_:
            return
        by_word = bool(rows[0][5] & WORDS)
        meets = lambda a, b: (a[5] & INDEX and b[5] & PROBE or a[5] & PROBE and b[5] & INDEX) and not (across and a[6] == b[6])
        hits = lambda j, k: meets(rows[j], rows[k]) and self._near(rows[j], rows[k], by_word)
        counts = None
        for k in open_:
            near = any(hits(j, k) for j in range(min(k, self.FEW)))
            if not near and k > self.FEW:
                if counts is None:
                    counts = np.stack([self._counts(r, by_word) for r in rows])
                    size = np.array([len(self._symbols(r, by_word)) for r in rows])
                limit = np.minimum(size[self.FEW : k], size[k]) // self.words if by_word else np.full(k - self.FEW, self.threshold)
                fits = np.flatnonzero(np.abs(size[self.FEW : k] - size[k]) <= limit)
                fits = fits[np.abs(counts[fits + self.FEW] - counts[k]).sum(axis=1) <= 2 * limit[fits]]
                near = any(hits(j, k) for j in (fits + self.FEW).tolist())
            if near:
                self.near.add(rows[k][2:4])


def _different(met: DataFrame) -> DataFrame:
    """``key, root, n`` of keys of two lines or more, one of those with the same lines in the same roles; ``root``: the smallest line."""
    keys = met.groupBy("key").agg(F.bit_xor(F.xxhash64("h1", "role")).alias("x"), F.count(F.lit(1)).alias("n"), F.min("h1").alias("root")).where("n > 1")
    return keys.groupBy("x", "n").agg(F.min("key").alias("key"), F.min("root").alias("root")).select("key", "root", "n")


def _with_keys(met: DataFrame, keys: DataFrame) -> DataFrame:
    """``met`` joined with ``keys`` (key, n and others)."""
    often = max(1000, (keys.agg(F.sum("n")).first()[0] or 0) // 256)  # at most 256 keys have more lines
    return met.join(F.broadcast(keys.where(F.col("n") > often)), "key").unionByName(met.join(keys.where(F.col("n") <= often), "key"))


def near_lines(docs: DataFrame, distinct: DataFrame, threshold: int, min_chars: int, text: str = "text", words: int = 0) -> DataFrame:
    """``h1, h2`` of the distinct lines with an earlier line within the threshold."""
    since = scratch_made()
    all_ = stored(_met(docs, threshold, min_chars, text, words, distinct.count()))
    met = _entries_of(all_)
    # Near copies share many keys: of keys with the same lines in the same roles one does.
    keys = stored(_different(met))
    met = stored(near_members(all_, _with_keys(met, keys.select("key", "n")), threshold, words))
    drop_scratch(docs.sparkSession, since)
    keys = stored(_different(met))
    # Keys with the same smallest line are compared together, so that its copies' texts come once; too many lines go by key.
    heavy = keys.groupBy("root").agg(F.sum("n").alias("all")).where(F.col("all") > ROUTE).select("root", F.lit(True).alias("heavy"))
    # A key with more lines than a block: each of its lines goes to every pair of blocks that has its own.
    routed = keys.join(heavy, "root", "left").select("key", "n", F.when(F.col("heavy"), F.col("key")).otherwise(F.col("root")).alias("route"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(t, own).alias("a"), F.greatest(t, own).alias("b"), own.alias("own")))
    joined = _with_keys(met, routed)
    one = joined.where("blocks = 1").select("route", "key", *(F.lit(0).alias(c) for c in ("a", "b", "own")), "role", "h1")
    more = joined.where("blocks > 1").select("key", "role", "h1", F.inline(pairs)).select(F.xxhash64("key", "a", "b").alias("route"), "key", "a", "b", "own", "role", "h1")
    members = stored(one.unionByName(more))
    drop_scratch(docs.sparkSession, since)
    # Texts are shuffled twice: to be one for each line, and to their routes.
    shown = stored(members.select("route", F.col("h1").alias("name")).distinct().join(distinct.withColumn("name", F.col("h1").bitwiseAND(LINE)), "name"))
    shown = shown.join(line_texts(docs, shown.select("id", "place"), min_chars, text), ["h1", "h2"])
    null = lambda t: F.lit(None).cast(t)
    rows = shown.select("route", F.lit(0).alias("key"), *(F.lit(0).alias(c) for c in ("a", "b", "own", "role")), "name", "id", "place", "h1", "h2", "line")
    rows = rows.unionByName(members.select("route", "key", "a", "b", "own", F.col("role").cast("int").alias("role"), F.col("h1").alias("name"), null("long").alias("id"), null("int").alias("place"), null("long").alias("h1"), null("long").alias("h2"), null("string").alias("line")))

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        at = key = None
        route, group = Route(threshold, words), {}

        def settle() -> None:
            if len(group) > 1 or any(len(route.lines.get(x, ())) > 1 for x in group):
                route.compare(group, key[1] != key[2])
            group.clear()

        for b in slices(batches, "line", SLICE):
            for to, *k, own, role, name, id_, place, h1, h2, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if to != at or (line is None and k != key):
                    settle()
                    if to != at:
                        found += route.near
                        at, route = to, Route(threshold, words)
                    key = k
                if line is not None:
                    route.lines.setdefault(name, []).append((id_, place, h1, h2, line))
                else:
                    group[name] = (group[name][0] | role if name in group else role), own
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["h1", "h2"])
                found = []
        settle()
        if found := [*found, *route.near]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["h1", "h2"])

    order = F.col("route"), F.col("line").isNull(), F.col("key"), F.col("a"), F.col("b")
    return rows.repartition("route").sortWithinPartitions(*order).mapInArrow(compare, "h1 long, h2 long").distinct()


def _first(all_: DataFrame) -> DataFrame:
    """``h1, h2, id, place, n``: each line's first occurrence, and how many there are.

    An occurrence is one number, which a hash aggregate can hold, as it can't a struct: a long for usual ids, a decimal for those beyond 32 bits.
    """
    usual = F.col("id").between(-(1 << 31), (1 << 31) - 1)
    small = F.when(usual, F.shiftleft("id", 31) + F.col("place"))
    large = F.when(~usual, F.expr("CAST(id AS DECIMAL(20, 0)) * 2147483648 + place"))
    first = all_.groupBy("h1", "h2").agg(F.min(small).alias("small"), F.min(large).alias("large"), F.count(F.lit(1)).alias("n"))
    at = F.expr("CAST(pmod(large, 2147483648) AS INT)")
    large_first = F.col("small").isNull() | F.coalesce(F.col("large") < 0, F.lit(False))
    found = first.withColumn("place", F.when(large_first, at).otherwise(F.col("small").bitwiseAND((1 << 31) - 1).cast("int")))
    return found.select("h1", "h2", F.when(large_first, F.expr("CAST((large - place) / 2147483648 AS BIGINT)")).otherwise(F.shiftright("small", 31)).alias("id"), "place", "n")


def dropped(docs: DataFrame, threshold: int = 2, min_chars: int = 24, text: str = "text", copies: int | None = None, words: int = 0) -> DataFrame:
    """``id, place, h1, near`` of every occurrence that goes."""
    since = scratch_made()
    all_ = stored(occurrences(docs, min_chars, text, copies))
    distinct = stored(_first(all_))
    near = near_lines(docs, distinct.select("h1", "h2", "id", "place"), threshold, min_chars, text, words).withColumn("near", F.lit(True))
    gone = stored(distinct.join(near, ["h1", "h2"], "left").where("n > 1 OR near").select("h1", "h2", F.col("id").alias("_id"), F.col("place").alias("_place"), "n", F.coalesce("near", F.lit(False)).alias("near")))
    drop_scratch(docs.sparkSession, since + 1)  # but for all_ and gone
    # At most 256 lines are more than a 256th of all; those go by broadcast, so that no task gets the copies of a hot line.
    often = max(1000, all_.count() // 256)
    parts = [all_.join(F.broadcast(gone.where(F.col("n") > often)), ["h1", "h2"]), all_.join(gone.where(F.col("n") <= often), ["h1", "h2"])]
    return parts[0].unionByName(parts[1]).where("near OR id != _id OR place != _place").select("id", "place", "h1", "near")


def _joined(docs: DataFrame, threshold: int, min_chars: int, text: str, copies: int | None, words: int) -> DataFrame:
    since = scratch_made()
    drops = stored(dropped(docs, threshold, min_chars, text, copies, words).groupBy(F.col("id").alias("__line_id")).agg(F.array_sort(F.collect_set(F.struct("place", "h1", "near"))).alias("__line_drops")))
    drop_scratch(docs.sparkSession, since)  # what led to them goes before whole texts are shuffled
    keyed = docs.withColumn("__line_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return keyed.join(drops, F.col("__line_key") == F.col("__line_id"), "left").drop("__line_key", "__line_id")


def _kept(text: str, drops: list[tuple[int, int, bool]]) -> tuple[str, int, int]:
    """The text without the dropped lines (place, h1, near), and how many went as copies and as near copies."""
    if not drops:
        return text, 0, 0
    lines = text.split("\n")
    there = [d for d in drops if d[0] < len(lines)]
    gone = {place: near for (place, own, near), h in zip(there, line_hashes([lines[d[0]] for d in there])[0].tolist(), strict=True) if h == own}
    near = sum(gone.values())
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(gone) - near, near


def _drops(column: pa.ListArray) -> list[list[tuple[int, int, bool]]]:
    """Each row's drops (place, h1, near); a null is empty."""
    flat = list(zip(*(x.to_pylist() for x in column.flatten().flatten()), strict=True))
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy())
    return [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def dedup_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 24, text: str = "text", copies: int | None = None, words: int = 0) -> DataFrame:
    """``docs`` without repeated lines, and without documents that lose all their text; the same columns."""
    out = _joined(docs, threshold, min_chars, text, copies, words)
    at, drops_at, width = docs.columns.index(text), len(docs.columns), len(docs.columns)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, SLICE):
            drops = _drops(b.column(drops_at))
            texts, keep = b.column(at).to_pylist(), []
            for i, d in enumerate(drops):
                keep.append(True)
                if d and texts[i]:
                    new = _kept(texts[i], d)[0]
                    keep[-1] = new == texts[i] or bool(new.strip())
                    texts[i] = new
            cols = list(b.columns[:width])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(run, docs.schema)


RESULT = "doc_id long, n_lines int, n_copies int, n_near int, kept_sha256 string"


def line_report(docs: DataFrame, threshold: int = 2, min_chars: int = 24, text: str = "text", copies: int | None = None, words: int = 0) -> DataFrame:
    """Per row: lines, lines that go as copies and as near copies, and the digest of what stays."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            rows = []
            for i, t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _drops(b.column(2)), strict=True):
                kept, copies, near = _kept(t, d)
                rows.append((i, t.count("\n") + 1, copies, near, hashlib.sha256(kept.encode("utf-8")).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return _joined(slim, threshold, min_chars, "text", copies, words).mapInArrow(run, RESULT)
