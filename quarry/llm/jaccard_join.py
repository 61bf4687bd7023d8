"""Exact Jaccard self-join of word n-gram sets, to connected components, with set-relation skipping.

A document's set is its distinct five-word shingles as 64-bit hashes. Documents with
equal sets are one class from the start.

1. Prefixes. Under one order of all shingles, two sets that link share a shingle in
   their prefixes. The order is by hash, but shingles that are in more than ``OFTEN``
   prefixes come last, counted over all documents; the list of these is broadcast, and
   the count from which a shingle is listed rises where it would exceed ``LISTED``.
2. Candidate groups. Prefix entries meet by shingle; entries whose sizes and positions
   leave room for a link connect their classes. A list of many classes only chains
   neighbours by size, so its edges are linear in its length. The components of these
   edges are groups: no link leaves a group. Groups larger than a block, which grow
   together by single shared shingles, are parted by counting: see ``parted``.
3. Skip join. A group's sets meet in one task (a large group's in pairs of blocks) and
   are joined by size over inverted lists kept in blocks by position. For a probing set
   the positional bound admits one range of sizes in each block, found by bisection; the
   rest of the block is skipped. A set that is highly similar to one already answered
   takes over its candidates, adds those of its other prefix shingles, and derives
   overlaps from that set's overlaps and the two differences. Sets that are already in
   one component are not compared: a link between them changes nothing.
4. The links' components give each class, and so each document, its smallest id.

Hot keys: a shingle that many documents of one batch share sends one entry from there;
groups are split into blocks; classes that hold more than a 256th of the documents (at
most 256) are joined back by broadcast.

Defined results: null and empty texts, and texts of white space, have no set and are
their own component; a text of fewer than five words has one shingle, its whole word
sequence; rows without an id take part but don't count as smallest id; rows that
repeat an id have one row of result each.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bit_map, drop_scratch, in_bit_map, lean, scratch_made, slices, stored, whole_text
from quarry.llm.components import components, contracted
from quarry.llm.fingerprints import mix

WORDS = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Bound of the broadcast list of frequent shingles (32 MB), and the least count of one.
LISTED, OFTEN = 1 << 22, 4
#: Documents of one batch that share a prefix shingle before they send one entry for all.
HOT_DOCS = 64
#: Bytes of text hashed at once in a Python worker; arrays of 64-bit numbers over them take eight times as much each.
SLICE = 1 << 20
#: Bits of a class in candidate edges, and of positions and sizes there; kinds of rows.
NODE, CAP = (1 << 48) - 1, (1 << 16) - 1
ALL, EDGE = 1, 2
#: Lists up to this length are filtered pair by pair.
SMALL = 16
#: Sets of large groups from which a shingle counts as common, whose sets are not paired by it.
COMMON = 16
#: Sets and shingles in a block of a large group.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: A set is derived from another from this similarity on.
ALIKE = 0.9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(256, dtype=np.uint64))[_LOWER]
_R = np.uint64(0xD1342543DE82EF95)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_C = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to ``n``; kept for the usual sizes only, so that a long text's are freed with it."""
    size = max(SLICE, n)
    if size == SLICE and _powers:
        return _powers[0]
    tables = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, r)])) for r in (_R, _R_INVERSE))
    if size == SLICE:
        _powers[0] = tables
    return tables


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words in UTF-8 ``data``, and the document of each."""
    n = len(data)
    space = _SPACE[data]
    before = np.ones(n + 1, bool)
    before[1:] = space
    before[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(before[:-1] & ~space)
    after = np.ones(n + 1, bool)
    after[:n] = space
    after[offsets[1:]] = True
    end = np.flatnonzero(after[1:] & ~space) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.take(_VALUE, data, out=total[1:])
    total[1:] *= power[:n]
    np.cumsum(total, out=total)
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(offsets[1:], start, "right")


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text, its sorted distinct shingle hashes."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    words, doc = word_hashes(data, offsets - offsets[0])
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    m = len(words)
    if m >= WORDS:
        rolled = sum(words[j : m - WORDS + 1 + j] * _C[j] for j in range(WORDS))
        rolled = mix(rolled)
    out = []
    for i in range(n):
        a, c = int(first[i]), int(count[i])
        if c >= WORDS:
            out.append(np.unique(rolled[a : a + c - WORDS + 1]))
        elif c:
            out.append(mix(np.array([(words[a : a + c] * _C[:c]).sum() ^ np.uint64(c)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set; equal sets have equal ones."""
    if not len(s):
        return 0, 0
    return int(mix(s ^ np.uint64(0x1234567)).sum().view(np.int64)), int(mix(s ^ np.uint64(0x89ABCDEF)).sum().view(np.int64))


def node_of(s1: np.ndarray) -> np.ndarray:
    return s1 & NODE


def prefix(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def needed(a: int, b: int) -> int:
    """Least intersection of two sets of these sizes that link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))


def _distinct_sets(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Signature and set of each different non-empty set in a batch."""
    seen = set()
    for s in shingle_sets(b.column(1)):
        if len(s) and (g := signature(s)) not in seen:
            seen.add(g)
            yield *g, s


def heads(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n, s1, s2``: set size and signature of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            sets = shingle_sets(b.column(1))
            s1, s2 = zip(*map(signature, sets), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], ["doc_id", "n", "s1", "s2"])

    return _keyed(docs, text).mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def frequent(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted shingles in more than ``OFTEN`` prefixes or, if those are over ``LISTED``, in more than the least doubling of it that leaves so few."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            parts = [s[: prefix(len(s))] for _, _, s in _distinct_sets(b)]
            if parts:
                token, n = np.unique(np.concatenate(parts), return_counts=True)  # copies within the batch count once
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"])

    counted = stored(_keyed(docs, text).mapInArrow(run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN))
    steps = [OFTEN << i for i in range(48)]
    left = counted.agg(*(F.count_if(F.col("n") > x) for x in steps)).first()
    often = next(x for x, n in zip(steps, left, strict=True) if n <= LISTED)
    return np.sort(counted.where(F.col("n") > often).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def candidate_edges(docs: DataFrame, listed: np.ndarray, text: str = "text") -> DataFrame:
    """``u, v``: nodes (classes by 48 bits of their signature) that may belong to one group.

    A prefix entry is two longs: 48 bits of the shingle and 16 of the position, 48 bits of
    the class and 16 of the size. Equal bits of different shingles or classes, and capped
    positions and sizes, only add candidates. A shingle that many documents of one batch
    have in their prefixes sends one entry from there, with the others chained to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        for b in slices(batches, "text", SLICE):
            tokens, owners, sizes, places = [], [], [], []
            for s1, _, s in _distinct_sets(b):
                n = len(s)
                p = prefix(n)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, s), len(listed) - 1)
                    last = listed[at] == s
                    if last[:p].any():
                        s = np.concatenate([s[~last], s[last]])
                tokens.append(s[:p])
                owners.append(np.full(p, s1, np.int64))
                sizes.append(np.full(p, n, np.int64))
                places.append(np.arange(p))
            if not tokens:
                continue
            token, owner = np.concatenate(tokens) >> np.uint64(16), node_of(np.concatenate(owners))
            a = ((token << np.uint64(16)) | np.minimum(np.concatenate(places), CAP).astype(np.uint64)).view(np.int64)
            c = (owner << 16) | np.minimum(np.concatenate(sizes), CAP)
            values, at, count = np.unique(token, return_inverse=True, return_counts=True)
            hot = (count >= HOT_DOCS)[at]
            kind = np.zeros(len(a), np.int8)
            if hot.any():
                # Chain the owners by shingle; the first of each stands for all, joined with any other entry there.
                rows = np.flatnonzero(hot)
                rows = rows[np.argsort(at[rows], kind="stable")]
                same = at[rows][1:] == at[rows][:-1]
                u, v = owner[rows][:-1][same], owner[rows][1:][same]
                first = rows[np.concatenate([[True], ~same])]
                kind[first] = ALL
                keep = ~hot
                keep[first] = True
                a, c, kind = np.concatenate([a[keep], u]), np.concatenate([c[keep], v]), np.concatenate([kind[keep], np.full(len(u), EDGE, np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(kind)], ["a", "c", "kind"])

    def edges_of(a: np.ndarray, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Edges of whole lists; rows are in order of shingle."""
        ready = kind == EDGE
        out = [np.stack([a[ready], c[ready]])]
        a, c, kind = a[~ready], c[~ready], kind[~ready]
        if not len(a):
            return out[0]
        token, place, owner, n = a >> 16, a & CAP, (c >> 16) & NODE, c & CAP
        order = np.lexsort((n, token))
        token, place, owner, n, kind = token[order], place[order], owner[order], n[order], kind[order]
        same = token[1:] == token[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(first, len(token)))

        def pairs(x: np.ndarray, y: np.ndarray) -> None:
            least = -(-NUM * (n[x] + n[y]) // (NUM + DEN))
            fits = (DEN * n[x] >= NUM * n[y]) & (place[x] + least <= n[x]) & (place[y] + least <= n[y])
            ok = (owner[x] != owner[y]) & (fits | (n[y] == CAP))
            out.append(np.stack([owner[x][ok], owner[y][ok]]))

        plain = ~np.logical_or.reduceat(kind == ALL, first)
        for length in range(2, SMALL + 1):
            at = first[plain & (size == length)]
            if len(at):
                for i in range(length):
                    for j in range(i + 1, length):
                        pairs(at + i, at + j)
        # Longer lists chain neighbours by size; where an entry stands for others, all are chained.
        chain = np.flatnonzero(same & np.repeat(~plain | (size > SMALL), size)[1:])
        ok = (DEN * n[chain] >= NUM * n[chain + 1]) | (n[chain + 1] == CAP) | np.repeat(~plain, size)[chain]
        out.append(np.stack([owner[chain][ok], owner[chain + 1][ok]]))
        return np.concatenate(out, axis=1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def give(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            e = edges_of(*cols)
            e = e[:, e[0] != e[1]]
            if e.shape[1]:
                e = np.unique(np.sort(e, axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [x.to_numpy() for x in b.columns]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1] >> 16 << 16))  # the last shingle's list may go on
            if cut:
                yield from give([x[:cut] for x in cols])
            carry = [x[cut:] for x in cols]
        if carry is not None:
            yield from give(carry)

    rows = _keyed(docs, text).mapInArrow(emit, "a long, c long, kind byte")
    # Ready edges have an arbitrary `a` and go where it sends them; they need no partner.
    return rows.repartition(F.expr("shiftright(a, 16)")).sortWithinPartitions("a").mapInArrow(contracted(meet), "u long, v long")


class SkipJoin:
    """Links of some sets, as a spanning forest of the link graph; see the module's step 3.

    ``sides``: where given, only sets of different sides are compared.
    """

    def __init__(self, sets: list[np.ndarray], sides: list[int] | None = None):
        self.sides = sides
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
        all_ = np.concatenate(sets)
        values, at, df = np.unique(all_, return_inverse=True, return_counts=True)
        by_df = np.argsort(df, kind="stable")
        rank = np.empty(len(values), np.int64)
        rank[by_df] = np.arange(len(values))
        ends = np.cumsum([len(s) for s in sets])
        self.sets = [np.sort(r) for r in np.split(rank[at], ends[:-1])]
        self.shared_from = int(np.searchsorted(df[by_df], 2))  # ranks below are in one set only
        self.marks = np.zeros(len(values), bool)
        self.order = order
        self.parent = list(range(len(sets)))
        # Per rank: position -> sizes and sets in order of size, and the place in the order of the last set added.
        self.lists: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
        self.last: dict[int, int] = {}
        self.turn: dict[int, int] = {}
        self.raw: dict[int, set[int]] = {}  # every set met in a list of the prefix
        self.overlap: dict[int, dict[int, int]] = {}

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def links(self) -> list[tuple[int, int]]:
        out = []
        for turn, y in enumerate(self.order):
            self.turn[y] = turn
            self.marks[self.sets[y]] = True
            for z in self._partners(y):
                a, b = self.find(y), self.find(z)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    out.append((y, z))
            self.marks[self.sets[y]] = False
            self._add(y, turn)
        return out

    def _add(self, y: int, turn: int) -> None:
        s = self.sets[y]
        n = len(s)
        for place, r in enumerate(s[: n - needed(n, n) + 1].tolist()):
            if r >= self.shared_from:
                sizes, ids = self.lists.setdefault(r, {}).setdefault(place, ([], []))
                sizes.append(n)
                ids.append(y)
                self.last[r] = turn

    def _skip(self, y: int, z: int) -> bool:
        return self.find(y) == self.find(z) or (self.sides is not None and self.sides[y] == self.sides[z])

    def _count(self, y: int, z: int) -> int:
        got = int(np.count_nonzero(self.marks[self.sets[z]]))
        self.overlap[y][z] = got
        return got

    def _base(self, y: int, probes: list[tuple[int, int]]) -> tuple[int, int] | None:
        """A set already answered that is highly similar to ``y``, and their overlap."""
        met = Counter(block[1][-1] for _, r in probes if r in self.lists for block in self.lists[r].values())
        for x, _ in met.most_common(1):
            o = self._count(y, x)
            n = len(self.sets[y]) + len(self.sets[x]) - o
            if o >= ALIKE * n:
                return x, o
        return None

    def _partners(self, y: int) -> Iterator[int]:
        s = self.sets[y]
        n = len(s)
        self.overlap[y] = {}
        probes = [(j, r) for j, r in enumerate(s[: prefix(n)].tolist()) if r >= self.shared_from]
        raw = self.raw[y] = set()
        if base := self._base(y, probes):
            yield from self._derived(y, *base, probes)
            return
        seen: set[int] = set()
        for j, r in probes:
            for i, (sizes, ids) in self.lists.get(r, {}).items():
                raw.update(ids)
                # Sizes that the positional bound leaves: place + needed <= size, on both sides.
                low = -(-(NUM * n + (NUM + DEN) * i) // DEN)
                high = (DEN * n - (NUM + DEN) * j) // NUM
                for z in ids[bisect_left(sizes, low) : bisect_right(sizes, high)]:
                    if z not in seen:
                        seen.add(z)
                        if not self._skip(y, z) and self._count(y, z) >= needed(n, len(self.sets[z])):
                            yield z

    def _derived(self, y: int, x: int, o: int, probes: list[tuple[int, int]]) -> Iterator[int]:
        """Partners of ``y`` from the answers of the highly similar ``x``."""
        sy, sx = self.sets[y], self.sets[x]
        n = len(sy)
        raw = self.raw[y]
        raw |= self.raw[x]
        raw.add(x)
        own = set(sx[: prefix(len(sx))].tolist())
        turn = self.turn[x]
        for _, r in probes:
            if r not in own or self.last.get(r, -1) > turn:  # other lists hold nothing that x has not met
                for _, ids in self.lists.get(r, {}).values():
                    raw.update(ids)
        known = self.overlap[x]
        gone, new = np.setdiff1d(sx, sy, assume_unique=True), np.setdiff1d(sy, sx, assume_unique=True)
        if o >= needed(n, len(sx)) and not self._skip(y, x):
            yield x
        for z in sorted(raw):
            if z in (x, y) or self._skip(y, z):
                continue
            sz = self.sets[z]
            if DEN * min(n, len(sz)) < NUM * max(n, len(sz)):
                continue
            least = needed(n, len(sz))
            if z in known:
                got = known[z]
                if got + len(new) < least:
                    continue
                if got - len(gone) < least:
                    got += int(np.isin(new, sz, assume_unique=True).sum()) - int(np.isin(gone, sz, assume_unique=True).sum())
                    self.overlap[y][z] = got
                    if got < least:
                        continue
                yield z
            elif self._count(y, z) >= least:
                yield z


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash of a set, in order."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def packed_sets(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """``node, s1, s2, shingles`` of the classes that are in ``nodes`` (node), and of few others; dealt by node."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(nodes, "node"))

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            found = list(_distinct_sets(b))
            if not found:
                continue
            nodes = node_of(np.array([f[0] for f in found], np.int64))
            rows = [(k, s1, s2, packed(s)) for (s1, s2, s), k, h in zip(found, nodes.tolist(), in_bit_map(shared.value, nodes).tolist(), strict=True) if h]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "s1", "s2", "shingles"])

    return _keyed(docs, text).mapInArrow(emit, "node long, s1 long, s2 long, shingles binary").repartition("node").dropDuplicates(["node", "s1", "s2"])


def large_groups(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """``root, blocks`` of the groups that are too large for one task; sizes say which, before any set moves."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return groups.join(sizes, "node").groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")


def parted(docs: DataFrame, groups: DataFrame, sizes: DataFrame, text: str = "text") -> DataFrame:
    """``groups`` (node, root) with the large ones parted; no link leaves a group of the result.

    Of sets ``x`` and ``y`` that link, ``needed`` shingles are common; heads of more than half
    of each, in one order, leave at most half of the set whose head ends first behind, so the
    heads have at least ``needed`` less half of the larger set in common, a quarter of either set or more.
    Shingles in ``COMMON`` sets or more are last in the order. Sets meet by the others, and
    shared ones are counted for each pair, once for all shingles with the same sets: a set has
    less than ``COMMON`` partners by a shingle. Common ones could add as many as both heads hold.
    Only sets whose heads hold a quarter of the set in common shingles could link by these
    alone; they stay together by each, and are not counted against those they stay with.
    """
    large = stored(groups.join(large_groups(groups, sizes), "root", "left_semi"))
    if large.isEmpty():
        return groups
    sets = stored(packed_sets(docs, large, text).join(large.select("node").distinct(), "node", "left_semi").select("node", "shingles"))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "shingles", SLICE):
            token, n = np.unique(np.concatenate([unpacked(x) for x in b.column(1).to_pylist()]) >> np.uint64(16), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    # Other shingles that share a bit count as common too, in every set alike.
    counted = sets.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(counted, "token"))

    def heads_of(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Node, size, the head's rare and its common shingles."""
        for node, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = (unpacked(data) >> np.uint64(16)).view(np.int64)
            common = in_bit_map(shared.value, s)
            head = len(s) // 2 + 1
            rare = s[~common][:head]
            yield node, len(s), rare, s[common][: head - len(rare)]

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "shingles", SLICE):
            found = list(heads_of(b))
            times = [len(rare) for _, _, rare, _ in found]
            columns = [np.repeat(np.array(x, np.int64), times) for x in zip(*((node, n, len(common), root) for (node, n, _, common), root in zip(found, b.column(2).to_pylist(), strict=True)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([rare for _, _, rare, _ in found]), *columns)], ["token", "node", "n", "common", "held"])

    def lists_of(token: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lists of two sets or more that are not all held together, each as bytes, and how many shingles of this task have it."""
        order = np.lexsort((rows[:, 0], token))
        token, rows = token[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[: len(token)]
        if not len(first):
            return
        apart = np.minimum.reduceat(rows[:, 3], first) < np.maximum.reduceat(rows[:, 3], first)
        found = Counter(rows[a:z].tobytes() for a, z in zip(first[apart].tolist(), np.append(first[1:], len(token))[apart].tolist(), strict=True))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["list", "times"])

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rows = np.empty(0, np.int64), np.empty((0, 4), np.int64)
        for b in batches:
            token = np.concatenate([token, b.column(0).to_numpy()])
            rows = np.concatenate([rows, np.stack([x.to_numpy() for x in b.columns[1:]], axis=1)])
            cut = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last list may go on
            yield from lists_of(token[:cut], rows[:cut])
            token, rows = token[cut:], rows[cut:]
        yield from lists_of(token, rows)

    @lean
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "list", SLICE >> 4):
            by_length: dict[int, tuple[list[bytes], list[int]]] = {}
            for data, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = by_length.setdefault(len(data) // 32, ([], []))
                some[0].append(data)
                some[1].append(times)
            for length, (some, times) in by_length.items():
                node, n, common, held = np.frombuffer(b"".join(some), np.int64).reshape(-1, 4).T
                i, j = np.triu_indices(length, 1)
                at = (np.arange(len(some)) * length)[:, None]
                x, y, times = (at + i).ravel(), (at + j).ravel(), np.repeat(np.array(times, np.int64), len(i))
                small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                ok = (DEN * small >= NUM * large) & (held[x] != held[y])
                x, y, large = x[ok], y[ok], large[ok]
                least = -(-NUM * (n[x] + n[y]) // (NUM + DEN)) - (large - large // 2 - 1) - np.minimum(common[x], common[y])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], times[ok], least)], ["u", "v", "n", "least"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets that could link by common shingles alone, with each of these as a node above all others."""
        for b in slices(batches, "shingles", SLICE):
            held = [(node, common) for node, n, _, common in heads_of(b) if 4 * len(common) >= n]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c for _, c in held]) + NODE + 1), pa.array(np.repeat(np.array([x for x, _ in held], np.int64), [len(c) for _, c in held]))], ["u", "v"])

    chained = stored(components(sets.mapInArrow(contracted(chain), "u long, v long")).where(F.col("node") <= NODE))  # a root is a set, as sets are below shingles
    held = sets.join(chained, "node", "left").select("node", "shingles", F.coalesce("root", "node").alias("held"))
    lists = held.mapInArrow(emit, "token long, node long, n long, common long, held long").repartition("token").sortWithinPartitions("token").mapInArrow(meet, "list binary, times long")
    # The shingles of one edit or passage are in the same sets: pairs are made once for all of them.
    pairs = lists.groupBy("list").agg(F.sum("times").alias("times")).mapInArrow(pair, "u long, v long, n long, least long")
    linked = pairs.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("u", "v")
    found = components(stored(linked.unionByName(chained.select(F.col("node").alias("u"), F.col("root").alias("v")))))
    return groups.join(large.select("root").distinct(), "root", "left_anti").select("node", "root").unionByName(found)


def group_links(docs: DataFrame, groups: DataFrame, sizes: DataFrame, text: str = "text") -> DataFrame:
    """``u, v`` (signatures): a spanning forest of the links between classes.

    ``groups``: node, root. ``sizes``: node, n of every class. Sets are compared by 48 bits
    of each shingle's hash; two sets of a million shingles have a false match in one of 280.
    """
    # Groups too large for one task are dealt out in blocks.
    large = large_groups(groups, sizes)
    placed = groups.join(large, "root", "left").select("node", "root", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    # One shuffle by node serves both the removal of copies and the join.
    sets = packed_sets(docs, groups, text)
    own = F.pmod(F.xxhash64("s2"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(t, own).alias("a"), F.greatest(t, own).alias("b"), own.alias("own")))
    rows = sets.join(placed, "node").select("root", "s1", "shingles", F.inline(pairs)).select("root", "a", "b", "own", "s1", "shingles")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, np.ndarray]] = []
        at = None

        def links() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            sides = [g[0] for g in group] if at[1] != at[2] else None
            return [(group[x][1], group[y][1]) for x, y in SkipJoin([g[2] for g in group], sides).links()]

        for b in slices(batches, "shingles", SLICE):
            found = []
            for root, a, c, own, s1, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (root, a, c) != at:
                    found += links()
                    group, at = [], (root, a, c)
                group.append((own, s1, unpacked(data)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])
        if found := links():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "s1").mapInArrow(contracted(join), "u long, v long")


def near_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    head = stored(heads(docs, text))
    since = scratch_made()
    listed = frequent(docs, text)
    groups = stored(components(candidate_edges(docs, listed, text)))
    drop_scratch(docs.sparkSession, since)
    sizes = head.where("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n")).select(F.expr(f"s1 & {NODE}").alias("node"), "n")
    groups = stored(parted(docs, groups, sizes, text))
    drop_scratch(docs.sparkSession, since)
    linked = components(group_links(docs, groups, sizes, text))
    classes = head.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    rooted = classes.join(linked, F.col("s1") == F.col("node"), "left").select("s1", "s2", "first", "rows", "root")
    shared = stored(rooted.where("rows > 1 OR root IS NOT NULL"))
    drop_scratch(docs.sparkSession, since)
    least = shared.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    named = stored(shared.join(least, "root", "left").select("s1", "s2", "rows", F.coalesce("least", "first").alias("component_id")))
    drop_scratch(docs.sparkSession, since)
    often = max(1000, head.count() // 256)
    hot = F.broadcast(named.where(F.col("rows") > often).drop("rows"))  # at most 256 classes
    cold = named.where(F.col("rows") <= often).drop("rows")
    out = head.join(hot, ["s1", "s2"]).unionByName(head.join(hot, ["s1", "s2"], "left_anti").join(cold, ["s1", "s2"], "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with, of each component, only the rows of its smallest id; the same columns."""
    gone = near_components(docs, text).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


#: The query's rows by all pairs of documents that share a shingle; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, y FROM reach JOIN ends ON r = x)
SELECT CAST(d AS BIGINT) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, CAST(min(r) AS BIGINT) AS component_id FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
