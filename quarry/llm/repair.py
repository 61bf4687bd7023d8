"""Repair of conversations: the cheapest edits after which roles alternate, found by A* on the edit lattice.

A node of the lattice is (rows read, last role written); a repaired conversation has the role
initials ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (3), Delete (4, required for blank
and duplicate rows), Insert an empty row of user or assistant (3); a truncated row that stays costs 3 more.
The heuristic is a suffix sum: 4 for each mandatory deletion and 3 for each truncated row ahead,
as such a row is charged whether it stays (3) or goes (4). It never exceeds what is left to pay, and falls by no more than an edge costs, so
with the key (cost plus heuristic, audit) the first arrival at a node is its cheapest and, of equal
ones, that with the ASCII-least audit, the initials of its edits in order. The last role is known from
the audit, so the audit fixes the repaired conversation.

At scale: equal rows of a turn are counted before they are moved. Rows are dealt by ranges of (conversation, turn),
so that a conversation of any length is spread over tasks, and each task cuts its rows to segments of at most
``SEGMENT`` rows or ``SEGMENT_BYTES``. A conversation within one segment of one task is finished there. For the others,
the search gives each segment's cheapest edits between every pair of last roles; these chain, as equally
cheap audits of one segment are never prefixes of each other. A chain holds the audits of
its conversation, which its row of the result holds anyway; texts are only streamed, as one SHA-256 over a
conversation has to be made in order.

Defined results: a null text or role is one space, a null turn comes first, a null id is
a conversation of its own; rows of one turn are taken by role, first 64 characters of text and digest of
role and text; an initial is a role's first character ('' for an empty role); a conversation without rows
gets zeros and an empty audit; an empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Batches, lean, stored

RIGHT, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space as the contract has it.
SPACE = " \t\n\x0b\x0c\r"
#: Role that follows a last role ('' before any).
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows and bytes of one segment.
SEGMENT, SEGMENT_BYTES = 1024, 1 << 20
CLEAN, GOES, CUT = 0, 1, 2


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: faults put in by crc32 of ``conv_id:turn``; a dropped row has 0 copies."""
    by = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), by.alias("_by"))
        .select(
            "conv_id",
            "turn",
            F.expr("CASE _by WHEN 0 THEN '' WHEN 4 THEN 'user' ELSE role END AS role"),
            F.expr("CASE WHEN _by IN (0, 1) THEN '' WHEN _by = 2 THEN translate(text, '.!?', '') ELSE text END AS text"),
            F.expr("CASE _by WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END AS copies"),
        )
    )


def undamaged(turns: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))


@dataclass
class Row:
    initial: str
    kind: int  # CLEAN, GOES (has to be deleted), CUT (truncated)
    role: str
    text: str


def search(rows: list[Row], entry: str = "", exits: tuple[str, ...] = ("", "a"), all_exits: bool = False) -> dict[str, tuple[int, str]]:
    """Cheapest (cost, audit) from last role ``entry`` through ``rows`` to the first of ``exits`` reached, or to each."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i].kind == GOES else TRUNCATED if rows[i].kind == CUT else 0)
    queue = [(ahead[0], "", 0, entry)]
    done: set[tuple[int, str]] = set()
    found: dict[str, tuple[int, str]] = {}
    while queue:
        key, audit, i, last = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        cost, follows = key - ahead[i], NEXT[last]
        if i == n and last in exits:
            found[last] = (cost, audit)
            if not all_exits or len(found) == len(exits):
                break
        heapq.heappush(queue, (key + INSERT, audit + "I", i, follows))
        if i == n:
            continue
        row, left = rows[i], ahead[i + 1]
        heapq.heappush(queue, (cost + DELETE + left, audit + "D", i + 1, last))
        if row.kind != GOES:
            stays = cost + left + (TRUNCATED if row.kind == CUT else 0)
            if row.initial == follows or (row.initial == "s" and last == ""):
                heapq.heappush(queue, (stays, audit + "K", i + 1, row.initial))
            heapq.heappush(queue, (stays + REROLE, audit + "R", i + 1, follows))
    return found


def repaired(rows: list[Row], audit: str, last: str = "") -> tuple[list[str], str]:
    """The lines ``role:text`` that an audit writes from last role ``last``, and the last role after them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        row = rows[at] if edit != "I" else None
        last = row.initial if edit == "K" else NEXT[last]
        out.append(f"{row.role if edit == 'K' else NAMES[last]}:{row.text if row else ''}")
        at += edit != "I"
    return out, last


@dataclass
class Segment:
    """Consecutive rows of one conversation, with what counts need of them."""

    conversation: int | None
    opens: bool  # the conversation's first rows are here, for sure
    rows: list[Row] = field(default_factory=list)
    size: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: list[int] = field(default_factory=list)  # first, last; sorted
    distinct: int = 0

    def add(self, row: Row, blank: bool) -> None:
        if self.rows and self.rows[-1].initial + row.initial not in LEGAL:
            self.illegal += 1
        self.rows.append(row)
        self.size += len(row.text) + len(row.role)
        self.blank += blank
        self.duplicate += row.kind == GOES and not blank
        self.truncated += row.kind == CUT

    def turn(self, turn: int | None) -> None:
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1

    def full(self, limit: int) -> bool:
        return len(self.rows) >= limit or self.size >= SEGMENT_BYTES


COUNTS = ("blank", "duplicate", "truncated", "illegal")
WAYS = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
PIECES = pa.list_(pa.struct([("initial", pa.string()), ("role", pa.string()), ("text", pa.string())]))
PART = pa.schema(
    [("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int64()), ("no", pa.int64())]
    + [(c, pa.int64()) for c in (*COUNTS, "low", "high", "distinct", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("ends", pa.list_(pa.string())), ("ways", WAYS), ("pieces", PIECES)]
)
PART_DDL = (
    "conv_id long, whole boolean, part long, no long, blank long, duplicate long, truncated long, illegal long, low long, high long, distinct long, cost long, "
    "audit string, repaired_sha256 string, ends array<string>, ways array<struct<entry:string,exit:string,cost:long,audit:string>>, pieces array<struct<initial:string,role:string,text:string>>"
)


def _record(s: Segment, whole: bool, part: int, no: int) -> dict:
    low, high = s.turns or (None, None)
    out = {"conv_id": s.conversation, "whole": whole, "part": part, "no": no, "low": low, "high": high, "distinct": s.distinct} | {c: getattr(s, c) for c in COUNTS}
    if whole:
        cost, audit = min(search(s.rows).values(), default=(0, ""))
        return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(repaired(s.rows, audit)[0]).encode("utf-8", "surrogatepass")).hexdigest()}
    ways = [
        {"entry": entry, "exit": end, "cost": cost, "audit": audit}
        for entry in ([""] if s.opens else NEXT)
        for end, (cost, audit) in search(s.rows, entry, tuple(NEXT), all_exits=True).items()
    ]
    return out | {"ends": [s.rows[0].initial, s.rows[-1].initial] if s.rows else [], "ways": ways, "pieces": [{"initial": r.initial, "role": r.role, "text": r.text} for r in s.rows]}


def _segments(batches: Batches, limit: int) -> Iterator[tuple[Segment, bool]]:
    """Segments of a task's sorted rows, each with whether its conversation ends here for sure."""
    now: Segment | None = None
    for batch in batches:
        for conversation, turn, role, text, copies, first in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if now is None or now.conversation != conversation:
                if now is not None:
                    yield now, True
                now = Segment(conversation, opens=now is not None)
            if not copies:
                continue
            end = text.rstrip(SPACE)[-1:]
            later = Row(role[:1], GOES, role, text)
            for k in range(copies):
                if now.full(limit):
                    yield now, False
                    now = Segment(conversation, opens=False)
                now.turn(turn)
                now.add(later if k or not first or not end else Row(role[:1], CLEAN if end in ".!?" else CUT, role, text), blank=not end)
    if now is not None:
        yield now, False


def _parts(batches: Batches, limit: int) -> Batches:
    """One record of each segment; (part, no) is their order, as parts are ranges."""
    held: list[dict] = []
    size = 0
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    for no, (segment, ends) in enumerate(_segments(batches, limit)):
        held.append(_record(segment, segment.opens and ends, part, no))
        size += 200 if held[-1]["whole"] else segment.size + 64 * len(segment.rows)
        if len(held) >= 4096 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=PART)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=PART)


def chain(segments: list[list[dict]]) -> tuple[int, list[tuple[str, str]]]:
    """Cheapest cost through the ways of consecutive segments, and (entry, audit) of each segment, of equal ones the ASCII-least."""
    best: dict[str, tuple] = {"": (0, None)}  # last role: cost, (entry, audit, what came before)
    for ways in segments:
        after: dict[str, tuple] = {}
        for way in ways:
            if way["entry"] in best:
                cost, before = best[way["entry"]]
                new = (cost + way["cost"], (way["entry"], way["audit"], before))
                old = after.get(way["exit"])
                if old is None or new[0] < old[0] or (new[0] == old[0] and _less(new[1], old[1])):
                    after[way["exit"]] = new
        best = after
    ends = [best[e] for e in ("", "a") if e in best]
    least = min(e[0] for e in ends)
    at = None
    for cost, path in ends:
        if cost == least and (at is None or _less(path, at)):
            at = path
    out = []
    while at:
        out.append(at[:2])
        at = at[2]
    return least, out[::-1]


def _less(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audits of chain ``a`` come before those of ``b``; both have as many links, and share all before they meet."""
    own, other = [], []
    while a is not b:
        own.append(a[1])
        other.append(b[1])
        a, b = a[2], b[2]
    return "".join(reversed(own)) < "".join(reversed(other))


CHAINED = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("entry", pa.string()), ("edits", pa.string())] + [("at", pa.int64())] + [(c, pa.int64()) for c in (*COUNTS, "gaps", "cost")])
CHAINED_DDL = "part long, no long, entry string, edits string, at long, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"


def _runs(batches: Batches) -> Iterator[list[dict]]:
    """Consecutive records of one conversation."""
    held: list[dict] = []
    for batch in batches:
        for record in batch.to_pylist():
            if held and held[-1]["conv_id"] != record["conv_id"]:
                yield held
                held = []
            held.append(record)
    if held:
        yield held


def _chains(batches: Batches) -> Batches:
    """One record of each segment: its edits; the first has the sums of the conversation."""
    for run in _runs(batches):
        cost, path = chain([r["ways"] for r in run])
        sums = {c: sum(r[c] for r in run) for c in COUNTS}
        ends = [r["ends"] for r in run if r["ends"]]
        sums["illegal"] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
        turns = [r for r in run if r["low"] is not None]
        distinct = sum(r["distinct"] for r in turns) - sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:], strict=False))
        sums |= {"cost": cost, "gaps": turns[-1]["high"] - turns[0]["low"] + 1 - distinct if turns else 0}
        yield pa.RecordBatch.from_pylist([{"part": r["part"], "no": r["no"], "entry": entry, "edits": edits, "at": i} | (sums if not i else {}) for i, (r, (entry, edits)) in enumerate(zip(run, path, strict=True))], schema=CHAINED)


RESULT = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Batches) -> Batches:
    """Streams the segments of conversations in order; holds one segment's texts."""
    now: dict | None = None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: now[k] for k in RESULT.names if k in now} | {"audit": "".join(now["edits"]), "repaired_sha256": now["sha"].hexdigest()}], schema=RESULT)

    for batch in batches:
        for record in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            if not record["at"]:
                if now is not None:
                    yield closed()
                now = record | {"edits": [], "sha": hashlib.sha256(), "any": False}
            lines = repaired([Row(p["initial"], CLEAN, p["role"], p["text"]) for p in record["pieces"] or []], record["edits"], record["entry"])[0]
            for line in lines:
                now["sha"].update((("\n" if now["any"] else "") + line).encode("utf-8", "surrogatepass"))
                now["any"] = True
            now["edits"].append(record["edits"])
    if now is not None:
        yield closed()


def repairs(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row of each conversation of ``conv_id, turn, role, text, copies``: counts of faults, cost, audit and digest of the repaired turns.

    ``segment``: rows of a conversation that are searched at once.
    """
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "copies")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_same", same)
    # Of rows that are equal in role and text, the first by turn; a null turn comes first.
    seen = counted.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("_same").alias("_s")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("_first"))
    marked = counted.join(seen, counted.conv_id.eqNullSafe(seen._c) & (counted._same == seen._s), "left").withColumn("first", F.coalesce(F.col("turn").eqNullSafe(F.col("_first.turn")), F.lit(False)))
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.col("_same")]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "copies", "first")
    parts = stored(dealt.mapInArrow(lean(functools.partial(_parts, limit=segment)), PART_DDL))
    whole = parts.where("whole").selectExpr("conv_id", "CASE WHEN distinct = 0 THEN 0 ELSE high - low + 1 - distinct END AS gaps", *COUNTS, "cost", "audit", "repaired_sha256")
    cut = parts.where("NOT whole")
    deal = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    chained = deal(cut.select("conv_id", "part", "no", *COUNTS, "low", "high", "distinct", "ends", "ways")).mapInArrow(lean(_chains), CHAINED_DDL)
    texts = cut.select("conv_id", "part", "no", "pieces").join(chained, ["part", "no"])
    return whole.unionByName(deal(texts).mapInArrow(lean(_digests), RESULT_DDL))


def _plus(value: str, cost: int | str, edit: str) -> str:
    """SQL: an encoded (cost, audit) after one more edit."""
    return f"lpad((substr({value}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({value}, 9) || '{edit}'"


_STAY = "CASE WHEN kind = 2 THEN 3 ELSE 0 END"
_KEEP = lambda value, initial: f"CASE WHEN kind <> 1 AND initial = '{initial}' THEN {_plus(value, _STAY, 'K')} END"
_RENAME = lambda value: f"CASE WHEN kind <> 1 THEN {_plus(value, f'({_STAY} + 3)', 'R')} END"
#: The same by a table of the cheapest encoded (cost, audit) at each last role, row by row, without a search.
ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS g(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS codes FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS b FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN b = 4 THEN 'user' ELSE role END AS role,
    CASE b WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN b = 3 THEN 2 ELSE 1 END)) AS again FROM hashed WHERE b <> 0),
ends AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(length(role) || ':' || role || text)) AS i FROM damaged),
places AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeats FROM ends),
faults AS (
  SELECT *, last = '' AS blank, last <> '' AND repeats AS duplicate, last <> '' AND NOT repeats AND last NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM places),
kinds AS MATERIALIZED (SELECT *, CASE WHEN blank OR duplicate THEN 1 WHEN truncated THEN 2 ELSE 0 END AS kind FROM faults),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS z, NULL::VARCHAR AS s, '00000003I' AS u, NULL::VARCHAR AS a FROM kinds WHERE i = 1
  UNION ALL
  SELECT conv_id, i, z, s, least(u, {_plus("z", 3, "I")}, {_plus("s", 3, "I")}, {_plus("a", 3, "I")}), least(a, {_plus("u", 3, "I")}) FROM (
    SELECT k.conv_id, k.i, {_plus("z", 4, "D")} AS z, least({_plus("s", 4, "D")}, {_KEEP("z", "s")}) AS s,
      least({_plus("u", 4, "D")}, {_KEEP("z", "u")}, {_KEEP("s", "u")}, {_KEEP("a", "u")}, {_RENAME("z")}, {_RENAME("s")}, {_RENAME("a")}) AS u,
      least({_plus("a", 4, "D")}, {_KEEP("u", "a")}, {_RENAME("u")}) AS a
    FROM steps p JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.i = p.i + 1)),
best AS (SELECT conv_id, arg_max(least(z, a), i) AS found FROM steps GROUP BY conv_id),
edits AS (SELECT conv_id, unnest(string_split(substr(found, 9), '')) AS edit, generate_subscripts(string_split(substr(found, 9), ''), 1) AS pos FROM best WHERE length(found) > 8),
placed AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS e FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
written AS (
  SELECT p.conv_id, p.pos, p.edit, p.e, k.role, k.text, max(CASE WHEN p.e = 1 AND p.edit = 'K' AND k.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
  FROM placed p LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.i = p.i AND p.edit <> 'I'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS whole
  FROM written WHERE edit <> 'D' GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM kinds GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(found, 1, 8)::BIGINT, 0) AS cost, coalesce(substr(found, 9), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
