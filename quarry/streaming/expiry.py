"""Expiring state: one-time receipts, idle sessions, and a registry that keeps the last good version.

Batch forms use windows and aggregates over whole tables; stream forms keep keyed state
with event-time or processing-time timeouts, which Spark writes to its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.streaming.folds import sorted_fold

RECEIPT_TTL_MS, MAX_RECEIPTS, MAX_BYTES, MAX_ONE = 300_000, 32, 16 << 20, 4 << 20


def sessions(events: DataFrame, gap_seconds: int = 1800, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Batch: ``key, started, last_seen, expires, events`` of runs of events with no gap of ``gap_seconds`` or more."""
    w = Window.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(w)) >= gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = events.where(F.col(ts).isNotNull()).withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_run").agg(F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("events")).withColumn("expires", F.col("last_seen") + F.make_interval(secs=F.lit(gap_seconds))).drop("_run")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 minute", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Stream: closed sessions, once the watermark is past their end."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "events")


RECEIPT_RESULT = "session string, token string, outcome string"
RECEIPT_STATE = "tokens array<string>, files array<string>, hashes array<string>, generations array<bigint>, sizes array<bigint>, expires array<bigint>"


def receipts(actions: DataFrame, ttl_ms: int = RECEIPT_TTL_MS, max_receipts: int = MAX_RECEIPTS, max_bytes: int = MAX_BYTES, max_one: int = MAX_ONE) -> DataFrame:
    """Stream of outcomes of preview and commit actions, keyed by session.

    Columns of ``actions``: session, action (preview, commit), token, file, sha256,
    generation, size, at_ms. A receipt is good once, before it expires, for the same file,
    source hash and configuration generation. A preview beyond the session's limits of
    number and bytes, or the limit of one candidate, is refused. Expired receipts go first.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for frame in frames:
            for a in frame.sort_values(["at_ms", "token"], kind="stable").itertuples():
                held = [h for h in held if h[5] > a.at_ms]
                if a.action == "preview":
                    fits = a.size <= max_one and len(held) < max_receipts and sum(h[4] for h in held) + a.size <= max_bytes
                    if fits:
                        held.append((a.token, a.file, a.sha256, int(a.generation), int(a.size), int(a.at_ms) + ttl_ms))
                    out.append((key[0], a.token, "issued" if fits else "preview_receipt_limit"))
                else:
                    found = next((h for h in held if h[0] == a.token), None)
                    if found is None:
                        outcome = "unknown_or_expired"
                    elif found[1] != a.file or found[3] != a.generation:
                        outcome = "not_bound"
                    elif found[2] != a.sha256:
                        outcome = "stale_or_missing_hash"
                    else:
                        outcome = "committed"
                        held.remove(found)
                    out.append((key[0], a.token, outcome))
        if held:
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "token", "outcome"])

    return actions.groupBy("session").applyInPandasWithState(run, RECEIPT_RESULT, RECEIPT_STATE, "append", GroupStateTimeout.NoTimeout)


REGISTRY_STATE = "generation long, config string, healthy boolean"
REGISTRY_RESULT = "root string, generation long, config string, healthy boolean"


def registry(loads: DataFrame) -> DataFrame:
    """Stream of the registry's entries, keyed by root.

    Columns of ``loads``: root, generation, config (null where loading failed). Older
    generations are ignored; a failed load makes the entry unhealthy and keeps its config.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, config, healthy = state.get if state.exists else (-1, None, False)
        for frame in frames:
            for r in frame.sort_values("generation", kind="stable").itertuples():
                if r.generation > generation:
                    generation = int(r.generation)
                    healthy = r.config is not None and r.config == r.config
                    config = r.config if healthy else config
        state.update((generation, config, healthy))
        yield pd.DataFrame([(key[0], generation, config, healthy)], columns=["root", "generation", "config", "healthy"])

    return loads.groupBy("root").applyInPandasWithState(run, REGISTRY_RESULT, REGISTRY_STATE, "update", GroupStateTimeout.NoTimeout)


def registry_batch(loads: DataFrame, key: str = "root") -> DataFrame:
    """Batch form: newest generation, last good config, health."""
    good = F.col("config").isNotNull()
    return loads.groupBy(key).agg(F.max("generation").alias("generation"), F.max_by("config", F.when(good, F.col("generation"))).alias("config"), F.max_by(good, "generation").alias("healthy"))


def least_recent(touches: DataFrame, key: str, at: str, keep: int = 128) -> DataFrame:
    """Keys that an LRU cache of ``keep`` entries evicts: all but the most recently touched."""
    last = touches.groupBy(key).agg(F.max(at).alias("last_touch"))
    kept = last.orderBy(F.desc("last_touch"), key).limit(keep).select(key)
    return last.join(F.broadcast(kept), key, "left_anti")  # kept has at most `keep` rows


def quota(items: DataFrame, session: str, size: str, *order: str, max_bytes: int = MAX_BYTES, max_items: int = MAX_RECEIPTS) -> DataFrame:
    """Items in order, whether each is accepted, and bytes and count that its session uses after it.

    An item that doesn't fit, or has no size, is refused and uses nothing, so whether one fits depends on
    which earlier ones did: a fold over a session's items.
    """

    def step(used: tuple[int, int], n: int | None) -> tuple[tuple[int, int], tuple]:
        fits = n is not None and used[0] + n <= max_bytes and used[1] < max_items
        used = (used[0] + n, used[1] + 1) if fits else used
        return used, (*used, fits)

    return sorted_fold(items, [session], list(order), [size], lambda: (0, 0), step, "used_bytes long, used_items long, accepted boolean")


def challenges(requests: DataFrame, max_pending: int = 64) -> DataFrame:
    """Per session, pending approval challenges at each request and whether one more is accepted.

    ``requests``: session, at_ms, expires_ms. Pending are earlier ones that have not expired:
    each request counts from its time on and no more from when it expires, as a running sum.
    """
    keyed = requests.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy("at_ms", "expires_ms")))
    starts = keyed.select("session", F.col("at_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(1).alias("_step"), "at_ms", "expires_ms", "_n")
    ends = keyed.where("expires_ms > at_ms").select("session", F.col("expires_ms").alias("_t"), F.lit(0).alias("_kind"), F.lit(-1).alias("_step"), F.lit(None).cast("long").alias("at_ms"), F.lit(None).cast("long").alias("expires_ms"), F.lit(0).alias("_n"))
    live = F.when((F.col("_kind") == 1) & (F.col("expires_ms") <= F.col("at_ms")), 0).otherwise(F.col("_step"))
    w = Window.partitionBy("session").orderBy("_t", "_kind", "_n").rowsBetween(Window.unboundedPreceding, -1)
    counted = starts.unionByName(ends).withColumn("pending", F.coalesce(F.sum(live).over(w), F.lit(0)).cast("long"))
    return counted.where("_kind = 1").select("session", "at_ms", "expires_ms", "pending", (F.col("pending") < max_pending).alias("accepted"))


ANSWERS = ("allow_once", "allow_session", "always_allow", "decline")


def grants(actions: DataFrame, ttl_ms: int = RECEIPT_TTL_MS) -> DataFrame:
    """Outcome of every request for an approval: ``session, grant, seq, outcome`` (allowed, denied, asked).

    ``actions``: seq (unique), session, invocation, grant, at_ms, action, which is request,
    allow_once, allow_session, always_allow or decline. A request that is not allowed opens
    a challenge of its session and grant for ``ttl_ms``, unless one is open. An answer counts
    only while one is open, and closes it. allow_once then holds for the invocation that
    answers, allow_session for its session, always_allow for every session from then on;
    decline denies the next request. Rows are sorted by key and folded as they stream, so a
    key of any length needs the state of one.
    """

    def step(state: tuple, at_ms: int, action: str, invocation: str | None) -> tuple[tuple, tuple]:
        opened, whole, once, declined = state
        live = opened is not None and at_ms < opened + ttl_ms
        outcome = None
        if action == "request":
            outcome = "allowed" if whole or invocation in once else "denied" if declined else "asked"
            declined = False
            if outcome == "asked" and not live:
                opened = at_ms
        elif live and action in ANSWERS:
            opened, outcome = None, action
            whole |= action == "allow_session"
            declined = action == "decline"
            if action in ("allow_once", "always_allow"):
                once.add(invocation)
        return (opened, whole, once, declined), (outcome,)

    wanted = actions.select(F.col("session").cast("string"), F.col("grant").cast("string"), F.col("seq").cast("long"), F.col("at_ms").cast("long"), "action", F.col("invocation").cast("string"))
    folded = sorted_fold(wanted, ["session", "grant"], ["seq"], ["at_ms", "action", "invocation"], lambda: (None, False, set(), False), step, "outcome string")
    judged = folded.where("outcome IS NOT NULL").select("session", "grant", "seq", "outcome")
    always = judged.where("outcome = 'always_allow'").groupBy("grant").agg(F.min("seq").alias("_from"))
    requests = judged.where(~F.col("outcome").isin(*ANSWERS)).join(always, "grant", "left")
    return requests.select("session", "grant", "seq", F.when(F.col("_from") < F.col("seq"), F.lit("allowed")).otherwise(F.col("outcome")).alias("outcome"))
