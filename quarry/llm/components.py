"""Connected components of an edge table, by rounds of local contraction.

Within each partition a union-find replaces the edges by one from each node to the
smallest node of its local component, so an edge ``u, v`` always has ``u > v`` and the
edges in a partition are fewer than its nodes. A round deals edges out twice:

1. by the larger end, where a node's edges from all partitions meet (there is at most
   one from each), and those to different smaller nodes connect these;
2. by the smaller end, if that has a smaller neighbour itself (a pointer): then that
   pointer goes there too, and its members move on to what it points to. Members of
   other nodes, such as those of a finished component's root, stay by their larger end.

Rounds end when no smaller end has a smaller neighbour and no node has two edges: then
each node points to its component's smallest. As pointers are followed from both ends,
the distance to it halves in each round.

Hot keys: a node that is the smaller end of more than a 256th of the edges (at most 256
such nodes) is dealt out under many salts, and its few pointers to each of them. Nothing
is collected but counts, the hot nodes and a bit map of 8 MB, which only saves shuffling.
Each round is written to the shared folder, so a lost executor costs one round.

Defined results: edges with a null end and loops are left out; repeated edges count
once; without edges there are no nodes; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Batches, bit_map, in_bit_map, lean, stored

#: A node is hot with more than one HOT-th of the edges, and this many at least.
HOT, LEAST_HOT = 256, 1000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes that are not the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        parent = parent[parent]
        if (parent == before).all():
            break
    while (parent[parent] != parent).any():
        parent = parent[parent]
    other = parent != np.arange(len(nodes))
    return nodes[other], nodes[parent[other]]


@lean
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are u and v; edges of one partition, narrow, are contracted as they come."""
    u = v = np.empty(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for b in batches:
        waiting.append((b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()))
        held += b.num_rows
        if held > max(1 << 19, len(u)):
            u, v = roots(np.concatenate([u, *(w[0] for w in waiting)]), np.concatenate([v, *(w[1] for w in waiting)]))
            waiting, held = [], 0
    if waiting:
        u, v = roots(np.concatenate([u, *(w[0] for w in waiting)]), np.concatenate([v, *(w[1] for w in waiting)]))
    for i in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], ["u", "v"])


def contracted(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, whose last two columns are edges, with these contracted in the same task and worker."""
    return lean(lambda batches: _contract.__wrapped__(run(batches)))


def _dealt(now: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """``key, salt, u, v``: edges by their smaller end where that has a pointer, else by the larger, and the pointers."""
    often = max(LEAST_HOT, n // HOT)
    found = ends.where(F.col("down") > often).select("node", F.ceil(F.col("down") / often).alias("salts")).toArrow()
    order = np.argsort(found.column("node").to_numpy())
    hot, salts = found.column("node").to_numpy()[order], found.column("salts").to_numpy()[order].astype(np.int64)
    middle = ends.where("up > 0 AND down > 0").select(F.col("node").alias("u"))
    bits = now.sparkSession.sparkContext.broadcast(bit_map(middle, "u"))

    def salts_of(node: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.ones(len(node), np.int64)
        at = np.minimum(np.searchsorted(hot, node), len(hot) - 1)
        return np.where(hot[at] == node, salts[at], 1)

    def rows(key: np.ndarray, salt: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(u), pa.array(v)], ["key", "salt", "u", "v"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (x.to_numpy() for x in b.columns)
            moves = in_bit_map(bits.value, v)
            yield rows(np.where(moves, v, u), np.where(moves, (u & 0xFFFF) % salts_of(v), 0), u, v)

    def pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (x.to_numpy() for x in b.columns)
            times = salts_of(u)
            at = np.repeat(np.arange(len(u)), times)
            yield rows(u[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), u[at], v[at])

    schema = "key long, salt long, u long, v long"
    return now.mapInArrow(members, schema).unionByName(now.join(middle, "u").select("u", "v").mapInArrow(pointers, schema))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (u, v), root being the smallest node it reaches.

    Edges are best ``contracted`` where they are made, as then a node has at most one from each partition.
    """
    by_larger = lambda e: stored(e.repartition("u").mapInArrow(_contract, "u long, v long"))
    ends = F.col("u").cast("long"), F.col("v").cast("long")
    now = by_larger(edges.where("u != v").select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")))
    while True:
        up, down = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        ends = stored(up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")))
        n, unsettled = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        if not unsettled:
            break
        now = by_larger(_dealt(now, ends, n).repartition("key", "salt").mapInArrow(_contract, "u long, v long"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
