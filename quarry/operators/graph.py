"""Traversals of an edge table (src, dst): reach, shortest paths, cycles, blast radius, packing.

Each round of a traversal is a join of the frontier with the edges, an anti-join with
what is known, and a write to the shared folder; nothing but counts reaches the driver.
Only the declared contracts of these tools are known, so ties and orders are stated here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.operators.shared import stored


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """``node, depth`` (1 at least) of all that ``sources`` (node) reach; a source only if a cycle leads back to it."""
    edges = stored(edges.select("src", "dst")) if depth is None or depth > 1 else edges  # read again in every round
    start = stored(sources.select("node").distinct())
    frontier, known, level = start, None, 0
    while depth is None or level < depth:
        level += 1
        step = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        if known is not None:
            step = step.join(known.select("node"), "node", "left_anti")
        frontier = stored(step.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        known = frontier if known is None else known.unionByName(frontier)
        frontier = frontier.select("node")
    return known if known is not None else start.withColumn("depth", F.lit(0)).where("false")


def capped(found: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows in order, each with the exact ``total``."""
    found = stored(found)  # read for the total and for the rows
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(*order).limit(limit).join(F.broadcast(total), F.lit(True))


def tagged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``external``: the target is not among ``nodes`` (node)."""
    inner = nodes.select(F.col("node").alias("dst"), F.lit(False).alias("_in")).distinct()
    return edges.join(inner, "dst", "left").select("src", "dst", F.coalesce("_in", F.lit(True)).alias("external"))


def shortest_path(edges: DataFrame, ends: DataFrame, hops: int = 12) -> DataFrame:
    """``position, node`` of a shortest path of at most ``hops`` edges, the smallest of them as a list; both ends if none.

    ``ends``: one row of start and goal. The search goes from both ends, a level of the smaller
    frontier a round, and keeps nodes only. Where the frontiers meet, the levels are walked back for the edges
    of shortest paths, and the path takes the smallest node of each next level.
    """
    edges, ends = stored(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))), stored(ends.select(F.col("start").cast("long"), F.col("goal").cast("long")))
    none = ends.select(F.posexplode(F.array("start", "goal")).alias("position", "node"), F.lit(False).alias("found"))
    ahead, back = [ends.select(F.col("start").alias("node"))], [ends.select(F.col("goal").alias("node"))]
    sizes = [1, 1]
    meeting = None
    # A path has an edge at least, so a start that is its own goal meets after a step.
    while len(ahead) + len(back) - 2 < hops:
        levels, turned = (ahead, False) if sizes[0] <= sizes[1] else (back, True)
        step = (reversed_edges(edges) if turned else edges).join(levels[-1], F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        for level in levels[1:]:
            step = step.join(level, "node", "left_anti")
        levels.append(stored(step))
        sizes[turned] = levels[-1].count()
        if not sizes[turned]:
            return none
        meeting = ahead[-1].join(back[-1], "node", "left_semi")
        if not meeting.isEmpty():
            break
    else:
        return none
    # Edges of shortest paths: backwards from the meeting to the start, then on to the goal.
    parts, wanted = [], stored(meeting)
    for i in range(len(ahead) - 1, 0, -1):
        part = stored(edges.join(wanted.select(F.col("node").alias("dst")), "dst", "left_semi").join(ahead[i - 1].select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"))
        parts.insert(0, part)
        wanted = part.select(F.col("src").alias("node")).distinct()
    wanted = meeting
    for i in range(len(back) - 1, 0, -1):
        part = stored(edges.join(wanted.select(F.col("node").alias("src")), "src", "left_semi").join(back[i - 1].select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        parts.append(part)
        wanted = part.select(F.col("dst").alias("node")).distinct()
    path = [ends.first().start]
    for part in parts:  # one node of each level
        path.append(part.where(F.col("src") == path[-1]).agg(F.min("dst")).first()[0])
    return edges.sparkSession.createDataFrame([(i, n, True) for i, n in enumerate(path)], "position int, node long, found boolean")


def jumped(chain: DataFrame) -> DataFrame:
    """``node, back, ahead, low, open`` of nodes with one edge in and one out: pointers past the chain's ends, by doubling.

    ``open`` nodes are those of rings, which have no ends; ``low`` is the ring's smallest node.
    """
    now, last = stored(chain.select("node", "back", "ahead", F.col("node").alias("low"), F.lit(True).alias("_a"), F.lit(True).alias("_b"))), -1
    # As pointers that are not past an end are equally long both ways, a node is pointed to by those that it points to, and sends each
    # its own pointer on: one shuffle a round. One that heard nothing from a side points past that end, and sends nothing there;
    # one that heard from neither is done.
    done: list[DataFrame] = []
    null = F.lit(None).cast(chain.schema["node"].dataType)
    while True:
        send = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("to", "back", "ahead", "low", "_back", "_ahead", "_low"), strict=True)))
        sent = F.array(
            send(F.col("node"), F.col("back"), F.col("ahead"), F.col("low"), null, null, null),
            F.when(F.col("_b"), send(F.col("back"), null, null, null, null, F.col("ahead"), F.col("low"))),
            F.when(F.col("_a"), send(F.col("ahead"), null, null, null, F.col("back"), null, null)),
        )
        heard = now.select(F.inline(F.filter(sent, lambda x: x.isNotNull()))).groupBy(F.col("to").alias("node")).agg(*(F.max(c).alias(c) for c in ("back", "ahead", "low", "_back", "_ahead", "_low"))).where("low IS NOT NULL")
        low = F.least("low", F.coalesce("_low", "low"))
        now = stored(heard.select("node", F.coalesce("_back", "back").alias("back"), F.coalesce("_ahead", "ahead").alias("ahead"), low.alias("low"), F.col("_ahead").isNotNull().alias("_a"), F.col("_back").isNotNull().alias("_b"), (low < F.col("low")).alias("_moved")))
        going, moved = now.agg(F.sum(F.col("_a").cast("int") + F.col("_b").cast("int")), F.count_if("_moved")).first()
        # Each round brings more pointers past an end; once none is, only rings go on, until each is known whole.
        if not going or (going == last and not moved):
            break
        done.append(now.where("NOT (_a OR _b)"))
        now, last = now.where("_a OR _b"), going
    for part in done:
        now = now.unionByName(part)
    return now.select("node", "back", "ahead", "low", (F.col("_a") & F.col("_b")).alias("open"))


def cycles(edges: DataFrame, min_size: int = 2) -> DataFrame:
    """``component, node`` of strongly connected components of ``min_size`` nodes, or of one node with an edge to itself.

    ``component`` is the smallest node. Rounds of two steps first make the graph small: nodes without an edge in or out
    are in no cycle and go; chains of nodes with one edge in and one out become an edge each, by pointer doubling, so
    that a chain takes logarithmically many rounds, and a ring is a component at once. A chain's nodes are in its ends'
    component if both ends are in one. What is left is coloured: a node's colour is the smallest node that reaches
    it, and within a colour all that reach that node are its component.
    """
    edges = stored(edges.select("src", "dst").distinct())
    own = edges.where("src = dst").select(F.col("src").alias("component"), F.col("src").alias("node"))
    left = stored(edges.where("src != dst"))
    size = left.count()
    chains: list[DataFrame] = []
    rings: list[DataFrame] = []
    while size:
        left = stored(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        ins = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.max("src").alias("back")).where("n = 1")
        outs = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("dst").alias("ahead")).where("n = 1")
        chain = stored(ins.drop("n").join(outs.drop("n"), "node"))
        if not chain.isEmpty():
            ends = jumped(chain)
            rings.append(ends.where("open").select(F.col("low").alias("component"), "node"))
            chains.append(ends.where("NOT open").select("node", "back", "ahead"))
            inside = chain.select("node")
            kept = left.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(inside.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            left = stored(kept.unionByName(chains[-1].where("back != ahead").select(F.col("back").alias("src"), F.col("ahead").alias("dst"))).distinct())
        before, size = size, left.count()
        if size > 0.9 * before:
            break
    found = _coloured(left)
    # Components of the ends are known from the last round's to the first's.
    for chain in reversed(chains):
        at = lambda end: (found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) if found is not None else chain.select(end, F.col(end).alias(f"_{end}")).where("false"))  # noqa: E731, B023
        told = chain.join(at("back"), "back", "left").join(at("ahead"), "ahead", "left").selectExpr("node", "back", "coalesce(_back, back) AS _b", "coalesce(_ahead, ahead) AS _a").where("_b = _a")
        part = stored(told.select(F.col("_b").alias("component"), "node", "back"))
        both = part.select("component", "node").unionByName(part.select("component", F.col("back").alias("node")))
        found = stored((both if found is None else found.unionByName(both)).distinct())
    for ring in rings:
        found = ring if found is None else found.unionByName(ring)
    if found is None:
        return own
    # The ends' component was named by its smallest end; now by its smallest node.
    sized = found.join(found.groupBy("component").agg(F.min("node").alias("_least"), F.count("*").alias("_n")), "component")
    large = sized.where(F.col("_n") >= min_size).select(F.col("_least").alias("component"), "node")
    return large.unionByName(own.join(large.select("node"), "node", "left_anti").select("component", "node")).distinct()


def _coloured(left: DataFrame) -> DataFrame | None:
    """Strongly connected components (component, node) of edges without loops, single nodes among them; None if there is none."""
    found = None
    while not left.isEmpty():
        # Nodes without an edge in or out are in no cycle.
        trimmed = stored(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if trimmed.count() < left.count():
            left = trimmed
            continue
        nodes = left.select(F.col("src").alias("node")).distinct()
        colour = stored(nodes.withColumn("colour", F.col("node")))
        while True:
            pushed = left.join(colour, left.src == colour.node).select(F.col("dst").alias("node"), "colour").unionByName(colour)
            after = stored(pushed.groupBy("node").agg(F.min("colour").alias("colour")))
            moved = after.join(colour.withColumnRenamed("colour", "was"), "node").where("colour != was").limit(1).count()
            colour = after
            if not moved:
                break
        c1, c2 = colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2"))
        inner = stored(left.join(c1, "src").join(c2, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour")))
        back = stored(colour.where("node = colour").select("node", "colour"))
        frontier = back
        while True:
            step = inner.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct().join(back, ["node", "colour"], "left_anti")
            frontier = stored(step)
            if frontier.isEmpty():
                break
            back = back.unionByName(frontier)
        part = stored(back.select(F.col("colour").alias("component"), "node"))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        left = stored(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return found


def impact(calls: DataFrame, imports: DataFrame, target: DataFrame, tests: DataFrame, depth: int = 2, mode: str = "all") -> DataFrame:
    """``section, node, depth``: callers, callees, dependents and the tests among them."""
    sections = []
    if mode in ("deps", "all"):
        sections.append(reach(calls, target, depth).select(F.lit("callees").alias("section"), "node", "depth"))
    if mode in ("dependents", "all", "tests"):
        callers = reach(reversed_edges(calls), target, depth)
        importers = reach(reversed_edges(imports), target, depth)
        if mode != "tests":
            sections += [callers.select(F.lit("callers").alias("section"), "node", "depth"), importers.select(F.lit("dependents").alias("section"), "node", "depth")]
        if mode != "dependents":
            near = callers.unionByName(importers).groupBy("node").agg(F.min("depth").alias("depth")).join(tests.select("node").distinct(), "node", "left_semi")
            sections.append(near.select(F.lit("tests").alias("section"), "node", "depth"))
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def pack(items: DataFrame, budget: int, *partition: str, order: str = "priority", size: str = "bytes") -> DataFrame:
    """Prefix of the items in order whose tokens (4 bytes each, rounded up) fit the budget; adds ``tokens``, ``used``."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sized = items.withColumn("tokens", F.ceil(F.col(size) / 4).cast("long"))
    return sized.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def suffixes(name: Column) -> Column:
    """A dotted name and every tail of whole parts, the longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))


def named(symbols: DataFrame, target: str) -> DataFrame:
    """``node``: the symbols (name) that are ``target`` or end in it by whole parts."""
    return symbols.where((F.col("name") == target) | F.endswith("name", F.lit("." + target))).select(F.col("name").alias("node")).distinct()


def subtypes(bases: DataFrame, target: str, direct: bool = False) -> DataFrame:
    """``type, depth`` of the types below those that ``target`` names, nearest way; ``bases``: type, base.

    Both columns hold full names. With ``direct`` only the first level.
    """
    edges = bases.where("type IS NOT NULL AND base IS NOT NULL").select(F.col("base").alias("src"), F.col("type").alias("dst"))
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name")))
    return reach(edges, named(names, target), 1 if direct else None).select(F.col("node").alias("type"), "depth")


def callers_of(calls: DataFrame, symbols: DataFrame, target: str, limit: int = 200, hide_ambiguous: bool = False) -> DataFrame:
    """``caller, callee, ambiguous, total``: the first ``limit`` callers by name, with their exact number.

    ``calls``: caller, callee as written, a full name or a tail of one; ``symbols``: name. A
    call is ambiguous if its written name is a tail of several symbols.
    """
    wanted = named(symbols, target).select(F.explode(suffixes(F.col("node"))).alias("callee")).distinct()
    tails = symbols.select("name").distinct().select("name", F.explode(suffixes(F.col("name"))).alias("callee"))
    candidates = tails.join(wanted, "callee", "left_semi").groupBy("callee").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    found = calls.select("caller", "callee").distinct().join(candidates, "callee").select("caller", "callee", "ambiguous")
    return capped(found.where("NOT ambiguous") if hide_ambiguous else found, limit, "caller", "callee")


def with_bodies(steps: DataFrame, bodies: DataFrame, max_lines: int = 40) -> DataFrame:
    """``steps`` (node and more) with ``body``, the first ``max_lines`` lines of it, and ``cut``; both null where none is known.

    ``bodies``: node, body. Of several bodies of a node the first in order of text is taken.
    """
    lines = F.split("body", "\n")
    one = bodies.groupBy("node").agg(F.min("body").alias("body")).select("node", F.array_join(F.slice(lines, 1, max_lines), "\n").alias("body"), (F.size(lines) > max_lines).alias("cut"))
    return steps.join(one, "node", "left")
