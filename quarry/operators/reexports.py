"""The names that modules offer, through chains of re-exports.

``definitions`` are (module, name); ``exports`` are (module, name, source, source_name): a name taken from another
module, under its own or a new name, or, with both names null, all names of the source (a wildcard). A module's own names,
defined or exported by name, shadow what a wildcard brings. The closure runs over (module, name, origin) in
rounds, each joined with the exports by source, so that a module with many names or users is spread as any join is;
it ends when a round brings nothing, however long the chains are, or after ``depth`` rounds, where one is given. A ring of wildcards ends by itself, as known names are not new.
Rounds join by sorted shuffles: tables are broadcast in none, as what rounds send to the driver would add up.

Defined results: an export of what its source does not offer brings nothing; rows that repeat count once; a name with several
origins has a row for each, marked ``ambiguous``; rows without a module or with one name null are left out.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.shared import stored

#: Rounds after which what is known is written as one table, so that plans do not grow with the longest chain.
ROUNDS = 16


def surface(definitions: DataFrame, exports: DataFrame, depth: int | None = 16) -> DataFrame:
    """``module, name, origin, origin_name, hops, ambiguous``: hops is the least number of re-exports between.

    Chains of more than ``depth`` re-exports are left out; with None there is no bound.
    """
    defined = definitions.where("module IS NOT NULL AND name IS NOT NULL").select("module", "name").distinct()
    links = exports.where("module IS NOT NULL AND source IS NOT NULL").select("module", "name", "source", "source_name").distinct()
    named = stored(links.where("name IS NOT NULL AND source_name IS NOT NULL"))
    wild = stored(links.where("name IS NULL AND source_name IS NULL").select("module", "source"))
    own = stored(defined.unionByName(named.select("module", "name")).distinct())
    origin = ["module", "name", "origin", "origin_name"]
    frontier = stored(defined.select("module", "name", F.col("module").alias("origin"), F.col("name").alias("origin_name"), F.lit(0).alias("hops")))
    found = frontier
    for hops in count(1) if depth is None else range(1, depth + 1):
        if hops > ROUNDS and hops % ROUNDS == 1:
            found = stored(found)
        given = frontier.select(F.col("module").alias("source"), F.col("name").alias("source_name"), "origin", "origin_name")
        taken = given.join(named.hint("merge"), ["source", "source_name"]).select(*origin)
        brought = given.join(wild.hint("merge"), "source").select("module", F.col("source_name").alias("name"), "origin", "origin_name").join(own.hint("merge"), ["module", "name"], "left_anti")
        step = taken.unionByName(brought).distinct()
        frontier = stored(step.join(found.select(*origin).hint("merge"), origin, "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    counts = found.groupBy("module", "name").agg((F.count("*") > 1).alias("ambiguous"))
    return found.join(counts.hint("merge"), ["module", "name"])
