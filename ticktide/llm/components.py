"""Connected components of links, by alternating stars (Kiveris et al. 2014).

Every round rewrites the links by a large and a small star and writes them to the
shared folder; the rounds end when a round changes nothing. No link or label
goes to the driver but counts and checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, large: bool, n_links: int) -> DataFrame:
    """(node, low) links, written, after a large star or a small star of (a, b) with a <> b, a written table.

    The minimum of a node's neighbourhood is a partial aggregate; it comes back to
    the links by a join that broadcasts the hubs (at most BROADCAST_ROWS of them can
    exist), so that the links of a node in a large component stay where they are.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
    floor = max(100, 2 * n_links // common.BROADCAST_ROWS + 1)
    hubs, others = low.where(F.col("n") > floor).drop("n"), low.where(F.col("n") <= floor).drop("n")
    met = both.join(F.broadcast(hubs), "a").unionByName(
        both.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(others.hint("merge"), "a")
    )
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
    return common.stored(out.where("a <> b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b); component: its smallest node."""
    state = common.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        n, total = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return n, total

    before = mark(state)
    while before[0]:
        # a star has no more links than it began with
        state = _star(_star(state, True, before[0]), False, before[0])
        if (now := mark(state)) == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
