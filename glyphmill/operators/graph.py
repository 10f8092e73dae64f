"""Reachability and orders over edge tables, by rounds of joins over the frontier.

Each round joins only the nodes reached last with the edges, so the work follows
the number of edges; results stay distributed, and each round is written as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.session import durable, hinted


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth (the fewest edges) from edges(src, dst) and roots(node). A round writes its own nodes, and every eighth all of them."""
    frontier = durable(roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen, rounds = frontier, 0
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = durable(step.join(seen, "node", "left_anti"))
        seen, rounds = seen.unionByName(frontier), rounds + 1
        seen = seen if rounds % 8 else durable(seen)
    return seen


def told(nodes: DataFrame, constants: DataFrame) -> DataFrame:
    """nodes with `holds`: whether the condition (lhs, op, rhs) is known to hold, known not to, or null.

    An operand is a whole number or the name of one in constants(name, value); what is neither is unknown.  Without an operator the left
    operand itself is the condition (0 doesn't hold); without operands nothing is asked, and it holds.  Unknown operators tell nothing.
    """
    known = hinted(durable(constants.groupBy("name").agg(F.when(F.count_distinct("value") == 1, F.max("value").cast("long")).alias("value"))))
    for side in ("lhs", "rhs"):
        own = known.select(F.col("name").alias(f"_{side}_name"), F.col("value").alias(f"_{side}_value"))
        number = F.when(F.col(side).rlike("^[+-]?[0-9]{1,18}$"), F.expr(f"try_cast({side} AS BIGINT)"))
        nodes = nodes.join(own, F.col(side) == F.col(f"_{side}_name"), "left").withColumn(f"_{side}", F.coalesce(number, f"_{side}_value")).drop(f"_{side}_name", f"_{side}_value")
    a, b = F.col("_lhs"), F.col("_rhs")
    compared = F.when(F.col("op") == "==", a == b).when(F.col("op") == "!=", a != b).when(F.col("op") == "<", a < b).when(F.col("op") == "<=", a <= b).when(F.col("op") == ">", a > b).when(F.col("op") == ">=", a >= b)
    return nodes.withColumn("holds", F.when(F.col("op").isNotNull(), compared).when(F.col("lhs").isNull(), True).otherwise(a != 0)).drop("_lhs", "_rhs")


def reachable_if(nodes: DataFrame, constants: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What roots(script, pos) reach in scripts whose jumps have conditions: (script, pos), and the (script, pos, target) among them whose label isn't there.

    nodes(script, pos, kind, label, target, lhs, op, rhs) run in the order of pos; kind `jump` goes to the node of its script with the
    label `target`, `choose` may go there and goes on in any case, `stop` ends, anything else goes on.  A jump or stop goes on
    where its condition isn't known to hold, and a target counts where it isn't known not to, so what can't be told counts both
    ways.  Of labels that stand at several nodes the first is meant; a root that is no node reaches what follows it.

    Nodes that go on reach all that follows up to the next known end, so a stretch between ends is reached from its smallest entry on.  A
    round follows only the jumps of what was newly reached: rounds are as many as jumps in a row, however long the scripts.
    """
    leaves = F.col("kind").isin("jump", "stop") & F.coalesce("holds", F.lit(False))
    before = Window.partitionBy("script").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    asked = durable(told(nodes, constants).withColumn("stretch", F.coalesce(F.sum(leaves.cast("long")).over(before), F.lit(0))))
    labels = asked.where("label is not null").groupBy("script", F.col("label").alias("target")).agg(F.min_by(F.struct("stretch", "pos"), "pos").alias("aim"))
    jumps = asked.where(F.col("kind").isin("jump", "choose") & F.coalesce("holds", F.lit(True))).select("script", "stretch", "pos", "target")
    jumps = durable(jumps.join(labels, ["script", "target"], "left"))
    #: script, stretch, pos: the first position of each stretch that is reached; `past` is the one known before.
    ends = asked.groupBy("script", "stretch").agg(F.max("pos").alias("end"))
    entered = ends.join(roots.select("script", F.col("pos").alias("root")), "script").where("root <= end").groupBy("script", "root").agg(F.min_by("stretch", "end").alias("stretch"))
    best = durable(entered.groupBy("script", "stretch").agg(F.min("root").alias("pos")))
    new = best.withColumn("past", F.lit(None).cast(best.schema["pos"].dataType))
    while not new.isEmpty():
        fresh = new.select("script", "stretch", F.col("pos").alias("lo"), "past")
        step = jumps.where("aim is not null").join(fresh, ["script", "stretch"]).where("pos >= lo AND (past IS NULL OR pos < past)")
        step = step.groupBy("script", F.col("aim.stretch").alias("stretch")).agg(F.min("aim.pos").alias("pos"))
        known = best.select("script", "stretch", F.col("pos").alias("past"))
        new = durable(step.join(known, ["script", "stretch"], "left").where("past IS NULL OR pos < past").select("script", "stretch", "pos", "past"))
        best = durable(best.unionByName(new.drop("past")).groupBy("script", "stretch").agg(F.min("pos").alias("pos")))
    from_ = best.withColumnRenamed("pos", "lo")
    reached = asked.select("script", "stretch", "pos").join(from_, ["script", "stretch"]).where("pos >= lo").select("script", "pos")
    missing = jumps.where("aim is null").join(from_, ["script", "stretch"]).where("pos >= lo").select("script", "pos", "target")
    return reached, missing


def depth_first_order(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, path: the least path of edge positions to a node; sort by path for the pre-order of a depth-first visit.

    edges(src, pos, dst), pos not negative. A depth-first visit reaches a node by its least path: whatever it visits before is smaller, and from
    there it takes the first edge that leads on.  Positions sort as numbers of any length.  With nodes(node), those
    that no root reaches follow in their own order.
    """
    best = frontier = durable(roots.select("node", F.lit("").alias("path")).distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", T.sortable_number(F.col("pos").cast("string"))).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path"))
        # A path that comes back to a node is longer than the one it had and starts with it, so it never wins.
        better = step.join(best.withColumnRenamed("path", "old"), "node", "left").where("old is null or path < old").select("node", "path")
        frontier = durable(better)
        best = durable(best.unionByName(frontier).groupBy("node").agg(F.min("path").alias("path")))
    if nodes is None:
        return best
    return best.unionByName(orphans(nodes.select("node"), best).select("node", F.concat(F.lit("~"), T.sortable_number(F.col("node").cast("string"))).alias("path")))


def orphans(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.join(reached.select("node"), "node", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of undirected edges(src, dst); labels sink to the smallest until none moves."""
    both = durable(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = durable(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("least"))
        low = labels.join(near, labels["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("least", "component")).alias("low"), "component")
        # A label's own label is as small or smaller, which halves the rounds.
        jump = low.select(F.col("node").alias("via"), F.col("low").alias("lower"))
        new = durable(low.join(jump, low["low"] == jump["via"], "left").select("node", "component", F.coalesce("lower", "low").alias("new")))
        if new.where("new <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", F.col("new").alias("component"))


def expand_calls(events: DataFrame, root: str) -> DataFrame:
    """path, node, pos, text of events(node, pos, text, callee) of `root`, each call followed by the callee's events, to any depth.

    The path sorts events in the order in which they run; a call of a node that is being expanded stays a plain event.
    """
    pos = T.sortable_number(F.col("pos").cast("string"))
    frames = events.sparkSession.createDataFrame([("", root, [root])], "prefix string, node string, stack array<string>")
    out = None
    while True:
        rows = durable(frames.join(events, "node").select(F.concat("prefix", pos).alias("path"), "node", "pos", "text", "callee", "stack"))
        out = rows if out is None else out.union(rows)
        calls = rows.where(F.col("callee").isNotNull() & ~F.array_contains("stack", F.col("callee")))
        if calls.isEmpty():
            return out.select("path", "node", "pos", "text")
        frames = calls.select(F.concat("path", F.lit("/")).alias("prefix"), F.col("callee").alias("node"), F.array_append("stack", F.col("callee")).alias("stack"))
