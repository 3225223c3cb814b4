"""Import cycles through files.

1. *Parts.* Only files of one strongly connected part lie on a common cycle. What can't lie on one goes in rounds: files without a way in or out
   drop, and files with one way in and one way on are passed over (their part is that of their neighbours), so that a chain or a ring of any length
   shrinks by a fraction a round. What is left is split by colour: every file takes the greatest name that reaches it, and what leads
   back to that name inside its colour is a part.
2. *Ways back.* For each file of a part, how far it is from the files around it, up to ``HORIZON`` steps.
3. *Walks.* A narrow search along the shortest ways back first finds some cycles through each file; the longest of the first ``limit`` bounds the
   whole search, which then grows every path that can still return within it. The result is exact.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsieve.operators.ranking import top_per_key
from revsieve.plans.lineage import cut

CYCLE_LIMIT = 10  # Fixed value: cycles reported per file.
HORIZON = 6  # steps back that are known; farther files count as one step more
BEAM = 40  # paths of a file in the narrow search


def _ends(edges: DataFrame, column: str, name: str) -> DataFrame:
    return edges.select(F.col(column).alias(name)).distinct()


def _raked(edges: DataFrame) -> DataFrame:
    """Edges between files that have a way in and a way on."""
    return edges.join(_ends(edges, "dst", "src"), "src", "left_semi").join(_ends(edges, "src", "dst"), "dst", "left_semi").select("src", "dst")


def _passed(edges: DataFrame, round_no: int) -> DataFrame:
    """(node, before, after) of files with one way in and one on, no two of them neighbours."""
    ways = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"), F.first("dst").alias("after"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("into"), F.first("src").alias("before"))
    single = ways.join(back, "node").where("out = 1 AND into = 1").select("node", "before", "after")

    def draw(c: str) -> Column:
        return F.struct(F.xxhash64(c, F.lit(round_no)), F.col(c))  # the name settles equal draws

    names = single.select("node")
    left = names.select(F.col("node").alias("before"), F.lit(True).alias("_before"))
    right = names.select(F.col("node").alias("after"), F.lit(True).alias("_after"))
    first = (F.col("_before").isNull() | (draw("node") < draw("before"))) & (F.col("_after").isNull() | (draw("node") < draw("after")))
    return single.join(left, "before", "left").join(right, "after", "left").where(first).select("node", "before", "after")


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, part) of files that lie in a part of several, by forward colours and ways back inside a colour."""
    parts = None
    while not edges.isEmpty():
        nodes = _ends(edges, "src", "node").union(_ends(edges, "dst", "node")).distinct()
        colours = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            sent = edges.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
            grown = cut(colours.join(sent, "node", "left").select(
                "node", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("new")))
            colours, changed = grown.drop("new"), not grown.where("new").isEmpty()
            if not changed:
                break
        of = lambda end: colours.withColumnsRenamed({"node": end, "colour": f"{end}_colour"})
        inside = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select(
            "src", "dst", F.col("src_colour").alias("part")))
        reached = front = cut(colours.where("node = colour").select("node", F.col("colour").alias("part")))
        while True:
            back = inside.join(front.withColumnRenamed("node", "dst"), ["dst", "part"]).select(F.col("src").alias("node"), "part").distinct()
            front = cut(back.join(reached, ["node", "part"], "left_anti"))
            if front.isEmpty():
                break
            reached = cut(reached.unionByName(front))
        several = reached.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
        found = reached.join(several, "part", "left_semi").select("node", "part")
        parts = cut(found if parts is None else parts.unionByName(found))
        left = inside.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(
            reached.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = cut(_raked(left.select("src", "dst")))
    return parts if parts is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("part"))


def strong_parts(edges: DataFrame) -> DataFrame:
    """(node, part) of all files that lie on a cycle; files have one part if there are ways between them in both directions."""
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    edges = cut(_raked(_raked(edges.where("src <> dst").select("src", "dst").distinct())))
    passed: list[tuple[DataFrame, DataFrame]] = []
    size = edges.count()
    for round_no in range(2 * ceil(log2(size + 1)) + 2 if size else 0):
        skip = cut(_passed(edges, round_no))
        names = skip.select("node")
        kept = edges.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti")
        joined = kept.select("src", "dst").union(skip.select(F.col("before").alias("src"), F.col("after").alias("dst"))).distinct()
        closed = skip.where("before = after").select(F.col("before").alias("node")).distinct()
        edges = cut(_raked(joined.where("src <> dst")))
        passed.append((skip, closed))
        left = edges.count()
        if left == 0 or left == size:
            break
        size = left

    def with_own(parts: DataFrame, nodes: DataFrame) -> DataFrame:
        """Files on a ring of their own are a part unless they lie in a larger one."""
        return parts.unionByName(nodes.join(parts, "node", "left_anti").select("node", F.col("node").alias("part")))

    parts = _coloured(edges)
    for skip, closed in reversed(passed):
        parts = cut(with_own(parts, closed))
        side = lambda c: parts.withColumnsRenamed({"node": c, "part": f"{c}_part"})
        own = skip.join(side("before"), "before").join(side("after"), "after").where("before_part = after_part")
        parts = cut(parts.unionByName(own.select("node", F.col("before_part").alias("part"))))
    return cut(with_own(parts, loops))


def _ways_back(step: DataFrame, horizon: int) -> DataFrame:
    """(start, at, back): the steps from a file back to a start, for those within the horizon."""
    front = known = cut(step.select(F.col("next").alias("start"), "at", F.lit(1).alias("back")))
    for k in range(2, horizon + 1):
        farther = front.select("start", F.col("at").alias("next")).join(step, "next").select("start", "at").distinct()
        front = cut(farther.join(known, ["start", "at"], "left_anti").withColumn("back", F.lit(k)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return cut(known)


def _grown(paths: DataFrame, step: DataFrame) -> DataFrame:
    """Paths with one edge more that they have not used."""
    edge = F.struct(F.col("at").alias("at"), F.col("next").alias("next"))
    return paths.join(step, "at").where(~F.array_contains("used", edge)).select(
        "start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"), F.concat("used", F.array(edge)).alias("used"))


def _closed(paths: DataFrame, length: int) -> DataFrame:
    return paths.where("start = at").select("start", "path", F.lit(length).alias("length"))


def _first(found: DataFrame, limit: int, name: str = "cycle_rank") -> DataFrame:
    return top_per_key(found, ["start"], [F.col("length"), F.concat_ws(" > ", "path")], limit, name)


def _bounds(begin: DataFrame, step: DataFrame, back: DataFrame, limit: int, rounds: int) -> DataFrame:
    """(start, bound): a length within which a start has ``limit`` cycles, for starts where the narrow search finds them."""
    paths, found = begin, None
    for length in range(1, rounds + 1):
        closed = _closed(paths, length)
        found = cut(closed if found is None else _first(found.unionByName(closed), limit).drop("cycle_rank"))
        full = found.groupBy("start").count().where(F.col("count") >= limit).select("start")
        near = _grown(paths.join(full, "start", "left_anti"), step).join(back, ["start", "at"])
        paths = cut(top_per_key(near, ["start"], [F.col("back"), F.concat_ws(" > ", "path")], BEAM, "_n").drop("_n", "back"))
        if paths.isEmpty():
            break
    counted = found.groupBy("start").agg(F.count("*").alias("n"), F.max("length").alias("bound"))
    return counted.where(F.col("n") >= limit).select("start", "bound")


def import_cycles(edges: DataFrame, limit: int = CYCLE_LIMIT, max_length: int | None = None, horizon: int = HORIZON) -> DataFrame:
    """Up to ``limit`` cycles per starting file, shortest first, then by path.

    ``edges`` has (src, dst). A path may not use an edge twice. ``max_length`` bounds the length if set.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    parts = strong_parts(edges)
    end = lambda c: parts.withColumnsRenamed({"node": c, "part": f"{c}_part"})
    inside = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_part = dst_part")
    step = cut(inside.select(F.col("src").alias("at"), F.col("dst").alias("next")))
    back = _ways_back(step, horizon)
    begin = step.select(
        F.col("at").alias("start"), F.col("next").alias("at"), F.array("at", "next").alias("path"),
        F.array(F.struct("at", "next")).alias("used"))
    bounds = cut(_bounds(begin, step, back, limit, 2 * horizon))
    paths, found, length = begin, None, 1
    while not paths.isEmpty():
        closed = _closed(paths, length)
        found = cut(_first(closed if found is None else found.unionByName(closed), limit).drop("cycle_rank"))
        if max_length is not None and length >= max_length:
            break
        full = found.groupBy("start").count().where(F.col("count") >= limit).select("start")
        length += 1
        # a path that has returned to its start may go on and return once more
        least = F.when(F.col("start") == F.col("at"), 0).otherwise(F.coalesce("back", F.lit(horizon + 1)))
        grown = _grown(paths.join(full, "start", "left_anti"), step).join(back, ["start", "at"], "left").join(bounds, "start", "left")
        top = F.coalesce("bound", F.lit(2**31 - 1))
        if max_length is not None:
            top = F.least(top, F.lit(max_length))
        paths = cut(grown.where(F.lit(length) + least <= top).select("start", "at", "path", "used"))
    if found is None:
        found = paths.select("start", "path", F.lit(0).alias("length"))
    return _first(found, limit)
