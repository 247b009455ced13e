"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

A deterministic hash makes about one node in ``every`` a splitter. Each node
walks to its next splitter or to the end of its tree, keeping its exact path.
The splitters form a much smaller pointer graph, solved by doubling. Nodes on a
cycle without a splitter notice when they are back at their start, and nodes
that come upon such a cycle stop there;
nodes that are still walking after ``limit`` hops join the small graph, with
the jump of the node they stopped at, be it to a splitter, an end or a cycle. What
doubling can't end lies on a cycle or leads into one; the nodes that lead into
a cycle are then solved once more with the cycle as their end.

Every round is a join of narrow tables cut to the shared folder; the number of
rounds follows ``limit`` and the logarithm of the longest chain of splitters.

Defined results. Rows without a parent and nulls make no edge. An id given
twice keeps its smallest parent. A node that is its own parent is a cycle of
one. A parent that is no row is a root. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.session import cut

HOPS_A_ROUND = 4


def _walk(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Every node's jump (id, ptr, hops, mn, path, kind) and, if any, the nodes that walk on."""
    e = edges.select(F.col("id").alias("e_id"), F.col("nxt").alias("e_nxt"), F.col("split").alias("e_split"))
    state = edges.select("id", F.col("nxt").alias("ptr"), F.lit(1).cast("long").alias("hops"), F.col("id").alias("mn"), F.array("id").alias("path"), F.lit(None).cast("string").alias("kind"))
    parts: list[DataFrame] = []
    for _ in range(0, limit, HOPS_A_ROUND):
        for _ in range(HOPS_A_ROUND):
            walking = F.col("kind").isNull()
            at = F.when(walking, F.col("ptr")).otherwise(F.col("id"))
            kind = F.when(~walking, F.col("kind")).when(F.col("e_id").isNull(), "end").when(F.col("ptr") == F.col("id"), F.when(F.col("e_split"), "splitter").otherwise("cycle")).when(F.col("e_split"), "splitter")
            go = kind.isNull()
            state = state.join(e, at == F.col("e_id"), "left").select(
                "id",
                F.when(go, F.col("e_nxt")).otherwise(F.col("ptr")).alias("ptr"),
                (F.col("hops") + go.cast("long")).alias("hops"),
                F.when(go, F.least("mn", "ptr")).otherwise(F.col("mn")).alias("mn"),
                F.when(go, F.concat("path", F.array("ptr"))).otherwise(F.col("path")).alias("path"),
                kind.alias("kind"),
            )
        state = cut(state)
        parts.append(state.filter(F.col("kind").isNotNull()))
        state = state.filter(F.col("kind").isNull())
        found = [p.filter(F.col("kind") == "cycle").select(F.col("id").alias("c_id")) for p in parts]
        rings = reduce(DataFrame.unionByName, found)
        parts.append(state.join(rings, F.col("ptr") == F.col("c_id"), "left_semi").withColumn("kind", F.lit("ring")))
        state = state.join(rings, F.col("ptr") == F.col("c_id"), "left_anti")
        if state.isEmpty():
            state = None
            break
    return cut(reduce(DataFrame.unionByName, parts)), None if state is None else cut(state)


def _double(graph: DataFrame) -> DataFrame:
    """``graph`` (id, ptr, hops, mn) with each ptr carried to its end; ``open`` where there is none.

    A node that jumps to itself is an end. For open rows ptr lies on a cycle and
    mn is the smallest id seen on more than a full round.
    """
    now = cut(graph.withColumn("open", F.col("ptr") != F.col("id")))
    reach, left = 1, now.filter("open").count()
    while left:
        far = now.select(F.col("id").alias("f_id"), F.col("ptr").alias("f_ptr"), F.col("hops").alias("f_hops"), F.col("mn").alias("f_mn"), F.col("open").alias("f_open"))
        at = F.when(F.col("open"), F.col("ptr")).otherwise(F.col("id"))
        go = F.col("open") & F.col("f_id").isNotNull()
        then = cut(
            now.join(far, at == F.col("f_id"), "left").select(
                "id",
                F.when(go, F.col("f_ptr")).otherwise(F.col("ptr")).alias("ptr"),
                (F.col("hops") + F.when(go, F.col("f_hops")).otherwise(F.lit(0))).alias("hops"),
                F.when(go, F.least("mn", "f_mn")).otherwise(F.col("mn")).alias("mn"),
                (go & F.col("f_open")).alias("open"),
            ),
            now,
        )
        now, before = then, left
        left = now.filter("open").count()
        if left and reach >= before:
            break
        reach *= 2
    return now


def _solve(edges: DataFrame, every: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, end, hops, cyclic, on_cycle, cycle_min) of all nodes, and the jumps with their paths."""
    edges = cut(edges.withColumn("split", F.pmod(F.xxhash64("id", F.lit("splitter")), F.lit(every)) == 0))
    done, walking = _walk(edges, limit)
    splitters = edges.filter("split").select("id")
    graph = done.join(splitters, "id", "left_semi").select("id", "ptr", "hops", "mn")
    jumps = done
    if walking is not None:
        inner = done.join(splitters, "id", "left_anti").filter(F.col("kind").isin("splitter", "end", "ring")).select(F.col("id").alias("d_id"), F.col("ptr").alias("d_ptr"), F.col("hops").alias("d_hops"), F.col("mn").alias("d_mn"), F.col("path").alias("d_path"))
        more = walking.join(inner, F.col("ptr") == F.col("d_id"), "left")
        more = cut(
            more.select(
                "id", F.coalesce("d_ptr", "ptr").alias("ptr"), (F.col("hops") + F.coalesce("d_hops", F.lit(0))).alias("hops"), F.least("mn", "d_mn").alias("mn"),
                F.concat("path", F.coalesce("d_path", F.array().cast("array<bigint>"))).alias("path"), F.lit("joined").alias("kind"),
            )
        )
        graph = graph.unionByName(more.select("id", "ptr", "hops", "mn"))
        jumps = cut(jumps.unionByName(more))
    solved = _double(graph)
    loops = solved.filter("open OR ptr = id")
    on_loop = loops.select(F.col("ptr").alias("id")).distinct().join(loops.select("id", "mn"), "id")
    around = on_loop.join(jumps.select("id", "path"), "id").select(F.explode("path").alias("id"), "mn").distinct()
    alone = done.filter(F.col("kind") == "cycle").select("id", "mn")
    ring = cut(around.unionByName(alone).groupBy("id").agg(F.min("mn").alias("cycle_min")))

    small = solved.select(F.col("id").alias("s_id"), F.col("ptr").alias("s_ptr"), F.col("hops").alias("s_hops"), F.col("open").alias("s_open"))
    in_graph = F.col("kind").isin("splitter", "joined")
    own = jumps.withColumn("at", F.when(in_graph, F.col("ptr")).otherwise(F.col("id")))
    all_nodes = own.join(small, F.col("at") == F.col("s_id"), "left")
    use = in_graph & F.col("s_id").isNotNull()
    end = F.when(use, F.col("s_ptr")).otherwise(F.col("ptr"))
    out = all_nodes.select(
        "id", end.alias("end"), (F.col("hops") + F.when(use, F.col("s_hops")).otherwise(F.lit(0))).alias("hops"), F.when(use, F.col("s_open")).otherwise(F.lit(False)).alias("behind")
    )
    mine = ring.select(F.col("id"), F.col("cycle_min").alias("own_min"))
    theirs = ring.select(F.col("id").alias("end"), F.col("cycle_min").alias("end_min"))
    return cut(out.join(mine, "id", "left").join(theirs, "end", "left")), jumps


def _trees(nodes: DataFrame, id_col: str, parent_col: str, every: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, root_id, depth, is_cycle), and the jumps of the nodes that aren't on a cycle."""
    edges = nodes.filter(F.col(id_col).isNotNull() & F.col(parent_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("nxt"))
    edges = cut(edges.groupBy("id").agg(F.min("nxt").alias("nxt")))
    first, jumps = _solve(edges, every, limit)
    on_ring = F.col("own_min").isNotNull()
    tail = ~on_ring & (F.col("behind") | F.col("end_min").isNotNull())
    settled = first.filter(~tail).select(
        "id",
        F.coalesce("own_min", "end").alias("root_id"),
        F.when(on_ring, F.lit(0)).otherwise(F.col("hops")).cast("int").alias("depth"),
        on_ring.cast("int").alias("is_cycle"),
    )
    jumps = jumps.join(first.filter(~tail & ~on_ring).select("id"), "id", "left_semi").select("id", "ptr", "path")
    tails = first.filter(tail).select("id")
    if tails.isEmpty():
        return settled, jumps
    ring_min = first.filter(on_ring).select(F.col("id").alias("end"), F.col("own_min").alias("root_id"))
    second, more = _solve(edges.join(tails, "id", "left_semi"), every, limit)
    behind = second.select("id", "end", "hops").join(ring_min, "end").select("id", "root_id", F.col("hops").cast("int").alias("depth"), F.lit(1).alias("is_cycle"))
    return settled.unionByName(behind), jumps.unionByName(more.select("id", "ptr", "path"))


def trees(nodes: DataFrame, id_col: str = "id", parent_col: str = "redirect_to_id", every: int = 8, limit: int = 12) -> DataFrame:
    """(id, root_id, depth, is_cycle) of every node that has a parent."""
    return _trees(nodes, id_col, parent_col, every, limit)[0]


def paths(nodes: DataFrame, id_col: str = "id", parent_col: str = "redirect_to_id", every: int = 8, limit: int = 12) -> DataFrame:
    """``trees`` with ``path``: the ids from the node to its root, or to the first id on its cycle.

    The paths of the small graph are joined by doubling; every other node then
    takes its own jump and the path of the node where that ends.
    """
    out, jumps = _trees(nodes, id_col, parent_col, every, limit)
    jumps = cut(jumps)
    now = cut(jumps.join(jumps.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi").withColumn("moved", F.lit(True)))
    while not now.filter("moved").isEmpty():
        far = now.select(F.col("id").alias("f_id"), F.col("ptr").alias("f_ptr"), F.col("path").alias("f_path"))
        met = F.col("f_id").isNotNull()
        then = now.join(far, F.col("ptr") == F.col("f_id"), "left").select(
            "id", F.coalesce("f_ptr", "ptr").alias("ptr"), F.when(met, F.concat("path", "f_path")).otherwise(F.col("path")).alias("path"), met.alias("moved")
        )
        now = cut(then, now)
    rest = now.select(F.col("id").alias("f_id"), F.col("ptr").alias("f_ptr"), F.col("path").alias("f_path"))
    none = F.array().cast("array<bigint>")
    full = jumps.join(rest, F.col("ptr") == F.col("f_id"), "left").select("id", F.concat("path", F.coalesce("f_path", none), F.array(F.coalesce("f_ptr", "ptr"))).alias("path"))
    return out.join(full, "id", "left").withColumn("path", F.coalesce("path", F.array("id")))


def descendants(nodes: DataFrame, id_col: str = "id", parent_col: str = "redirect_to_id") -> DataFrame:
    """(ancestor_id, id, hops): one row for every id and every id its path leads over."""
    p = paths(nodes, id_col, parent_col)
    return p.select("id", F.posexplode("path").alias("hops", "ancestor_id")).filter(F.col("hops") > 0).select("ancestor_id", "id", "hops")
