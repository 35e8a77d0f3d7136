"""Iterative graph operators. Every round is an equi-join of the frontier with the edges; the
lineage is cut in the shared folder, and a round's leftovers are deleted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import cut, drop, seen

#: Guards against a fault in the loops: a walk that needs more rounds stops with an error, never with a part.
MOST_ROUNDS = 10_000


def _rounds(first: int = 0) -> Iterator[int]:
    yield from range(first, MOST_ROUNDS)
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")


#: Parts of a growing table before they are written together.
MOST_PARTS = 8


class _Grown:
    """A table that grows by parts. Parts are not rewritten each round, but now and then; the
    last one, on which the next round works, stays as it is."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out.hint("merge")

    def add(self, part: DataFrame) -> None:
        if len(self.parts) >= MOST_PARTS:
            merged = cut(self.all())
            for p in self.parts:
                drop(p)
            self.parts = [merged]
        self.parts.append(part)


def _edges(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` without nulls."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()


def _cut(df: DataFrame) -> DataFrame:
    """A round's rows, counted while they are written (``seen(df, "n")``)."""
    return cut(df, None, n=F.count(F.lit(1)))


def closure(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All nodes reached from ``start (node)`` along ``edges (src, dst)`` with the fewest hops:
    ``node, depth``; the start itself has depth 0. Null nodes are left out."""
    e = cut(_edges(edges))
    frontier = cut(start.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)))
    found = _Grown(frontier)
    for n in _rounds(1):
        if max_depth is not None and n > max_depth:
            break
        step = frontier.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        new = _cut(step.join(found.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(n)))
        if not seen(new, "n"):
            drop(new)
            break
        found.add(new)
        frontier = new
    drop(e)
    return found.all()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Edges ``src, kind, dst`` that touch, in the walked direction, a node reached in fewer than
    ``depth`` hops (clamped to 1..10)."""
    depth = min(10, max(1, depth))
    fwd = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walk = {"out": fwd, "in": back, "both": fwd.unionByName(back)}[direction]
    near = closure(walk, start, depth - 1).select("node")
    every = edges.select("src", "kind", "dst").distinct()
    out = every.join(near.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "kind", "dst")
    into = every.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "kind", "dst")
    return {"out": out, "in": into, "both": out.unionByName(into).distinct()}[direction]


def pair_closure(edges: DataFrame, seeds: DataFrame, carry: str) -> DataFrame:
    """Least fixed point of sets that flow along edges: from ``seeds (node, carry)`` all pairs
    ``node, carry``, each round working on the new pairs only."""
    e = cut(_edges(edges))
    new = cut(seeds.where(F.col("node").isNotNull() & F.col(carry).isNotNull()).select("node", carry).distinct())
    found = _Grown(new)
    for _ in _rounds():
        step = new.select(F.col("node").alias("src"), carry).join(e, "src").select(F.col("dst").alias("node"), carry).distinct()
        fresh = _cut(step.join(found.all(), ["node", carry], "left_anti"))
        if not seen(fresh, "n"):
            drop(fresh)
            break
        found.add(fresh)
        new = fresh
    drop(e)
    return found.all()


#: Marks of a node: surely and possibly reached from a root, surely and possibly reached from a test.
FROM_ROOT, MAY_ROOT, FROM_TEST, MAY_TEST = 1, 2, 4, 8


def marks(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Marks that flow along edges until none is new: ``node, bits``. ``start (node, bits)``; ``edges
    (src, dst, lets)``: an edge lets those bits through. All marks go in one walk, whose rounds are as
    many as the longest of their ways has hops."""
    e = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.bit_or("lets").alias("lets")))
    new = cut(start.where("node IS NOT NULL AND bits <> 0").groupBy("node").agg(F.bit_or("bits").alias("bits")))
    found = _Grown(new)
    total = lambda: found.all().groupBy("node").agg(F.bit_or("bits").alias("bits"))
    for _ in _rounds():
        told = new.select(F.col("node").alias("src"), "bits").join(e, "src").select(F.col("dst").alias("node"), F.col("bits").bitwiseAND(F.col("lets")).alias("b")).where("b <> 0").groupBy("node").agg(F.bit_or("b").alias("b"))
        fresh = told.join(total(), "node", "left").select("node", F.expr("b & ~coalesce(bits, 0)").alias("bits")).where("bits <> 0")
        fresh = _cut(fresh)
        if not seen(fresh, "n"):
            drop(fresh)
            break
        found.add(fresh)
        new = fresh
    drop(e)
    return total()


def reach_classes(nodes: DataFrame, must: DataFrame, may: DataFrame, roots: DataFrame, tests: DataFrame) -> DataFrame:
    """Class of each node, first that applies: no roots at all `unknown`; surely reached from a
    root `entry`; possibly `unknown`; surely reached from a test `test_only`; possibly `unknown`;
    else `unreached`. Both kinds of edges and of starts are walked at once."""
    out = nodes.select("node").where("node IS NOT NULL").distinct()
    if roots.isEmpty():
        return out.withColumn("class", F.lit("unknown"))
    lets = lambda e, bits: e.select("src", "dst", F.lit(bits).alias("lets"))
    edges = lets(must, FROM_ROOT | FROM_TEST).unionByName(lets(may, MAY_ROOT | MAY_TEST))
    start = roots.select("node", F.lit(FROM_ROOT | MAY_ROOT).alias("bits")).unionByName(tests.select("node", F.lit(FROM_TEST | MAY_TEST).alias("bits")))
    bit = lambda b: F.col("bits").bitwiseAND(F.lit(b)) != 0
    cls = F.when(bit(FROM_ROOT), "entry").when(bit(MAY_ROOT), "unknown").when(bit(FROM_TEST), "test_only").when(bit(MAY_TEST), "unknown").otherwise("unreached")
    return out.join(marks(edges, start), "node", "left").select("node", cls.alias("class"))


def rapid_types(sure: DataFrame, maybe: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes surely reached when an ambiguous callee counts once its type is reached.

    ``sure (src, dst)``; ``maybe (src, dst, type)``: candidates, of which one whose ``type`` (a
    node) is reached, now or later, joins in; candidates without type never do. Fixed point.
    """
    e, m = cut(_edges(sure)), cut(maybe.where("type IS NOT NULL").select("src", "dst", "type").distinct())
    new = cut(start.where("node IS NOT NULL").select("node").distinct())
    found = _Grown(new)
    for _ in _rounds():
        s = found.all()
        by_edge = new.join(e, new.node == e.src).select(F.col("dst").alias("node"))
        by_type = m.join(s.withColumnRenamed("node", "src"), "src", "left_semi").join(s.withColumnRenamed("node", "type"), "type", "left_semi").select(F.col("dst").alias("node"))
        fresh = _cut(by_edge.unionByName(by_type).distinct().join(s, "node", "left_anti"))
        if not seen(fresh, "n"):
            drop(fresh)
            break
        found.add(fresh)
        new = fresh
    return found.all()


def crossings(sync: DataFrame, hops: DataFrame, start: DataFrame) -> DataFrame:
    """Fewest asynchronous hops to each node: ``node, crossings``. Level by level: close over
    synchronous edges, then take one hop."""
    level = closure(sync, start).select("node", F.lit(0).alias("crossings"))
    found, frontier, h = cut(level), level, cut(_edges(hops))
    for n in _rounds(1):
        landed = _cut(frontier.select(F.col("node").alias("src")).join(h, "src").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti"))
        if not seen(landed, "n"):
            drop(landed)
            break
        wide = closure(sync, landed).select("node").join(found.select("node"), "node", "left_anti")
        frontier = cut(wide.withColumn("crossings", F.lit(n)))
        found = cut(found.unionByName(frontier), found)
    drop(h)
    return found


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """One shortest path from the set ``start`` to every node it reaches: ``node, depth, parent``;
    of several parents in the level before the first by name. Paths follow by the parents."""
    e = cut(_edges(edges))
    frontier = cut(start.where("node IS NOT NULL").select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    found = _Grown(frontier)
    for n in _rounds(1):
        step = frontier.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = _cut(step.join(found.all().select("node"), "node", "left_anti").select("node", F.lit(n).alias("depth"), "parent"))
        if not seen(new, "n"):
            drop(new)
            break
        found.add(new)
        frontier = new
    drop(e)
    return found.all()


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest chains and what hinders them: ``(node, level)`` with the number of edges of the
    longest chain that ends at the node, for nodes not behind a cycle, and ``(node)`` for those
    on or behind one. One round per level."""
    e = cut(_edges(edges))
    rest = cut(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    done, left = None, e
    for n in _rounds():
        ready = _cut(rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(n)))
        if not seen(ready, "n"):
            drop(ready)
            break
        done = cut(ready if done is None else done.unionByName(ready), done)
        rest = cut(rest.join(ready, "node", "left_anti"), rest)
        left = cut(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"), left)
    if done is None:
        done = rest.where("1 = 0").withColumn("level", F.lit(0))
    return done, rest


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: ``node``.

    Nodes without way in or out are peeled off from both ends; what is left lies on cycles or
    between them. There each node learns, by propagation of the greatest name along edges, its
    greatest predecessor and likewise its greatest successor; nodes where both agree share a
    strong component with it. Components found are taken out and the rest goes on.
    """
    _, core = peel(edges)
    e = _edges(edges).join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    _, core = peel(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    keep = lambda x, c: x.join(c.withColumnRenamed("node", "src"), "src", "left_semi").join(c.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    e = cut(keep(e, core))
    found = None
    for _ in _rounds():
        if e.isEmpty():
            break
        fwd, bwd = _greatest(e), _greatest(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = cut(fwd.join(bwd.withColumnRenamed("top", "low"), "node"))
        comp = both.where("top = low").select("node", "top")
        inner = e.join(comp.select(F.col("node").alias("src"), F.col("top").alias("ts")), "src").join(comp.select(F.col("node").alias("dst"), F.col("top").alias("td")), "dst").where("ts = td")
        loops = inner.select(F.col("src").alias("node")).distinct()
        found = cut(loops if found is None else found.unionByName(loops), found)
        # Edges between nodes of one forward and backward colour remain; found components leave.
        col = both.select("node", "top", "low")
        e = cut(
            e.join(col.select(F.col("node").alias("src"), F.col("top").alias("t1"), F.col("low").alias("l1")), "src")
            .join(col.select(F.col("node").alias("dst"), F.col("top").alias("t2"), F.col("low").alias("l2")), "dst")
            .where("t1 = t2 AND l1 = l2 AND t1 <> l1").select("src", "dst"),
            e,
        )
    return found if found is not None else core.where("1 = 0").select("node")


def _greatest(edges: DataFrame) -> DataFrame:
    """For each node the greatest node that reaches it, itself included: ``node, top``."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    state = cut(nodes.select("node", F.col("node").alias("top"), F.lit(True).alias("moved")))
    for _ in _rounds():
        told = state.where("moved").select(F.col("node").alias("src"), "top").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("top").alias("t"))
        state = cut(state.join(told, "node", "left").select("node", F.greatest("top", F.coalesce("t", "top")).alias("top"), (F.coalesce("t", "top") > F.col("top")).alias("moved")), state, n=F.count_if("moved"))
        if not seen(state, "n"):
            break
    return state.select("node", "top")


def inverse(edges: DataFrame) -> DataFrame:
    """For each node the nodes that point to it: ``node, callers`` (sorted, by comma), ``n``."""
    return _edges(edges).groupBy(F.col("dst").alias("node")).agg(F.concat_ws(",", F.sort_array(F.collect_list("src"))).alias("callers"), F.count(F.lit(1)).alias("n"))


def between(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """Nodes on paths from ``start`` to ``end``: forward closure meets backward closure."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(edges, start).select("node").join(closure(back, end).select("node"), "node", "left_semi")


def coloaded(imports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` that some module loads both, itself or by what it imports:
    ``a, b``. ``imports (src, dst)``: src imports dst; a module loads itself. The walk goes up from
    the modules of the pairs only."""
    want = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    seeds = want.select(F.col("a").alias("node")).unionByName(want.select(F.col("b").alias("node"))).distinct().withColumn("of", F.col("node"))
    up = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    over = cut(pair_closure(up, seeds, "of"))
    x, y = over.select(F.col("of").alias("a"), "node"), over.select(F.col("of").alias("b"), "node")
    return want.join(x, "a").join(y, ["b", "node"]).select("a", "b").distinct()


def certainty(sure: DataFrame, unsure: DataFrame, seeds: DataFrame, carry: str) -> DataFrame:
    """Memberships and whether they are certain: all pairs ``node, carry`` that flow along ``sure`` edges
    alone are, those that need an ``unsure`` one are not."""
    yes = cut(pair_closure(sure, seeds, carry))
    every = pair_closure(sure.select("src", "dst").unionByName(unsure.select("src", "dst")), seeds, carry)
    return every.join(yes.withColumn("c", F.lit(True)), ["node", carry], "left").select("node", carry, F.coalesce("c", F.lit(False)).alias("certain"))


#: Kinds of edges that a path may use, in the order they are tried.
MODES = (("sync", ("sync",)), ("async", ("sync", "async")), ("unknown", ("sync", "unknown")), ("both", ("sync", "async", "unknown")))


def paths_by_mode(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """A shortest path for each of ``pairs (root, target)``: ``root, target, mode, hops, path,
    unknown_from, reading``.

    ``edges (src, dst, kind)`` with kind sync, async or unknown. Modes are tried in order; the first
    that reaches wins even if another is shorter. Of several shortest paths the first by the names
    on it. ``unknown_from``: the first unknown hop; ``reading``: complete, unknown_from_hop or
    unreached. A root reaches itself by no hop. Only roots with targets left go into the next mode.
    """
    e = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL AND kind IS NOT NULL").groupBy("src", "dst").agg(F.collect_set("kind").alias("kinds")))
    left = cut(pairs.where("root IS NOT NULL AND target IS NOT NULL").select("root", "target").distinct())
    out = None
    for mode, kinds in MODES:
        use = F.filter("kinds", lambda k: k.isin(*kinds))
        # A resolved hop where there is one; an edge known in several ways is the surest of them.
        step_kind = F.when(F.array_contains(use, "sync"), "sync").when(F.array_contains(use, "async"), "async").otherwise("unknown")
        own = cut(e.where(F.size(use) > 0).select("src", "dst", step_kind.alias("kind")))
        frontier = cut(left.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.array().cast("array<string>").alias("by")))
        found = _Grown(frontier)
        for _ in _rounds():
            step = frontier.join(own.withColumnRenamed("src", "node"), "node").select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("by", F.array("kind")).alias("by"))
            best = step.groupBy("root", "node").agg(F.min(F.struct("path", "by")).alias("m")).select("root", "node", "m.path", "m.by")
            fresh = _cut(best.join(found.all().select("root", "node"), ["root", "node"], "left_anti"))
            if not seen(fresh, "n"):
                drop(fresh)
                break
            found.add(fresh)
            frontier = fresh
        got = cut(left.join(found.all().withColumnRenamed("node", "target"), ["root", "target"]).withColumn("mode", F.lit(mode)))
        out = got if out is None else out.unionByName(got)
        left = _cut(left.join(got.select("root", "target"), ["root", "target"], "left_anti"))
        drop(own)
        if not seen(left, "n"):
            break
    none = left.select("root", "target", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("array<string>").alias("by"), F.lit(None).cast("string").alias("mode"))
    at = F.nullif(F.array_position("by", "unknown"), F.lit(0)).cast("int")
    reading = F.when(F.col("path").isNull(), "unreached").when(at.isNotNull(), "unknown_from_hop").otherwise("complete")
    return out.unionByName(none).select("root", "target", "mode", F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path"), at.alias("unknown_from"), reading.alias("reading"))


def flows(edges: DataFrame, roots: DataFrame, features: DataFrame, most: int = 3) -> DataFrame:
    """One step per feature that a root reaches: ``root, feature, nodes, via``, the nodes of the feature
    that are reached and the first ``most`` of them by name. ``features (node, feature)``."""
    reached = pair_closure(edges, roots.where("node IS NOT NULL").select("node", F.col("node").alias("root")).distinct(), "root")
    at = reached.join(features.where("feature IS NOT NULL").select("node", "feature").distinct(), "node")
    # Only the first few of a group are kept at any moment, so a large one is no large row.
    w = Window.partitionBy("root", "feature").orderBy("node")
    first = at.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy("root", "feature").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("via"))
    return at.groupBy("root", "feature").agg(F.count(F.lit(1)).alias("nodes")).join(first, ["root", "feature"])


def walks(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Walks that take the one step from each node until there is none or a node comes again:
    ``start, hops, last, ended`` (`end` or `loop`). ``steps (src, dst)`` has one row per ``src``."""
    s = cut(steps.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("dst")))
    now = _cut(start.where("node IS NOT NULL").select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("path")).distinct())
    done = None
    for _ in _rounds():
        if not seen(now, "n"):
            break
        go = cut(now.join(s.withColumnRenamed("src", "last"), "last", "left").withColumn("ended", F.when(F.col("dst").isNull(), "end").when(F.array_contains("path", F.col("dst")), "loop")), now)
        over = go.where("ended IS NOT NULL").select("start", (F.size("path") - 1).alias("hops"), "last", "ended")
        done = over if done is None else done.unionByName(over)
        now = _cut(go.where("ended IS NULL").select("start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")))
    return done if done is not None else now.select("start", F.lit(0).alias("hops"), "last", F.lit("end").alias("ended"))
