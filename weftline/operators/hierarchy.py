"""Parent-child links to full hierarchies (problem 2), by heavy-path decomposition.

1. Pointer doubling separates the nodes on and below loops and sums subtree sizes on the way
   (after round k a node knows its 2^k-th ancestor and the size of its 2^k topmost levels).
2. The child with the largest subtree continues its parent's chain, all others open one.
   Doubling along heavy links gives each node its chain, place and path segment.
3. A root path crosses at most log2(n) chains, so a few rounds of doubling over the chains
   concatenate segments to paths, depths and roots, and give each chain its preorder interval.
   The descendants of a node are the ``subtree`` nodes whose ``pre`` starts at its own.

Rounds grow with the logarithm of the depth. Each is an equi-join by node key whose lineage
is cut in the shared checkpoint folder. No tree is gathered in a task: a chain or a tree of a
third of all rows is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import cut, drop, seen

ON_LOOP, BELOW_LOOP = -1, -2
#: 2^62 levels are never reached; guards against a fault in the loops below.
MOST_ROUNDS = 62
#: Siblings are numbered in this many groups, so that no task holds all children of a node.
SIBLING_GROUPS = 64


def _numbered(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, k, label)`` and ``(id, pid, kids)``: keys as 64-bit hashes, which make the rounds' rows
    small. Parents that are no nodes become null; ``kids`` is the number of children. Where two keys
    share a hash (checked) another seed is taken, so the numbers are exact."""
    for seed in range(100):
        at = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        named = cut(nodes.select(at(F.col("k")).alias("id"), F.when(F.col("parent").isNotNull(), at(F.col("parent"))).alias("pid"), "k", "label"))
        # Each link is sent to both its ends at once: who is a node, how often, and how many point at it.
        own = F.struct("id", "pid", F.lit(1).alias("own"), F.lit(0).alias("kid"))
        told = F.struct(F.col("pid").alias("id"), F.lit(None).cast("long").alias("pid"), F.lit(0).alias("own"), F.lit(1).alias("kid"))
        ends = named.select(F.inline(F.array(own, told))).where("id IS NOT NULL")
        table = cut(ends.groupBy("id").agg(F.max("pid").alias("pid"), F.sum("own").alias("own"), F.sum("kid").alias("kids")), None, most=F.max("own"))
        if seen(table, "most") <= 1:
            there = table.where("own = 1").select(F.col("id").alias("pid"), F.lit(True).alias("there"))
            links = table.where("own = 1").join(there, "pid", "left").select("id", F.when(F.col("there"), F.col("pid")).alias("pid"), "kids")
            return named.select("id", "k", "label"), cut(links, table, active=F.count("pid"))
        drop(named)
        drop(table)
    raise ValueError("keys are not distinct")


def _pointers(links: DataFrame) -> DataFrame:
    """One row per node that points or is pointed at: ``id, up, size, more``, from ``id, up, size``.

    ``size`` is what the node brings along, ``more`` what those that point at it bring. Each
    pointer is sent to both its ends at once, so one shuffle serves the sizes and the next jump.
    """
    own = F.struct("id", "up", "size", F.lit(0).cast("long").alias("add"))
    told = F.struct(F.col("up").alias("id"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("size"), F.col("size").alias("add"))
    both = links.select(F.inline(F.array(own, told)))
    table = both.groupBy("id").agg(F.max("up").alias("up"), F.max("size").alias("size"), F.sum("add").alias("more"))
    return cut(table, None, active=F.count("up"))


def separate(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``nodes (id, pid, kids)`` of :func:`_numbered`; ``pid`` null or another ``id``.

    Gives ``(id, more)``, the subtree sizes without the node itself of those that have
    descendants (in pieces to be added up), and the nodes without root as ``(id, depth)``, -1 on
    a loop and -2 below one (None if there are none). Each round handles only the nodes deeper
    than 2^round, so the work is in proportion to the sum of the logarithms of the depths.
    """
    now, n = nodes.select("id", F.col("pid").alias("up"), F.lit(1).cast("long").alias("size"), F.col("kids").cast("long").alias("more")), seen(nodes, "active")
    pieces = now.where("more > 0").select("id", "more")
    for _ in range(MOST_ROUNDS):
        if not n:
            return pieces, None
        # Who jumps to a node that jumps no further has reached its root's height: it leaves.
        active = now.where("up IS NOT NULL")
        jumped = active.select("id", "up", (F.col("size") + F.col("more")).alias("size")).join(active.select(F.col("id").alias("up"), F.col("up").alias("next")), "up")
        now = _pointers(jumped.select("id", F.col("next").alias("up"), "size"))
        pieces, left = pieces.unionByName(now.where("more > 0").select("id", "more")), seen(now, "active")
        # No node has its root between 2^k and 2^(k+1) levels above: none lies deeper, the rest runs in loops.
        if left == n:
            break
        n = left
    loops = now.where("up IS NOT NULL").select("id", "up")
    image, old = loops.select("up").distinct().count(), None
    for _ in range(MOST_ROUNDS):
        # The image of ever longer jumps shrinks to the loops themselves.
        loops = cut(loops.join(loops.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), old)
        old, smaller = loops, loops.select("up").distinct().count()
        if smaller == image:
            break
        image = smaller
    on = loops.select(F.col("up").alias("id")).distinct().withColumn("on", F.lit(True))
    return pieces, loops.select("id").join(on, "id", "left").select("id", F.when(F.col("on"), ON_LOOP).otherwise(BELOW_LOOP).alias("depth"))


def _sibling_offsets(trees: DataFrame) -> DataFrame:
    """Preorder offset ``off`` of each light child behind its parent: the heavy child comes
    first, then the others by group and key. Two-level prefix sums keep every window small."""
    light = trees.where("NOT heavy AND pid IS NOT NULL").withColumn("g", F.pmod(F.xxhash64("id"), F.lit(SIBLING_GROUPS)))
    groups = light.groupBy("pid", "g").agg(F.sum("size").alias("s"))
    w = Window.partitionBy("pid").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("pid", "g", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("pid", "g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    heavy = trees.where("heavy").select("pid", F.col("size").alias("first"))
    placed = light.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["pid", "g"]).join(heavy, "pid", "left")
    return placed.select("id", (F.lit(1) + F.coalesce("first", F.lit(0)) + F.col("base") + F.col("within")).alias("off"))


def _chains(trees: DataFrame, sep: str) -> DataFrame:
    """Each node's chain: ``id, head, place, seg``, the segment of labels below the head down to the node."""
    heads = trees.where("NOT heavy").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("seg"))
    parts = [heads]
    left = F.count_if(~F.col("done"))
    active = cut(trees.where("heavy").select("id", F.col("pid").alias("head"), F.lit(1).cast("long").alias("place"), F.col("label").alias("seg"), F.lit(False).alias("done")), None, left=left)
    for k in range(MOST_ROUNDS):
        if not seen(active, "left"):
            break
        # The pointers of this round, and of those that reached their head in the rounds before.
        known = active if k == 0 else active.where("NOT done")
        for p in parts[1:]:
            known = known.unionByName(p.withColumn("done", F.lit(True)))
        up = known.select(F.col("id").alias("head"), F.col("head").alias("head2"), F.col("place").alias("place2"), F.col("seg").alias("seg2"), F.col("done").alias("done2"))
        # A pointer at a node that is no heavy child points at the chain's head.
        far = F.col("head2").isNotNull()
        step = active.where("NOT done").join(up, "head", "left").select(
            "id", F.coalesce("head2", "head").alias("head"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"), F.concat_ws(sep, "seg2", "seg").alias("seg"), (~far | F.coalesce("done2", F.lit(False))).alias("done")
        )
        active = cut(step, None, left=left)
        parts.append(active.where("done").drop("done"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hierarchy(nodes: DataFrame, paths: bool = False, intervals: bool = False, sep: str = "/") -> DataFrame:
    """Root, depth and chain of every node, on request its path and preorder interval.

    ``nodes``: ``k`` (distinct, not null), ``parent`` (null, or no ``k``, for roots) and, for
    paths, ``label``. Result: ``k, root, depth, chain, place, subtree`` and ``path`` and
    ``tree_pre``; ``subtree`` is null without intervals. Nodes on a loop have root null and
    depth -1, nodes below one root null and depth -2, both without path and interval.
    ``tree_pre`` counts from 0 within the tree. An empty table gives an empty result.
    """
    label = F.col("label") if paths else F.lit(None).cast("string")
    names, links = _numbered(nodes.select("k", "parent", label.alias("label")))
    pieces, looped = separate(links)
    sizes = pieces.groupBy("id").agg(F.sum("more").alias("more"))
    trees = links.select("id", "pid")
    if looped is not None:
        looped = cut(looped)
        trees = trees.join(looped.select("id"), "id", "left_anti")
    if paths:
        trees = trees.join(names.select("id", "label"), "id")
    else:
        trees = trees.withColumn("label", F.lit(None).cast("string"))
    trees = cut(trees.join(sizes, "id", "left").select("id", "pid", "label", (F.lit(1) + F.coalesce("more", F.lit(0))).alias("size")))
    # The child with the largest subtree carries its parent's chain on.
    best = trees.where("pid IS NOT NULL").groupBy("pid").agg(F.max(F.struct("size", "id")).alias("b")).select(F.col("b.id").alias("id"), F.lit(True).alias("heavy"))
    trees = cut(trees.join(best, "id", "left").select("id", "pid", "label", "size", F.coalesce("heavy", F.lit(False)).alias("heavy")), trees)
    # Nothing hangs from a leaf. It is added last, behind its parent: the heavy one ends its
    # parent's chain, a light one is a chain of its own.
    leaf = "size = 1 AND pid IS NOT NULL"
    inner = trees.where(f"NOT ({leaf})")
    run = _chains(inner, sep)

    # Chains of chains: each chain hangs at a place of another, a root path crosses few of them.
    off = _sibling_offsets(trees) if intervals else None
    at = run.select(F.col("id").alias("pid"), F.col("head").alias("up"), F.col("place").alias("at"), F.col("seg").alias("above"))
    chain = inner.where("NOT heavy").select(F.col("id").alias("chain"), "pid", "label").join(at, "pid", "left")
    if intervals:
        off = cut(off)
        chain = chain.join(off.withColumnRenamed("id", "chain"), "chain", "left")
    else:
        chain = chain.withColumn("off", F.lit(None).cast("long"))
    none = F.lit(None).cast("string")
    # ``prefix``: labels from below the upper chain's head down to this chain's head, that included.
    left = F.count_if(~F.col("done"))
    chain = cut(chain.select("chain", F.coalesce("up", "chain").alias("up"), F.col("up").isNull().alias("done"), F.coalesce(F.col("at") + 1, F.lit(0)).alias("dist"), F.coalesce(F.col("at") + F.col("off"), F.lit(0)).alias("pre"), (F.concat_ws(sep, "above", "label") if paths else none).alias("prefix")), None, left=left)
    for _ in range(MOST_ROUNDS):
        if not seen(chain, "left"):
            break
        up = chain.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"), F.col("dist").alias("dist2"), F.col("pre").alias("pre2"), F.col("prefix").alias("prefix2"))
        moved = chain.where("NOT done").join(up, "up").select("chain", F.col("up2").alias("up"), F.col("done2").alias("done"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("pre") + F.col("pre2")).alias("pre"), (F.concat_ws(sep, "prefix2", "prefix") if paths else none).alias("prefix"))
        chain = cut(chain.where("done").unionByName(moved), chain, left=left)

    cols = ["id", F.col("up").alias("rid"), (F.col("dist") + F.col("place")).cast("int").alias("depth"), F.col("head").alias("chain"), "place"]
    kinds = {"rid": "long", "chain": "long", "place": "long"}
    if paths:
        cols.append(F.concat_ws(sep, "prefix", F.when(F.col("seg") != "", F.col("seg"))).alias("path"))
        kinds["path"] = "string"
    if intervals:
        cols.append((F.col("pre") + F.col("place")).alias("tree_pre"))
        kinds["tree_pre"] = "long"
    out = cut(run.join(chain.withColumnRenamed("chain", "head"), "head").select(*cols))
    leaves = trees.where(leaf).select(F.col("id").alias("leaf"), F.col("pid").alias("id"), "label", "heavy")
    if intervals:
        leaves = leaves.join(off.withColumnRenamed("id", "leaf"), "leaf", "left")
    hung = leaves.join(out, "id")
    heavy = F.col("heavy")
    lcols = [F.col("leaf").alias("id"), "rid", (F.col("depth") + 1).alias("depth"), F.when(heavy, F.col("chain")).otherwise(F.col("leaf")).alias("chain"), F.when(heavy, F.col("place") + 1).otherwise(F.lit(0).cast("long")).alias("place")]
    lcols += [F.concat_ws(sep, "path", "label").alias("path")] if paths else []
    # The heavy child comes right behind its parent.
    lcols += [(F.col("tree_pre") + F.coalesce("off", F.lit(1))).alias("tree_pre")] if intervals else []
    out = out.unionByName(hung.select(*lcols))
    out = out.join(trees.select("id", F.col("size").alias("subtree")), "id") if intervals else out.withColumn("subtree", F.lit(None).cast("long"))
    kinds["subtree"] = "long"
    if looped is not None:
        out = out.unionByName(looped.select("id", F.col("depth").cast("int").alias("depth"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())))
    named = names.select("id", "k").join(out, "id")
    roots = names.select(F.col("id").alias("rid"), F.col("k").alias("root")).join(links.where("pid IS NULL").select(F.col("id").alias("rid")), "rid", "left_semi")
    return named.join(roots, "rid", "left").drop("id", "rid")


#: Places of a tree that a join of intervals takes together.
BUCKET = 256


def descendants(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """All proper descendants of the nodes ``k`` in ``queries``: ``(k, descendant, below)``.

    An interval ``tree_pre < x < tree_pre + subtree`` is cut at multiples of ``BUCKET`` and joined on
    root and bucket, so a query meets its answer and at most two buckets more, not its whole tree.
    """
    q = labels.join(queries.select("k").distinct(), "k", "left_semi").where("depth >= 0 AND subtree > 1").select("k", "root", F.col("tree_pre").alias("lo"), (F.col("tree_pre") + F.col("subtree")).alias("hi"), F.col("depth").alias("d0"))
    bucket = lambda c: F.floor(c / BUCKET)
    q = q.withColumn("b", F.explode(F.sequence(bucket(F.col("lo") + 1), bucket(F.col("hi") - 1))))
    n = labels.where("depth >= 0").select(F.col("k").alias("descendant"), "root", "tree_pre", "depth", bucket(F.col("tree_pre")).alias("b"))
    return q.join(n, ["root", "b"]).where("tree_pre > lo AND tree_pre < hi").select("k", "descendant", (F.col("depth") - F.col("d0")).alias("below"))


SEP = "\x1f"


def _trim(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _linked(links: DataFrame) -> DataFrame:
    """``links (graph, source, node_id, parent_id)`` to ``(k, parent, label)``; an empty parent is null."""
    key = lambda c: F.concat_ws(SEP, "graph", "source", c)
    return links.select(key("node_id").alias("k"), F.when(F.col("parent_id") != "", key("parent_id")).alias("parent"), F.col("node_id").alias("label"))


def catalogue_links(nodes: DataFrame) -> DataFrame:
    """One row per node of ``catalogue_nodes``, with the parent of its latest reading.

    Ids are trimmed; rows without id are no nodes; a null source is the empty source.
    """
    rows = nodes.select(_trim(F.col("source")).alias("source"), _trim(F.col("id")).alias("node_id"), _trim(F.col("parent")).alias("parent_id"), "read_at").where("node_id != ''")
    last = rows.groupBy("source", "node_id").agg(F.max(F.struct("read_at", "parent_id")).alias("l"))
    return last.select(F.lit("catalogue_nodes").alias("graph"), "source", "node_id", F.col("l.parent_id").alias("parent_id"))


def edge_links(edges: DataFrame) -> DataFrame:
    """One row per end of a nesting edge. A node with several outer blocks keeps the one seen last."""
    e = edges.where(F.col("kind").isin("contains", "part_of"))
    outward = F.col("kind") == "contains"
    frm, to = _trim(F.col("from_id")), _trim(F.col("to_id"))
    links = e.select(F.when(outward, to).otherwise(frm).alias("node_id"), F.when(outward, frm).otherwise(to).alias("parent_id"), "seen_at")
    none = F.lit(None).cast(edges.schema["seen_at"].dataType)
    told = F.struct(F.col("node_id").alias("node_id"), F.struct(F.lit(1).alias("r"), F.col("seen_at").alias("seen_at"), F.col("parent_id").alias("parent_id")).alias("l"))
    outer = F.struct(F.col("parent_id").alias("node_id"), F.struct(F.lit(0).alias("r"), none.alias("seen_at"), F.lit("").alias("parent_id")).alias("l"))
    ends = links.select(F.inline(F.array(told, outer)))
    one = ends.where("node_id != ''").groupBy("node_id").agg(F.max("l").alias("l"))
    return one.select(F.lit("block_edges").alias("graph"), F.lit("").alias("source"), "node_id", F.col("l.parent_id").alias("parent_id"))


def both_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of both graphs, ready for :func:`hierarchy`."""
    return _linked(catalogue_links(nodes).unionByName(edge_links(edges)))


def unkey(labels: DataFrame) -> DataFrame:
    """The key columns ``graph, source, node_id, root_id`` of labelled nodes back from ``k`` and ``root``."""
    part = lambda c, i: F.split(c, SEP).getItem(i)
    return labels.select(part("k", 0).alias("graph"), part("k", 1).alias("source"), part("k", 2).alias("node_id"), F.coalesce(part("root", 2), F.lit("")).alias("root_id"), *[c for c in labels.columns if c not in ("k", "root")])
