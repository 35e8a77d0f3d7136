"""Graph operators over the block graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.registry import query

#: Links that lead on, in the SQL below: a start is a node that fulfills something and that nothing calls.
_E = "e AS (SELECT DISTINCT trim(from_id) AS src, trim(to_id) AS dst, kind FROM block_edges WHERE kind IN ('next', 'calls', 'fulfills')), s AS (SELECT DISTINCT src AS node FROM e WHERE kind = 'fulfills' AND src NOT IN (SELECT dst FROM e WHERE kind = 'calls'))"
_REACH = "WITH RECURSIVE " + _E + ", r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"


def _edges(t, *kinds):
    e = t("block_edges").where(F.col("kind").isin(*(kinds or ("next", "calls", "fulfills"))))
    return e.select(F.trim("from_id").alias("src"), F.trim("to_id").alias("dst"), "kind").distinct()


def _start(t):
    e = _edges(t)
    return e.where("kind = 'fulfills'").select(F.col("src").alias("node")).distinct().join(e.where("kind = 'calls'").select(F.col("dst").alias("node")), "node", "left_anti")


@query("r1_neighbourhood", "WITH RECURSIVE " + _E + ", w AS (SELECT node, 0 AS d FROM s UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 2) SELECT DISTINCT e.src, e.kind, e.dst FROM e JOIN (SELECT DISTINCT node FROM w) n ON e.src = n.node")
def r1(t):
    return graph.neighbourhood(_edges(t), _start(t), 3, "out")


@query("r1_reached", "WITH RECURSIVE " + _E + ", w AS (SELECT node, 0 AS d FROM s UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 60) SELECT node, min(d) AS depth FROM w GROUP BY 1")
def r1_reached(t):
    """Everything reached from the starts, with the fewest hops."""
    return graph.closure(_edges(t), _start(t))


@query("r3_reach_class", "WITH RECURSIVE " + _E + """, m AS (SELECT node FROM s UNION SELECT e.dst FROM m JOIN e ON e.src = m.node WHERE e.kind = 'next'), y AS (SELECT node FROM s UNION SELECT e.dst FROM y JOIN e ON e.src = y.node),
 q AS (SELECT DISTINCT src AS node FROM e WHERE kind = 'next'), tm AS (SELECT node FROM q UNION SELECT e.dst FROM tm JOIN e ON e.src = tm.node WHERE e.kind = 'next'), ty AS (SELECT node FROM q UNION SELECT e.dst FROM ty JOIN e ON e.src = ty.node),
 n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
 SELECT node, CASE WHEN node IN (SELECT node FROM m) THEN 'entry' WHEN node IN (SELECT node FROM y) THEN 'unknown' WHEN node IN (SELECT node FROM tm) THEN 'test_only' WHEN node IN (SELECT node FROM ty) THEN 'unknown' ELSE 'unreached' END AS class FROM n""")
def r3(t):
    e = _edges(t)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    tests = e.where("kind = 'next'").select(F.col("src").alias("node")).distinct()
    return graph.reach_classes(nodes, _edges(t, "next"), e, _start(t), tests)


@query("r2_rapid_types")
def r2(t):
    """Calls count as ambiguous: the callee joins once its outer block is reached."""
    e = _edges(t)
    outer = t("block_edges").where("kind = 'contains'").select(F.trim("from_id").alias("type"), F.trim("to_id").alias("dst")).distinct()
    return graph.rapid_types(e.where("kind <> 'calls'"), e.where("kind = 'calls'").join(outer, "dst").select("src", "dst", "type"), _start(t))


@query("r4_crossings", "WITH RECURSIVE " + _E + ", w AS (SELECT node, 0 AS d FROM s UNION SELECT e.dst, w.d + CASE WHEN e.kind = 'calls' THEN 1 ELSE 0 END FROM w JOIN e ON e.src = w.node WHERE w.d < 40) SELECT node, min(d) AS crossings FROM w GROUP BY 1")
def r4(t):
    """Fewest calls (taken as asynchronous) on the way from a start."""
    return graph.crossings(_edges(t, "next", "fulfills"), _edges(t, "calls"), _start(t))


@query("r5_shortest", "WITH RECURSIVE " + _E + ", w AS (SELECT node, 0 AS d FROM s UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 60), m AS (SELECT node, min(d) AS depth FROM w GROUP BY 1) SELECT m.node, m.depth, min(p.node) AS parent FROM m LEFT JOIN e ON e.dst = m.node LEFT JOIN m p ON p.node = e.src AND p.depth = m.depth - 1 GROUP BY 1, 2")
def r5(t):
    return graph.shortest_paths(_edges(t), _start(t))


@query("r7_intents", "WITH RECURSIVE " + _E + ", i AS (SELECT DISTINCT src AS node, split_part(src, ':', 1) AS intent FROM e WHERE kind = 'fulfills'), f AS (SELECT node, intent FROM i UNION SELECT e.dst, f.intent FROM f JOIN e ON e.src = f.node) SELECT node, count(*) AS n, min(intent) AS first FROM f GROUP BY 1")
def r7(t):
    """Intents flow from callers to callees to a fixed point."""
    e = _edges(t)
    seeds = e.where("kind = 'fulfills'").select(F.col("src").alias("node"), F.split("src", ":").getItem(0).alias("intent")).distinct()
    return graph.pair_closure(e, seeds, "intent").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("intent").alias("first"))


@query("r9_cycles", "WITH RECURSIVE " + _E + ", w AS (SELECT src AS a, dst AS node FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.node) SELECT DISTINCT a AS node FROM w WHERE a = node")
def r9(t):
    return graph.cyclic(_edges(t))


@query("r10_longest", "WITH RECURSIVE " + _E + ", c AS (SELECT src AS a, dst AS node FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.node), bad AS (SELECT DISTINCT a AS node FROM c WHERE a = node), behind AS (SELECT node FROM bad UNION SELECT e.dst FROM behind b JOIN e ON e.src = b.node), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS (SELECT node, 0 AS d FROM n WHERE node NOT IN (SELECT node FROM behind) UNION SELECT e.dst, l.d + 1 FROM l JOIN e ON e.src = l.node WHERE e.dst NOT IN (SELECT node FROM behind)) SELECT node, max(d) AS level FROM l GROUP BY 1")
def r10(t):
    """Edges of the longest chain that ends at each node; nodes on or behind cycles are left out."""
    return graph.peel(_edges(t))[0]


@query("r11_inverse", "WITH " + _E + " SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS callers, count(*) AS n FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1")
def r11(t):
    return graph.inverse(_edges(t))


@query("r13_depth_cap", "WITH RECURSIVE " + _E + ", w AS (SELECT node, 0 AS d FROM s UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 8) SELECT node, min(d) AS depth FROM w GROUP BY 1")
def r13(t):
    return graph.closure(_edges(t), _start(t), 8)


@query("r16_ways_in", "WITH RECURSIVE " + _E + ", r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node), z AS (SELECT DISTINCT src AS node FROM e WHERE kind = 'calls'), b AS (SELECT node FROM z UNION SELECT e.src FROM b JOIN e ON e.dst = b.node) SELECT node FROM r WHERE node IN (SELECT node FROM b)")
def r16(t):
    e = _edges(t)
    return graph.between(e, _start(t), e.where("kind = 'calls'").select(F.col("src").alias("node")))


@query("r19_roots", "WITH n AS (SELECT id AS node, CASE WHEN http_path IS NOT NULL THEN 0 WHEN kind = 'job' THEN 1 ELSE 2 END AS p FROM catalogue_nodes WHERE http_path IS NOT NULL OR kind IN ('job', 'screen')) SELECT node, (array['entry', 'cron', 'screen'])[min(p) + 1] AS reason FROM n GROUP BY 1")
def r19(t):
    """Where runs begin, with the first reason that applies."""
    p = F.when(F.col("http_path").isNotNull(), 0).when(F.col("kind") == "job", 1).otherwise(2)
    n = t("catalogue_nodes").where("http_path IS NOT NULL OR kind IN ('job', 'screen')").groupBy(F.col("id").alias("node")).agg(F.min(p).alias("p"))
    return n.select("node", F.element_at(F.array(F.lit("entry"), F.lit("cron"), F.lit("screen")), F.col("p") + 1).alias("reason"))


@query("r21_first_source", "WITH c AS (SELECT fqn AS node, 0 AS p FROM symbols WHERE end_line IS NOT NULL UNION ALL SELECT fqn, 1 FROM symbols WHERE feature IS NOT NULL UNION ALL SELECT fqn, 2 FROM symbols) SELECT node, min(p) AS basis FROM c GROUP BY 1")
def r21(t):
    """The best basis of several."""
    p = F.when(F.col("end_line").isNotNull(), 0).when(F.col("feature").isNotNull(), 1).otherwise(2)
    return t("symbols").groupBy(F.col("fqn").alias("node")).agg(F.min(p).alias("basis"))
