"""Queries p1 to p5 over the project's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scale import cut, table
from weftline.operators import drift, hierarchy, nested, orphans, snapshots


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Field changes between consecutive graph files of a repo."""
    return drift.changes(table(spark, sf, "graph_files")).select("file_id", "collection", "field", "change", "new_field").distinct()


def p1_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All blocks of all files in one table."""
    return drift.consistent_table(cut(drift.profiles(table(spark, sf, "graph_files"))), "blocks")


def p1_brds(spark: SparkSession, sf: str) -> DataFrame:
    """All requirement documents of all files in one table."""
    return drift.consistent_table(cut(drift.profiles(table(spark, sf, "graph_files"))), "brds")


def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.both_graphs(table(spark, sf, "catalogue_nodes"), table(spark, sf, "block_edges"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every node; loops and what hangs below them."""
    return hierarchy.unkey(hierarchy.hierarchy(_graphs(spark, sf))).select("graph", "source", "node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path of every node; empty for nodes on and below loops."""
    out = hierarchy.unkey(hierarchy.hierarchy(_graphs(spark, sf), paths=True))
    return out.select("graph", "source", "node_id", "root_id", "depth", F.coalesce("path", F.lit("")).alias("path"))


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of every node, as intervals: those of a node are the nodes of its root
    with ``tree_pre`` above its own and below ``tree_pre + subtree``."""
    out = hierarchy.unkey(hierarchy.hierarchy(_graphs(spark, sf), intervals=True))
    return out.select("graph", "source", "node_id", "root_id", "tree_pre", "subtree")


def p2_below(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with each of its descendants and how far below it is, one row each."""
    labels = cut(hierarchy.hierarchy(_graphs(spark, sf), intervals=True))
    part = lambda c, i: F.split(c, hierarchy.SEP).getItem(i)
    out = hierarchy.descendants(labels, labels)
    return out.select(part("k", 0).alias("graph"), part("k", 1).alias("source"), part("k", 2).alias("node_id"), part("descendant", 2).alias("descendant_id"), "below")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Promises added, removed or changed from each snapshot to the next."""
    return snapshots.promise_changes(table(spark, sf, "audit_rows")).select("snapshot_no", "promise", "change")


def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    """The same with old and new values."""
    return snapshots.promise_changes(table(spark, sf, "audit_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """References that did not hold when recorded."""
    return orphans.rtm_orphans(table(spark, sf, "rtm_rows"), table(spark, sf, "invariants"), table(spark, sf, "symbols"))


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans counted by field and month."""
    return orphans.orphan_counts(p4_found(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every nested record of every manifest."""
    rows = nested.manifest_records(table(spark, sf, "features"), ["id", "business"])
    item = F.when(F.col("child") == "owner", F.col("f_business")).when(F.col("child") == "rule", F.lit("")).otherwise(F.coalesce("f_id", "key"))
    return rows.select(F.col("doc").alias("manifest_id"), "child", "parent_ordinal", "ordinal", F.coalesce(item, F.lit("")).alias("item"))


def _manifest_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: nested.manifest_table(table(spark, sf, "features"), name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_blocks, p1_brds, p2_found, p2_paths, p2_descendants, p2_below, p3_found, p3_values, p4_found, p4_counts, p5_found)} | {f"p5_{t}": _manifest_table(t) for t in nested.TABLES}

_P3 = r"""
WITH n AS (
  SELECT snapshot_no, delivery, loaded_at, lower(regexp_replace(promise, '[\s\p{Z}]+', '', 'g')) AS promise,
         coalesce(regexp_replace(lower(regexp_replace(class, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[-\s\p{Z}]', '_', 'g'), '') AS class,
         coalesce(regexp_replace(lower(regexp_replace(signals.demonstrated.value, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[-\s\p{Z}]', '_', 'g'), '') AS demonstrated
  FROM audit_rows),
top AS (SELECT snapshot_no, max(delivery) AS delivery FROM n GROUP BY 1),
l AS (
  SELECT snapshot_no, promise, class, demonstrated FROM n JOIN top USING (snapshot_no, delivery)
  WHERE promise IS NOT NULL AND promise <> ''
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, promise ORDER BY loaded_at DESC, class DESC, demonstrated DESC) = 1),
s AS (SELECT snapshot_no AS new_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS old_no FROM top),
a AS (SELECT s.new_no, l.* FROM l JOIN s ON l.snapshot_no = s.old_no),
b AS (SELECT s.new_no, l.* FROM l JOIN s ON l.snapshot_no = s.new_no WHERE s.old_no IS NOT NULL),
j AS (SELECT coalesce(a.new_no, b.new_no) AS snapshot_no, coalesce(a.promise, b.promise) AS promise,
       CASE WHEN a.promise IS NULL THEN 'added' WHEN b.promise IS NULL THEN 'removed' ELSE 'changed' END AS change,
       a.class AS old_class, a.demonstrated AS old_demonstrated, b.class AS new_class, b.demonstrated AS new_demonstrated
  FROM a FULL JOIN b ON a.new_no = b.new_no AND a.promise = b.promise
  WHERE a.promise IS NULL OR b.promise IS NULL OR a.class <> b.class OR a.demonstrated <> b.demonstrated)
"""

_P4 = r"""
WITH m AS (SELECT row_id, recorded_at, regexp_replace(feature_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS feature_id, maps_to, invariant_id, enforcers, verifiers FROM rtm_rows),
raw AS (
  SELECT row_id, recorded_at, feature_id, 'maps_to' AS field, unnest(string_split(maps_to, ',')) AS r FROM m
  UNION ALL SELECT row_id, recorded_at, feature_id, 'invariant_id', invariant_id FROM m
  UNION ALL SELECT row_id, recorded_at, feature_id, 'enforcers', unnest(enforcers) FROM m
  UNION ALL SELECT row_id, recorded_at, feature_id, 'verifiers', unnest(verifiers) FROM m),
c AS (SELECT row_id, recorded_at, feature_id, field, regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '#.*$', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\(\)$', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS r FROM raw),
refs AS (
  SELECT DISTINCT row_id, recorded_at, field,
         CASE WHEN field = 'maps_to' AND position(':' IN r) > 1 OR field IN ('enforcers', 'verifiers') THEN r ELSE feature_id || ':' || ltrim(r, ':') END AS ref_key,
         CASE field WHEN 'enforcers' THEN 'code' WHEN 'verifiers' THEN 'test' ELSE 'invariant' END AS target
  FROM c WHERE r IS NOT NULL AND r <> ''),
t AS (
  SELECT 'invariant' AS target, regexp_replace(feature, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') || ':' || regexp_replace(inv, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS ref_key, created_at, deleted_at FROM invariants
  UNION ALL SELECT CASE WHEN coalesce(is_test, false) THEN 'test' ELSE 'code' END, regexp_replace(fqn, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), created_at, deleted_at FROM symbols),
g AS (
  SELECT row_id, refs.field, refs.ref_key, recorded_at, count(t.ref_key) AS n,
         coalesce(bool_or(t.created_at <= recorded_at AND (t.deleted_at IS NULL OR t.deleted_at > recorded_at)), false) AS holds,
         coalesce(bool_or(t.created_at > recorded_at), false) AS late
  FROM refs LEFT JOIN t ON t.target = refs.target AND t.ref_key = refs.ref_key
  GROUP BY row_id, refs.field, refs.ref_key, recorded_at),
f AS (SELECT DISTINCT row_id, field, ref_key, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS state,
      strftime(recorded_at, '%Y-%m') AS in_month FROM g WHERE NOT holds)
"""

_P2 = r"""
WITH RECURSIVE c AS (
  SELECT 'catalogue_nodes' AS graph, coalesce(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS source, regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS node_id, arg_max(coalesce(regexp_replace(parent, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''), read_at) AS parent_id
  FROM catalogue_nodes WHERE regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '' GROUP BY ALL),
e AS (SELECT regexp_replace(CASE kind WHEN 'contains' THEN to_id ELSE from_id END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS n, regexp_replace(CASE kind WHEN 'contains' THEN from_id ELSE to_id END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS p
      FROM block_edges WHERE kind IN ('contains', 'part_of')),
b AS (SELECT 'block_edges' AS graph, '' AS source, n AS node_id, max(p) AS parent_id
      FROM (SELECT n, p FROM e UNION ALL SELECT p, '' FROM e) GROUP BY ALL),
l AS (SELECT * FROM c UNION ALL SELECT * FROM b),
nodes AS (SELECT l.*, o.node_id AS up FROM l LEFT JOIN l o ON o.graph = l.graph AND o.source = l.source AND o.node_id = l.parent_id),
tree AS (
  SELECT graph, source, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM nodes WHERE up IS NULL
  UNION ALL
  SELECT n.graph, n.source, n.node_id, t.root_id, t.depth + 1, t.path || '/' || n.node_id FROM nodes n JOIN tree t ON n.graph = t.graph AND n.source = t.source AND n.up = t.node_id),
rest AS (SELECT n.* FROM nodes n ANTI JOIN tree t ON n.graph = t.graph AND n.source = t.source AND n.node_id = t.node_id),
walk AS (
  SELECT graph, source, node_id AS start, up AS here FROM rest
  UNION
  SELECT w.graph, w.source, w.start, r.up FROM walk w JOIN rest r ON r.graph = w.graph AND r.source = w.source AND r.node_id = w.here),
loops AS (SELECT DISTINCT graph, source, start AS node_id FROM walk WHERE start = here),
lost AS (SELECT r.graph, r.source, r.node_id, '' AS root_id, CASE WHEN o.node_id IS NULL THEN -2 ELSE -1 END AS depth
         FROM rest r LEFT JOIN loops o ON o.graph = r.graph AND o.source = r.source AND o.node_id = r.node_id)
"""

SQL: dict[str, str] = {
    "p2_found": _P2 + "SELECT graph, source, node_id, root_id, depth FROM tree UNION ALL SELECT * FROM lost",
    "p2_paths": _P2 + "SELECT graph, source, node_id, root_id, depth, path FROM tree UNION ALL SELECT graph, source, node_id, root_id, depth, '' FROM lost",
    "p2_below": _P2 + """, d AS (
  SELECT graph, source, node_id, node_id AS descendant_id, 0 AS below FROM tree
  UNION ALL
  SELECT d.graph, d.source, d.node_id, n.node_id, d.below + 1 FROM d JOIN nodes n ON n.graph = d.graph AND n.source = d.source AND n.up = d.descendant_id)
SELECT graph, source, node_id, descendant_id, below FROM d WHERE below > 0""",
    "p3_found": _P3 + "SELECT snapshot_no, promise, change FROM j",
    "p3_values": _P3 + "SELECT * FROM j",
    "p4_found": _P4 + "SELECT * FROM f",
    "p4_counts": _P4 + "SELECT field, in_month, state, count(*) AS orphans FROM f GROUP BY ALL",
}
