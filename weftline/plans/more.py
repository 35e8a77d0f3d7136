"""Further operators of joins, aggregates and graphs bound to the bundled tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import numbers, text
from weftline.operators import aggregates, filters, graph, hierarchy, joins
from weftline.plans.graphs import _edges
from weftline.plans.registry import query
from weftline.plans.rollups import STATUS

_STAT = "[" + ", ".join(f"'{s}'" for s in STATUS) + "]"


@query("j2_all_must_hold", r"""WITH r AS (SELECT row_id, unnest(string_split(maps_to, ',')) AS r, feature_id FROM (SELECT DISTINCT row_id, maps_to, feature_id FROM rtm_rows)),
 k AS (SELECT row_id, CASE WHEN position(':' IN t) > 1 THEN t ELSE feature_id || ':' || t END AS k FROM (SELECT row_id, feature_id, regexp_replace(trim(r), '#.*$', '') AS t FROM r) WHERE t <> ''),
 h AS (SELECT DISTINCT feature || ':' || inv AS k FROM invariants)
 SELECT k.row_id, count(*) AS refs, count(h.k) AS held, bool_and(h.k IS NOT NULL) AS holds FROM (SELECT DISTINCT row_id, k FROM k) k LEFT JOIN h ON h.k = k.k GROUP BY 1""")
def j2(t):
    """A criterion holds if all invariants it maps to exist."""
    r = t("rtm_rows").select("row_id", "maps_to", "feature_id").distinct().select("row_id", "feature_id", F.explode(F.split("maps_to", ",")).alias("r")).select("row_id", "feature_id", F.regexp_replace(F.trim("r"), "#.*$", "").alias("t")).where("t <> ''")
    k = r.select("row_id", F.when(F.instr("t", ":") > 1, F.col("t")).otherwise(F.concat("feature_id", F.lit(":"), "t")).alias("k")).where("k IS NOT NULL").distinct()
    h = t("invariants").select(F.concat("feature", F.lit(":"), "inv").alias("k")).distinct().withColumn("h", F.lit(1))
    return k.join(h, "k", "left").groupBy("row_id").agg(F.count(F.lit(1)).alias("refs"), F.count("h").alias("held"), F.bool_and(F.col("h").isNotNull()).alias("holds"))


@query("j3_typed_references", r"""WITH r AS (SELECT DISTINCT regexp_replace(trim(unnest(verifiers)), '\(\)$', '') AS r FROM rtm_rows)
 SELECT r.r AS ref, CASE WHEN bool_or(s.is_test) THEN 'test' WHEN count(s.fqn) > 0 THEN 'code' ELSE 'unresolved' END AS kind FROM r LEFT JOIN symbols s ON s.fqn = r.r WHERE r.r IS NOT NULL GROUP BY 1""")
def j3(t):
    r = t("rtm_rows").select(F.explode("verifiers").alias("r")).where("r IS NOT NULL").select(F.regexp_replace(F.trim("r"), r"\(\)$", "").alias("ref")).distinct()
    s = t("symbols").groupBy(F.col("fqn").alias("ref")).agg(F.bool_or("is_test").alias("test"))
    return r.join(s, "ref", "left").select("ref", F.when(F.col("test"), "test").when(F.col("test").isNotNull(), "code").otherwise("unresolved").alias("kind"))


@query("j4_hydrated_features", "SELECT f.feature, coalesce(s.code, 0) AS code, coalesce(s.tests, 0) AS tests, coalesce(i.promises, 0) AS promises FROM (SELECT DISTINCT feature_id AS feature FROM features WHERE feature_id IS NOT NULL) f LEFT JOIN (SELECT feature, count(DISTINCT CASE WHEN NOT is_test THEN fqn END) AS code, count(DISTINCT CASE WHEN is_test THEN fqn END) AS tests FROM symbols GROUP BY 1) s ON s.feature = f.feature LEFT JOIN (SELECT feature, count(DISTINCT inv) AS promises FROM invariants GROUP BY 1) i ON i.feature = f.feature")
def j4(t):
    s = t("symbols").groupBy("feature").agg(F.countDistinct(F.when(~F.col("is_test"), F.col("fqn"))).alias("code"), F.countDistinct(F.when(F.col("is_test"), F.col("fqn"))).alias("tests"))
    i = t("invariants").groupBy("feature").agg(F.countDistinct("inv").alias("promises"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t("features").where("feature_id IS NOT NULL").select(F.col("feature_id").alias("feature")).distinct().join(s, "feature", "left").join(i, "feature", "left").select("feature", z("code"), z("tests"), z("promises"))


@query("j10_templates")
def j10(t):
    """Names with their numbers as placeholders, and the tests they expand to."""
    s = t("symbols").where("is_test").select(F.concat_ws(".", "feature", F.regexp_replace("name", "_", "-")).alias("case"))
    tpl = s.select(F.regexp_replace("case", "-[a-z]+$", "-_").alias("ref"))
    return joins.template_join(tpl, s, "ref", "case").groupBy("ref").agg(F.count(F.lit(1)).alias("cases"), F.min("case").alias("first"))


@query("j11_report_names", r"SELECT s, count(DISTINCT name) AS names, CASE WHEN count(DISTINCT name) = 1 THEN min(name) END AS name FROM (SELECT name, CASE WHEN regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'test' ELSE regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS s FROM symbols WHERE is_test) GROUP BY 1")
def j11(t):
    """Report names by slug; ambiguous ones name nothing."""
    s = t("symbols").where("is_test").select("name", text.slug(F.col("name")).alias("s"))
    return s.groupBy("s").agg(F.countDistinct("name").alias("names"), F.min("name").alias("m")).select("s", "names", F.when(F.col("names") == 1, F.col("m")).alias("name"))


@query("j18_moved_or_removed", """WITH o AS (SELECT DISTINCT fqn, name FROM symbols WHERE deleted_at IS NOT NULL), n AS (SELECT DISTINCT fqn, name FROM symbols WHERE deleted_at IS NULL), w AS (SELECT name, count(DISTINCT fqn) AS k, min(fqn) AS f FROM n GROUP BY 1)
 SELECT o.fqn, CASE WHEN n.fqn IS NOT NULL THEN 'kept' WHEN w.k = 1 THEN 'moved' WHEN w.k > 1 THEN 'ambiguous' ELSE 'removed' END AS reason, CASE WHEN n.fqn IS NULL AND w.k = 1 THEN w.f END AS now FROM o LEFT JOIN n ON n.fqn = o.fqn LEFT JOIN w ON w.name = o.name""")
def j18(t):
    """Symbols that went: moved if exactly one living symbol has their name."""
    s = t("symbols")
    o = s.where("deleted_at IS NOT NULL").select("fqn", "name").distinct()
    live = s.where("deleted_at IS NULL").select("fqn", "name").distinct()
    w = live.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("fqn").alias("f"))
    j = o.join(live.select("fqn", F.lit(True).alias("kept")).distinct(), "fqn", "left").join(w, "name", "left")
    kept = F.coalesce("kept", F.lit(False))
    reason = F.when(kept, "kept").when(F.col("k") == 1, "moved").when(F.col("k") > 1, "ambiguous").otherwise("removed")
    return j.select("fqn", reason.alias("reason"), F.when(~kept & (F.col("k") == 1), F.col("f")).alias("now"))


@query("j20_touched_requirements", r"""WITH c AS (SELECT DISTINCT fqn FROM symbols WHERE created_at >= TIMESTAMP '2025-01-01'), r AS (SELECT row_id, brd_id, status, regexp_replace(trim(unnest(enforcers)), '\(\)$', '') AS e FROM rtm_rows)
 SELECT brd_id, count(DISTINCT CASE WHEN status IN ('verified', 'demonstrated', 'exercised') THEN row_id END) AS approved, count(DISTINCT CASE WHEN status NOT IN ('verified', 'demonstrated', 'exercised') THEN row_id END) AS draft FROM r JOIN c ON c.fqn = r.e GROUP BY 1""")
def j20(t):
    """Criteria touched by young symbols, split by state."""
    c = t("symbols").where(F.col("created_at") >= F.lit("2025-01-01").cast("timestamp_ntz")).select(F.col("fqn").alias("e")).distinct()
    r = t("rtm_rows").select("row_id", "brd_id", "status", F.explode("enforcers").alias("e")).withColumn("e", F.regexp_replace(F.trim("e"), r"\(\)$", "")).join(c, "e", "left_semi")
    ok = F.col("status").isin("verified", "demonstrated", "exercised")
    return r.groupBy("brd_id").agg(F.countDistinct(F.when(ok, F.col("row_id"))).alias("approved"), F.countDistinct(F.when(~ok, F.col("row_id"))).alias("draft"))


@query("j25_column_overlap", "WITH w AS (SELECT l_orderkey AS g, list(DISTINCT l_partkey) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), p AS (SELECT l_orderkey AS g, list(DISTINCT l_partkey) AS b, bool_or(l_tax = 0) AS wild FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT w.g AS l_orderkey, coalesce(p.wild OR list_has_any(w.a, p.b), false) AS guarded FROM w LEFT JOIN p USING (g)")
def j25(t):
    """Is a writer guarded: do the columns overlap, or is the guard for all columns?"""
    l = t("lineitem")  # noqa: E741
    w = l.where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"))
    p = l.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("b"), F.bool_or(F.col("l_tax") == 0).alias("wild"))
    return w.join(p, "l_orderkey", "left").select("l_orderkey", F.coalesce(F.col("wild") | F.arrays_overlap("a", "b"), F.lit(False)).alias("guarded"))


@query("j26_granted", """WITH g AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 50) AS own, bool_or(event_type = 'error' AND value > 50) AS revoked FROM events GROUP BY 1), pub AS (SELECT bool_or(event_type = 'view' AND value > 400) AS p FROM events)
 SELECT user_id, CASE WHEN own THEN 'granted' WHEN pub.p THEN 'granted' WHEN revoked THEN 'revoked' ELSE 'unknown' END AS state FROM g, pub""")
def j26(t):
    """Precedence of own, public and revoked grants."""
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    e, v = F.col("event_type"), F.col("value")
    g = t("events").groupBy("user_id").agg(any_((e == "purchase") & (v > 50)).alias("own"), any_((e == "error") & (v > 50)).alias("revoked"))
    pub = t("events").agg(any_((e == "view") & (v > 400)).alias("p"))  # one row
    return g.join(F.broadcast(pub)).select("user_id", F.when(F.col("own") | F.col("p"), "granted").when(F.col("revoked"), "revoked").otherwise("unknown").alias("state"))


@query("j30_failed_cases", r"""WITH f AS (SELECT DISTINCT fqn FROM symbols WHERE is_test AND end_line IS NULL), r AS (SELECT DISTINCT row_id, regexp_replace(trim(unnest(verifiers)), '\(\)$', '') AS v FROM rtm_rows)
 SELECT v AS failed, count(*) AS rows_hit FROM r JOIN f ON f.fqn = r.v GROUP BY 1""")
def j30(t):
    f = t("symbols").where("is_test AND end_line IS NULL").select(F.col("fqn").alias("failed")).distinct()
    r = t("rtm_rows").select("row_id", F.explode("verifiers").alias("v")).select("row_id", F.regexp_replace(F.trim("v"), r"\(\)$", "").alias("failed")).distinct()
    return r.join(f, "failed", "left_semi").groupBy("failed").agg(F.count(F.lit(1)).alias("rows_hit"))


@query("j34_shared_blocks", "WITH m AS (SELECT DISTINCT brd_id, feature_id FROM rtm_rows WHERE feature_id IS NOT NULL), k AS (SELECT feature_id, count(*) AS n, min(brd_id) AS first, max(brd_id) AS last FROM m GROUP BY 1) SELECT feature_id, n, first, last FROM k WHERE n > 1")
def j34(t):
    """Items that several requirements share: the group, not all its pairs."""
    m = t("rtm_rows").where("feature_id IS NOT NULL AND brd_id IS NOT NULL").select("brd_id", "feature_id").distinct()
    return m.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.min("brd_id").alias("first"), F.max("brd_id").alias("last")).where("n > 1")


@query("a5_worst_cascade", f"""WITH s AS (SELECT brd_id, count(*) AS total, {', '.join(f"count(*) FILTER (status = '{x}') AS {x}" for x in STATUS)} FROM (SELECT DISTINCT row_id, brd_id, status FROM rtm_rows) GROUP BY 1)
 SELECT brd_id, CASE WHEN total = 0 THEN 'unmapped' WHEN phantom > 0 THEN 'phantom' WHEN unenforced > 0 THEN 'unenforced' WHEN failing > 0 THEN 'failing' WHEN unverified > 0 THEN 'unverified' WHEN partial > 0 THEN 'partial' WHEN unmapped > 0 AND verified = 0 AND demonstrated + exercised = 0 THEN 'unmapped' WHEN verified > 0 THEN 'verified' WHEN exercised > 0 AND demonstrated = 0 THEN 'exercised' ELSE 'demonstrated' END AS worst FROM s""")
def a5(t):
    d = t("rtm_rows").select("row_id", "brd_id", "status").distinct()
    s = aggregates.status_summary(d, ["brd_id"], "status", ("verified",), STATUS)
    w = F.when(F.col("total") == 0, "unmapped")
    for c in ("phantom", "unenforced", "failing", "unverified", "partial"):
        w = w.when(F.col(c) > 0, c)
    proven = F.col("demonstrated") + F.col("exercised")
    w = w.when((F.col("unmapped") > 0) & (F.col("verified") == 0) & (proven == 0), "unmapped").when(F.col("verified") > 0, "verified").when((F.col("exercised") > 0) & (F.col("demonstrated") == 0), "exercised").otherwise("demonstrated")
    return s.select("brd_id", w.alias("worst"))


@query("a14_live_fold", "SELECT feature, CASE WHEN bool_or(signals.live.value = 'yes') THEN 'entry' WHEN bool_or(signals.live.value IS NULL OR signals.live.value = 'unknown') THEN 'unknown' ELSE 'unreached' END AS live FROM audit_rows WHERE feature IS NOT NULL GROUP BY 1")
def a14(t):
    v = F.col("signals.live.value")
    return t("audit_rows").where("feature IS NOT NULL").groupBy("feature").agg(F.when(F.bool_or(F.coalesce(v == "yes", F.lit(False))), "entry").when(F.bool_or(v.isNull() | (v == "unknown")), "unknown").otherwise("unreached").alias("live"))


@query("a17_outside_blocks", "WITH s AS (SELECT DISTINCT file, line AS lo, end_line AS hi FROM symbols WHERE end_line > line), p AS (SELECT DISTINCT file, line AS at_line FROM symbols WHERE line IS NOT NULL) SELECT file, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file = p.file AND p.at_line > s.lo AND p.at_line <= s.hi) GROUP BY 1")
def a17(t):
    """Lines that lie within no other block, per file."""
    s = t("symbols").select("file", F.col("line").alias("lo"), F.col("end_line").alias("hi")).distinct()
    p = t("symbols").where("line IS NOT NULL").select("file", F.col("line").alias("at_line")).distinct()
    inside = joins.interval_join(p, s, ["file"], "at_line", "lo", "hi", 64.0).select("file", "at_line")
    return p.join(inside, ["file", "at_line"], "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("a18_coverage_ratios", "SELECT lang, floor(count(feature)::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS attributed, floor(count(end_line)::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS measured FROM symbols GROUP BY 1")
def a18(t):
    n = F.count(F.lit(1))
    return t("symbols").groupBy("lang").agg(numbers.ratio(F.count("feature"), n).alias("attributed"), numbers.ratio(F.count("end_line"), n).alias("measured"))


@query("a30_proof_tally", "SELECT kind, CASE WHEN http_path IS NOT NULL THEN 'entrypoint' WHEN status IS NULL THEN 'unknown' ELSE 'none' END AS proof, count(*) AS n FROM catalogue_nodes GROUP BY 1, 2")
def a30(t):
    p = F.when(F.col("http_path").isNotNull(), "entrypoint").when(F.col("status").isNull(), "unknown").otherwise("none")
    return t("catalogue_nodes").groupBy("kind", p.alias("proof")).agg(F.count(F.lit(1)).alias("n"))


@query("a32_quorum", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) < 5 THEN 'open' WHEN bool_or(o_orderstatus = 'P') THEN 'changes' ELSE 'agreed' END AS verdict FROM orders GROUP BY 1")
def a32(t):
    """Agreed only if every seat has voted and none asks for changes."""
    return t("orders").groupBy("o_custkey").agg(F.when(F.countDistinct("o_orderpriority") < 5, "open").when(F.bool_or(F.coalesce(F.col("o_orderstatus") == "P", F.lit(False))), "changes").otherwise("agreed").alias("verdict"))


@query("w4_next_actions", "SELECT DISTINCT row_id, status FROM rtm_rows r WHERE status IN ('phantom', 'unenforced', 'failing') AND NOT EXISTS (SELECT 1 FROM features f WHERE f.feature_id = r.feature_id AND f.status = 'deprecated') ORDER BY list_position(" + _STAT + ", status), row_id LIMIT 10")
def w4(t):
    """The ten most severe rows whose feature nobody has withdrawn."""
    held = t("features").where("status = 'deprecated'").select("feature_id")
    r = t("rtm_rows").where("status IN ('phantom', 'unenforced', 'failing')").join(held, "feature_id", "left_anti").select("row_id", "status").distinct()
    return aggregates.top_k(r, [aggregates.ranked(F.col("status"), STATUS), F.col("row_id")], 10)


@query("o1_worst_first", "SELECT row_id, status, row_number() OVER (PARTITION BY status ORDER BY row_id) AS place FROM (SELECT DISTINCT row_id, status FROM rtm_rows)")
def o1(t):
    d = t("rtm_rows").select("row_id", "status").distinct()
    out = d.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy("row_id")).cast("long"))
    return out.orderBy(aggregates.ranked(F.col("status"), STATUS), "row_id")


@query("o6_systems_by_size", "SELECT source, count(*) AS n FROM catalogue_nodes GROUP BY 1 ORDER BY n DESC, source")
def o6(t):
    return t("catalogue_nodes").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("c15_extents", "SELECT DISTINCT fqn, line || '-' || end_line AS extent, end_line - line + 1 AS n FROM symbols WHERE end_line IS NOT NULL")
def c15(t):
    s = t("symbols").where("end_line IS NOT NULL").select("fqn", F.concat_ws("-", "line", "end_line").alias("extent")).distinct()
    return s.select("fqn", "extent", numbers.extent_length(F.col("extent")).alias("n"))


@query("f7_implementations", "SELECT DISTINCT fqn, kind FROM symbols WHERE kind IN ('class', 'function', 'method', 'trait') AND NOT is_test")
def f7(t):
    return t("symbols").where(filters.is_implementation(F.col("kind"), ~F.col("is_test"))).select("fqn", "kind").distinct()


@query("f12_positive_classes", r"SELECT snapshot_no, count(*) AS n FROM audit_rows WHERE regexp_replace(lower(trim(class)), '[- ]', '_', 'g') IN ('exercised', 'break_tested') GROUP BY 1")
def f12(t):
    c = F.regexp_replace(F.lower(F.trim("class")), "[- ]", "_")
    return t("audit_rows").where(c.isin("exercised", "break_tested")).groupBy("snapshot_no").agg(F.count(F.lit(1)).alias("n"))


@query("r8_membership", "WITH RECURSIVE e AS (SELECT DISTINCT trim(CASE kind WHEN 'contains' THEN to_id ELSE from_id END) AS src, trim(CASE kind WHEN 'contains' THEN from_id ELSE to_id END) AS dst FROM block_edges WHERE kind IN ('contains', 'part_of')), m AS (SELECT src AS node, dst AS grp FROM e UNION SELECT m.node, e.dst FROM m JOIN e ON e.src = m.grp) SELECT node, count(*) AS groups FROM m GROUP BY 1")
def r8(t):
    """How many groups each node is a member of, directly or through others."""
    e = t("block_edges").where("kind IN ('contains', 'part_of')")
    inner = F.when(F.col("kind") == "contains", F.trim("to_id")).otherwise(F.trim("from_id"))
    outer = F.when(F.col("kind") == "contains", F.trim("from_id")).otherwise(F.trim("to_id"))
    links = e.select(inner.alias("node"), outer.alias("grp")).distinct()
    # Groups flow down from outer to inner blocks.
    pairs = graph.pair_closure(links.select(F.col("grp").alias("src"), F.col("node").alias("dst")), links, "grp")
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("groups"))


@query("r12_top_level", r"""WITH RECURSIVE n AS (SELECT source, id, arg_max(parent, read_at) AS parent FROM (SELECT coalesce(regexp_replace(source, '^\s+|\s+$', '', 'g'), '') AS source, regexp_replace(id, '^\s+|\s+$', '', 'g') AS id, coalesce(regexp_replace(parent, '^\s+|\s+$', '', 'g'), '') AS parent, read_at FROM catalogue_nodes) GROUP BY 1, 2),
 t AS (SELECT source, id, id AS top FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.source = n.source AND o.id = n.parent) UNION ALL SELECT n.source, n.id, t.top FROM n JOIN t ON n.source = t.source AND n.parent = t.id)
 SELECT source, top, count(*) AS nodes FROM t GROUP BY 1, 2""")
def r12(t):
    """Nodes under each top-level node, by the hierarchy operator."""
    links = hierarchy._linked(hierarchy.catalogue_links(t("catalogue_nodes")))
    out = hierarchy.unkey(hierarchy.hierarchy(links)).where("depth >= 0")
    return out.groupBy("source", F.col("root_id").alias("top")).agg(F.count(F.lit(1)).alias("nodes"))


@query("r14_blast_radius", "WITH RECURSIVE e AS (SELECT DISTINCT trim(from_id) AS src, trim(to_id) AS dst FROM block_edges WHERE kind IN ('next', 'calls', 'fulfills')), s AS (SELECT DISTINCT trim(from_id) AS node FROM block_edges WHERE kind = 'calls' AND truth = 'wired'), w AS (SELECT node, 0 AS d FROM s UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 8) SELECT split_part(node, ':', 1) AS area, count(DISTINCT node) AS nodes, min(d) AS nearest FROM (SELECT node, min(d) AS d FROM w GROUP BY 1) GROUP BY 1")
def r14(t):
    """What wired callers reach within eight hops, by area."""
    s = t("block_edges").where("kind = 'calls' AND truth = 'wired'").select(F.trim("from_id").alias("node"))
    return graph.closure(_edges(t), s, 8).groupBy(F.split("node", ":").getItem(0).alias("area")).agg(F.count(F.lit(1)).alias("nodes"), F.min("depth").alias("nearest"))


@query("r18_inherited_labels")
def r18(t):
    """Labels a block has itself or inherits from the blocks around it."""
    e = t("block_edges").where("kind IN ('contains', 'part_of')")
    outer = F.when(F.col("kind") == "contains", F.trim("from_id")).otherwise(F.trim("to_id"))
    inner = F.when(F.col("kind") == "contains", F.trim("to_id")).otherwise(F.trim("from_id"))
    own = t("block_edges").select(F.trim("from_id").alias("node"), F.explode("labels").alias("label")).where("label IS NOT NULL").distinct()
    pairs = graph.pair_closure(e.select(outer.alias("src"), inner.alias("dst")), own, "label")
    return pairs.groupBy("node").agg(F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"))


@query("q3_case_coverage", r"""WITH c AS (SELECT regexp_extract(trim(r), '^([^#]+)#', 1) AS inv, regexp_extract(trim(r), '#(.+)$', 1) AS case_id, verifiers, enforcers, status FROM (SELECT unnest(string_split(maps_to, ',')) AS r, verifiers, enforcers, status FROM rtm_rows) WHERE position('#' IN r) > 0)
 SELECT inv, case_id, CASE WHEN bool_or(status = 'failing') THEN 'failing' WHEN bool_and(verifiers IS NULL OR len(verifiers) = 0) THEN 'uncovered' WHEN bool_or(status IN ('demonstrated', 'exercised')) THEN 'covered' ELSE 'partial' END AS state FROM c GROUP BY 1, 2""")
def q3(t):
    """Acceptance cases: failing, then uncovered, then covered, else partial."""
    r = t("rtm_rows").select(F.explode(F.split("maps_to", ",")).alias("r"), "verifiers", "status").where(F.instr("r", "#") > 0)
    r = r.select(F.regexp_extract(F.trim("r"), "^([^#]+)#", 1).alias("inv"), F.regexp_extract(F.trim("r"), "#(.+)$", 1).alias("case_id"), "verifiers", "status")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    state = F.when(any_(F.col("status") == "failing"), "failing").when(F.bool_and(F.col("verifiers").isNull() | (F.size("verifiers") == 0)), "uncovered").when(any_(F.col("status").isin("demonstrated", "exercised")), "covered").otherwise("partial")
    return r.groupBy("inv", "case_id").agg(state.alias("state"))


@query("q17_business_view", "SELECT source, count(*) AS blocks, count(DISTINCT kind) AS kinds, count(*) FILTER (status = 'built') AS built, count(*) FILTER (status IS NULL) AS unknown, count(DISTINCT area) AS areas FROM catalogue_nodes GROUP BY 1")
def q17(t):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return t("catalogue_nodes").groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("kind").alias("kinds"), n(F.col("status") == "built").alias("built"), n(F.col("status").isNull()).alias("unknown"), F.countDistinct("area").alias("areas"))


@query("q15_proposal_conflicts", "SELECT http_method, http_path, count(DISTINCT source) AS sources FROM catalogue_nodes WHERE http_path IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source) > 1")
def q15(t):
    """Routes that more than one source declares."""
    return t("catalogue_nodes").where("http_path IS NOT NULL").groupBy("http_method", "http_path").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


@query("q9_line_levels", "WITH l AS (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A' AND l_discount >= 0.09) THEN 'checked' WHEN bool_or(l_returnflag = 'A') THEN 'run' WHEN bool_or(l_returnflag = 'R') THEN 'other' WHEN bool_and(l_returnflag = 'N') THEN 'not_run' ELSE 'unknown' END AS level, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT level, count(*) AS n FROM l GROUP BY 1")
def q9(t):
    """The level of each line, first that applies, counted."""
    f = F.col("l_returnflag")
    lv = F.when(F.bool_or((f == "A") & (F.col("l_discount") >= 0.09)), "checked").when(F.bool_or(f == "A"), "run").when(F.bool_or(f == "R"), "other").when(F.bool_and(f == "N"), "not_run").otherwise("unknown")
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(lv.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
