"""Further operators bound to the bundled tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import numbers
from weftline.functions.scale import cut
from weftline.operators import aggregates, graph, hierarchy, joins, nested
from weftline.operators.orphans import rtm_references, trimmed
from weftline.plans.graphs import _E, _edges, _start
from weftline.plans.registry import query

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '#.*$', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '\(\)$', ''), '[\s\p{{Z}}]+$', '')"
_TRIM = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_MATRIX = f"""WITH m AS (SELECT row_id, tier, {_TRIM.format(c='feature_id')} AS f, maps_to, invariant_id, enforcers, verifiers FROM rtm_rows),
 p0 AS (SELECT row_id, f, 'maps_to' AS field, {_PLAIN.format(c='u')} AS r FROM (SELECT row_id, f, unnest(string_split(maps_to, ',')) AS u FROM m) UNION ALL SELECT row_id, f, 'invariant_id', {_PLAIN.format(c='invariant_id')} FROM m),
 p AS (SELECT DISTINCT row_id, CASE WHEN field = 'maps_to' AND position(':' IN r) > 1 THEN r WHEN field = 'maps_to' THEN coalesce(f, '') || ':' || ltrim(r, ':') ELSE coalesce(f, '') || ':' || r END AS promise FROM p0 WHERE r <> ''),
 e AS (SELECT DISTINCT row_id, {_PLAIN.format(c='u')} AS x FROM (SELECT row_id, unnest(enforcers) AS u FROM m)), v AS (SELECT DISTINCT row_id, {_PLAIN.format(c='u')} AS x FROM (SELECT row_id, unnest(verifiers) AS u FROM m)),
 pe AS (SELECT promise, string_agg(x, ',' ORDER BY x) AS enforcers, count(*) AS n_enforcers FROM (SELECT DISTINCT promise, x FROM p JOIN e USING (row_id) WHERE x <> '') GROUP BY 1),
 pv AS (SELECT promise, string_agg(x, ',' ORDER BY x) AS verifiers, count(*) AS n_verifiers FROM (SELECT DISTINCT promise, x FROM p JOIN v USING (row_id) WHERE x <> '') GROUP BY 1),
 i AS (SELECT DISTINCT {_TRIM.format(c='feature')} || ':' || {_TRIM.format(c='inv')} AS promise FROM invariants WHERE feature IS NOT NULL AND inv IS NOT NULL)"""


def _matrix(t):
    """The references of the matrix: ``row_id, promise``, and the enforcers and verifiers per promise."""
    r = rtm_references(t("rtm_rows")).select("row_id", "field", "ref_key").distinct()
    p = r.where("field IN ('maps_to', 'invariant_id')").select("row_id", F.col("ref_key").alias("promise")).distinct()

    def of(field: str, name: str):
        return joins.grouped_refs(p.join(r.where(F.col("field") == field), "row_id").select("promise", "ref_key"), ["promise"], "ref_key", name)

    return p, of("enforcers", "enforcers"), of("verifiers", "verifiers")


def _promises(t):
    return t("invariants").where("feature IS NOT NULL AND inv IS NOT NULL").select(F.concat(trimmed("feature"), F.lit(":"), trimmed("inv")).alias("promise")).distinct()


@query("j1_matrix", _MATRIX + " SELECT promise, coalesce(enforcers, '') AS enforcers, coalesce(n_enforcers, 0) AS n_enforcers, coalesce(verifiers, '') AS verifiers, coalesce(n_verifiers, 0) AS n_verifiers FROM i LEFT JOIN pe USING (promise) LEFT JOIN pv USING (promise)")
def j1(t):
    """Each declared promise with the enforcers and verifiers of all rows that refer to it, by whichever reference."""
    _, e, v = _matrix(t)
    none, zero = F.lit(""), F.lit(0)
    return _promises(t).join(e, "promise", "left").join(v, "promise", "left").select("promise", *(F.coalesce(n, none).alias(n) if not n.startswith("n_") else F.coalesce(n, zero).alias(n) for n in ("enforcers", "n_enforcers", "verifiers", "n_verifiers")))


@query("j2_worst_of", _MATRIX + """, s AS (SELECT p.row_id, min(CASE WHEN i.promise IS NULL THEN 0 WHEN pe.promise IS NULL THEN 1 WHEN pv.promise IS NULL THEN 3 ELSE 6 END) AS s, count(*) AS promises FROM p LEFT JOIN i USING (promise) LEFT JOIN pe USING (promise) LEFT JOIN pv USING (promise) GROUP BY 1)
 SELECT r.row_id, coalesce(s.promises, 0) AS promises, CASE coalesce(s.s, 4) WHEN 0 THEN 'phantom' WHEN 1 THEN 'unenforced' WHEN 3 THEN 'unverified' WHEN 4 THEN 'unmapped' ELSE 'verified' END AS status FROM (SELECT DISTINCT row_id FROM rtm_rows) r LEFT JOIN s USING (row_id)""")
def j2(t):
    """A criterion is as good as the worst of its promises; one without any is unmapped."""
    p, e, v = _matrix(t)
    has = lambda df, c: df.select("promise", F.lit(True).alias(c))
    j = p.join(has(_promises(t), "i"), "promise", "left").join(has(e, "e"), "promise", "left").join(has(v, "v"), "promise", "left")
    sev = F.when(F.col("i").isNull(), 0).when(F.col("e").isNull(), 1).when(F.col("v").isNull(), 3).otherwise(6)
    worst = j.groupBy("row_id").agg(F.min(sev).alias("s"), F.count(F.lit(1)).alias("promises"))
    s = F.coalesce("s", F.lit(4))
    status = F.when(s == 0, "phantom").when(s == 1, "unenforced").when(s == 3, "unverified").when(s == 4, "unmapped").otherwise("verified")
    return t("rtm_rows").select("row_id").distinct().join(worst, "row_id", "left").select("row_id", F.coalesce("promises", F.lit(0)).alias("promises"), status.alias("status"))


@query("j15_coload", "WITH RECURSIVE " + _E + """, p AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE kind = 'fulfills'), x AS (SELECT a AS o, a AS node FROM p UNION SELECT b, b FROM p), u AS (SELECT o, node FROM x UNION SELECT u.o, e.src FROM u JOIN e ON e.dst = u.node AND e.kind = 'calls')
 SELECT DISTINCT a, b FROM p JOIN u x ON x.o = a JOIN u y ON y.o = b AND y.node = x.node""")
def j15(t):
    """Ends of one `fulfills` edge that some block calls both, directly or through others."""
    return graph.coloaded(_edges(t, "calls"), _edges(t, "fulfills").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("j17_aliases", r"""WITH k AS (SELECT DISTINCT trim(from_id) AS k FROM block_edges UNION SELECT DISTINCT trim(to_id) FROM block_edges), a AS (SELECT prefix, row_number() OVER (ORDER BY prefix) AS r FROM (SELECT DISTINCT regexp_extract(k, '^([a-z]+:)', 1) AS prefix FROM k) WHERE prefix <> ''),
 i AS (SELECT DISTINCT trim(id) AS id FROM catalogue_nodes WHERE id IS NOT NULL), w AS (SELECT id, id AS k, -1 AS r FROM i UNION ALL SELECT id, prefix || id, r FROM i, a), h AS (SELECT id, arg_min(w.k, r) AS resolved FROM w JOIN k ON k.k = w.k GROUP BY 1)
 SELECT id, resolved FROM i LEFT JOIN h USING (id)""")
def j17(t):
    """Catalogue ids as block ids, by the kinds of blocks that may stand before them."""
    e = t("block_edges")
    known = e.select(F.trim("from_id").alias("id")).unionByName(e.select(F.trim("to_id").alias("id"))).distinct()
    kinds = known.select(F.regexp_extract("id", "^([a-z]+:)", 1).alias("prefix")).where("prefix <> ''").distinct()  # one row per kind of block
    prefixes = kinds.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("prefix")))
    return joins.resolve_ids(t("catalogue_nodes").select(F.trim("id").alias("id")), known, prefixes)


@query("j27_policies", """WITH s AS (SELECT DISTINCT l_suppkey AS object, l_returnflag AS op, l_linestatus AS role FROM lineitem), p AS (SELECT DISTINCT l_suppkey AS object, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_returnflag END AS op, CASE WHEN l_linestatus = 'O' THEN 'group' ELSE l_linestatus END AS role FROM lineitem WHERE l_discount >= 0.1 AND l_tax > 0.02 AND l_quantity > 40),
 w AS (SELECT object, op, role, role AS r, true AS sure FROM s UNION ALL SELECT object, op, role, 'public', true FROM s UNION ALL SELECT object, op, role, 'group', false FROM s WHERE role = 'O'),
 h AS (SELECT w.object, w.op, w.role, bool_or(sure) AS sure FROM w JOIN p ON p.object = w.object AND p.role = w.r AND (p.op IS NULL OR p.op = w.op) GROUP BY 1, 2, 3)
 SELECT s.object, s.op, s.role, CASE WHEN s_acctbal <= 0 OR h.sure THEN 'allowed' WHEN h.sure IS NOT NULL THEN 'unknown' ELSE 'denied' END AS state FROM s JOIN supplier ON s_suppkey = s.object LEFT JOIN h ON h.object = s.object AND h.op = s.op AND h.role = s.role""")
def j27(t):
    """Row policies on an analogue: suppliers as tables, return flags as commands, line states as roles."""
    l = t("lineitem")  # noqa: E741
    subjects = l.select(F.col("l_suppkey").alias("object"), F.col("l_returnflag").alias("op"), F.col("l_linestatus").alias("role"))
    policies = l.where("l_discount >= 0.1 AND l_quantity > 40").select(F.col("l_suppkey").alias("object"), F.when(F.col("l_linenumber") <= 5, F.col("l_returnflag")).alias("op"), F.when(F.col("l_linestatus") == "O", "group").otherwise(F.col("l_linestatus")).alias("role"), (F.col("l_tax") <= 0.02).alias("restrictive"))
    members = subjects.where("role = 'O'").select("role", F.lit("group").alias("of"), F.lit(False).alias("certain")).distinct()
    return joins.policy_test(subjects, t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("object")), policies, members)


@query("j29_killers")
def j29(t):
    """Verifiers of each promise that fail with it: tests that are gone stand for the failed ones, under their last two parts."""
    r = rtm_references(t("rtm_rows")).select("row_id", "field", "ref_key").distinct()
    p = r.where("field IN ('maps_to', 'invariant_id')").select("row_id", F.col("ref_key").alias("promise"))
    v = p.join(r.where("field = 'verifiers'").select("row_id", F.col("ref_key").alias("verifier")), "row_id")
    gone = t("symbols").where("is_test AND deleted_at IS NOT NULL").select(F.col("fqn").alias("verifier"), F.regexp_extract("fqn", r"([^.]+\.[^.]+)$", 1).alias("failed")).distinct()
    return joins.killers(v.join(gone, "verifier").select("promise", "failed"), v)


@query("r5_paths")
def r5(t):
    """The way from each start to every block that lies with it in one outer block: `next` is synchronous, `fulfills` asynchronous, `calls` unknown."""
    kind = F.when(F.col("kind") == "next", "sync").when(F.col("kind") == "fulfills", "async").otherwise("unknown")
    inner = t("block_edges").where("kind = 'contains'").select(F.trim("from_id").alias("outer"), F.trim("to_id").alias("node")).distinct()
    pairs = _start(t).join(inner, "node").select(F.col("node").alias("root"), "outer").join(inner.withColumnRenamed("node", "target"), "outer").where("root <> target").select("root", "target")
    return graph.paths_by_mode(_edges(t).select("src", "dst", kind.alias("kind")), pairs)


@query("r8_certainty", "WITH RECURSIVE " + _E + """, i AS (SELECT DISTINCT src AS node, split_part(src, ':', 1) AS role FROM e WHERE kind = 'fulfills'), y AS (SELECT node, role FROM i UNION SELECT e.dst, y.role FROM y JOIN e ON e.src = y.node WHERE e.kind <> 'calls'), z AS (SELECT node, role FROM i UNION SELECT e.dst, z.role FROM z JOIN e ON e.src = z.node)
 SELECT z.node, z.role, y.node IS NOT NULL AS certain FROM z LEFT JOIN y ON y.node = z.node AND y.role = z.role""")
def r8(t):
    """Roles that blocks inherit, surely or only through a call."""
    e = _edges(t)
    seeds = e.where("kind = 'fulfills'").select(F.col("src").alias("node"), F.split("src", ":").getItem(0).alias("role")).distinct()
    return graph.certainty(e.where("kind <> 'calls'"), e.where("kind = 'calls'"), seeds, "role")


@query("r15_flows", "WITH RECURSIVE " + _E + """, r AS (SELECT node AS root, node FROM s UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node), f AS (SELECT root, regexp_extract(node, '^[a-z]*:?([a-z]+)', 1) AS feature, node FROM r)
 SELECT root, feature, count(*) AS nodes, array_to_string(list_sort(list(node))[1:3], ',') AS via FROM f WHERE feature <> '' GROUP BY 1, 2""")
def r15(t):
    """The features each start reaches, and through which blocks first."""
    e = _edges(t)
    node = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return graph.flows(e, _start(t), node.withColumn("feature", F.nullif(F.regexp_extract("node", "^[a-z]*:?([a-z]+)", 1), F.lit(""))))


@query("r17_walks", "WITH RECURSIVE " + _E + """, n AS (SELECT src, min(dst) AS dst FROM e WHERE kind <> 'fulfills' GROUP BY 1), w AS (SELECT node AS start, node AS last, [node] AS path FROM s UNION ALL SELECT w.start, n.dst, list_append(w.path, n.dst) FROM w JOIN n ON n.src = w.last WHERE NOT list_contains(w.path, n.dst))
 SELECT start, len(path) - 1 AS hops, last, CASE WHEN n.dst IS NULL THEN 'end' ELSE 'loop' END AS ended FROM (SELECT start, arg_max(path, len(path)) AS path, arg_max(last, len(path)) AS last FROM w GROUP BY 1) LEFT JOIN n ON n.src = last""")
def r17(t):
    """From each start the first step of each block, until none is left or one comes again."""
    return graph.walks(_edges(t, "next", "calls"), _start(t))


@query("r20_window", "WITH RECURSIVE e AS (SELECT DISTINCT trim(from_id) AS src, trim(to_id) AS dst FROM block_edges WHERE kind IN ('next', 'calls', 'fulfills') AND seen_at >= TIMESTAMP '2025-03-01' AND seen_at < TIMESTAMP '2025-10-01'), s AS (SELECT DISTINCT trim(from_id) AS node FROM block_edges WHERE kind = 'fulfills'), r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def r20(t):
    """What is reached along links that were seen within a window of time."""
    e = t("block_edges").where("kind IN ('next', 'calls', 'fulfills') AND seen_at >= '2025-03-01' AND seen_at < '2025-10-01'").select(F.trim("from_id").alias("src"), F.trim("to_id").alias("dst"))
    return graph.closure(e, _edges(t, "fulfills").select(F.col("src").alias("node"))).select("node")


@query("d7_requirement_diff", """WITH d AS (SELECT DISTINCT brd_id, criterion_id, recorded_at, row_id, statement, maps_to, tier FROM rtm_rows WHERE brd_id IS NOT NULL AND criterion_id IS NOT NULL AND recorded_at IS NOT NULL),
 l AS (SELECT *, lag({'statement': statement, 'maps_to': maps_to, 'tier': tier, 'row_id': row_id}) OVER (PARTITION BY brd_id, criterion_id ORDER BY recorded_at, row_id, statement, maps_to, tier) AS p FROM d)
 SELECT brd_id, criterion_id, p.row_id AS from_row, row_id AS to_row, p.statement IS DISTINCT FROM statement AS statement, p.maps_to IS DISTINCT FROM maps_to AS mapping, p.tier IS DISTINCT FROM tier AS tier FROM l WHERE p IS NOT NULL AND (p.statement IS DISTINCT FROM statement OR p.maps_to IS DISTINCT FROM maps_to OR p.tier IS DISTINCT FROM tier)""")
def d7(t):
    """What of a criterion changed from one record of it to the next."""
    fields = ["statement", "maps_to", "tier"]
    d = t("rtm_rows").where("brd_id IS NOT NULL AND criterion_id IS NOT NULL AND recorded_at IS NOT NULL").select("brd_id", "criterion_id", "recorded_at", "row_id", *fields).distinct()
    w = Window.partitionBy("brd_id", "criterion_id").orderBy("recorded_at", "row_id", *fields)
    rows = d.withColumn("p", F.lag(F.struct("row_id", *fields)).over(w)).where("p IS NOT NULL")
    moved = {n: ~F.col(c).eqNullSafe(F.col(f"p.{c}")) for n, c in (("statement", "statement"), ("mapping", "maps_to"), ("tier", "tier"))}
    out = rows.select("brd_id", "criterion_id", F.col("p.row_id").alias("from_row"), F.col("row_id").alias("to_row"), *(c.alias(n) for n, c in moved.items()))
    return out.where("statement OR mapping OR tier")


@query("a25_tree_edges", r"""WITH RECURSIVE t AS (SELECT regexp_replace(CASE kind WHEN 'contains' THEN from_id ELSE to_id END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS outer_id, regexp_replace(CASE kind WHEN 'contains' THEN to_id ELSE from_id END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS node, seen_at FROM block_edges WHERE kind IN ('contains', 'part_of')),
 g AS (SELECT node, arg_max(outer_id, (seen_at, outer_id)) AS outer_id FROM t GROUP BY 1), u AS (SELECT node, outer_id AS above FROM g UNION SELECT u.node, g.outer_id FROM u JOIN g ON g.node = u.above), n AS (SELECT node FROM t UNION SELECT outer_id FROM t),
 bad AS (SELECT DISTINCT u.node FROM u JOIN u l ON l.node = u.above AND l.node = l.above), a AS (SELECT node, above FROM u WHERE node NOT IN (SELECT node FROM bad)),
 e AS (SELECT DISTINCT trim(from_id) AS src, trim(to_id) AS dst, kind FROM block_edges WHERE kind IN ('next', 'calls', 'fulfills'))
 SELECT src, dst, kind FROM e WHERE src <> dst AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) AND NOT EXISTS (SELECT 1 FROM a WHERE a.node = e.src AND a.above = e.dst) AND NOT EXISTS (SELECT 1 FROM a WHERE a.node = e.dst AND a.above = e.src)""")
def a25(t):
    """Edges without those to themselves, to what is no block, and between a block and one it lies in."""
    links = hierarchy.edge_links(t("block_edges"))
    labels = cut(hierarchy.hierarchy(hierarchy._linked(links), intervals=True))
    place = labels.select(F.element_at(F.split("k", hierarchy.SEP), -1).alias("node"), "root", "tree_pre", "subtree", "depth")
    end = lambda c: place.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("root", "tree_pre", "subtree")))
    e = _edges(t).where("src <> dst").join(end("src"), "src").join(end("dst"), "dst")
    within = lambda a, b: (F.col(f"{a}_root") == F.col(f"{b}_root")) & (F.col(f"{a}_tree_pre") > F.col(f"{b}_tree_pre")) & (F.col(f"{a}_tree_pre") < F.col(f"{b}_tree_pre") + F.col(f"{b}_subtree"))
    return e.where(~F.coalesce(within("src", "dst"), F.lit(False)) & ~F.coalesce(within("dst", "src"), F.lit(False))).select("src", "dst", "kind")


@query("o4_first_five", "SELECT source, array_to_string(list_sort(list(id))[1:5], ',') AS head, count(*) AS n, greatest(count(*) - 5, 0) AS truncated FROM (SELECT DISTINCT source, id FROM catalogue_nodes WHERE id IS NOT NULL) GROUP BY 1")
def o4(t):
    return aggregates.first_of(t("catalogue_nodes"), ["source"], "id", 5, "head")


@query("w5_from_to", """WITH p AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
 SELECT user_id, arg_max(was, (ts, event_id)) AS from_type, arg_max(event_type, (ts, event_id)) AS to_type, count(*) AS moves FROM p WHERE was IS NOT NULL AND was <> event_type GROUP BY 1""")
def w5(t):
    """The last move of each user from one kind of event to another, and how many there were."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = t("events").withColumn("was", was).where("was <> event_type")
    last = F.max(F.struct("ts", "event_id", "was", "event_type")).alias("m")
    return moves.groupBy("user_id").agg(last, F.count(F.lit(1)).alias("moves")).select("user_id", F.col("m.was").alias("from_type"), F.col("m.event_type").alias("to_type"), "moves")


@query("a28_single_actor", "SELECT o_custkey FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1 AND bool_or(o_orderstatus = 'F')")
def a28(t):
    """Units all of whose moves one actor made, a decisive one among them: customers, priorities and statuses stand for units, actors and moves."""
    g = t("orders").where("trim(o_orderpriority) <> ''").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("m"))
    return g.where("n = 1 AND m").select("o_custkey")


@query("a18_four_ratios", "SELECT lang, " + ", ".join(f"floor(count(*) FILTER ({c})::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS {n}" for n, c in (("attributed", "feature IS NOT NULL"), ("measured", "end_line IS NOT NULL"), ("living", "deleted_at IS NULL"), ("tests", "is_test"))) + " FROM symbols GROUP BY 1")
def a18(t):
    s = t("symbols")
    share = lambda c: numbers.ratio(F.count_if(c), F.count(F.lit(1)))
    return s.groupBy("lang").agg(share(F.col("feature").isNotNull()).alias("attributed"), share(F.col("end_line").isNotNull()).alias("measured"), share(F.col("deleted_at").isNull()).alias("living"), share(F.col("is_test")).alias("tests"))


@query("a11_leaf_floors", """WITH s AS (SELECT DISTINCT file, fqn, feature, line, coalesce(end_line, line) AS hi, end_line IS NOT NULL AS known FROM symbols WHERE feature IS NOT NULL AND NOT is_test AND file IS NOT NULL AND line IS NOT NULL),
 leaf AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s i WHERE i.file = s.file AND i.line >= s.line AND i.hi <= s.hi AND (i.line > s.line OR i.hi < s.hi)))
 SELECT feature, count(*) AS n, floor(100.0 * count(*) FILTER (known) / count(*) * 10 + 0.5) / 10 AS pct FROM leaf GROUP BY 1 HAVING 100.0 * count(*) FILTER (known) / count(*) < 90""")
def a11(t):
    """Features whose leaf symbols, those that enclose no other, fall below a floor."""
    s = t("symbols").where("feature IS NOT NULL AND NOT is_test AND file IS NOT NULL AND line IS NOT NULL").select("file", "fqn", "feature", "line", F.coalesce("end_line", "line").alias("hi"), F.col("end_line").isNotNull().alias("known")).distinct()
    span = s.select("file", F.col("line").alias("lo2"), F.col("hi").alias("hi2")).distinct()
    outer = joins.overlap_join(s.select("file", "line", "hi").distinct(), span, ["file"], "line", "hi", "lo2", "hi2").where("lo2 >= line AND hi2 <= hi AND (lo2 > line OR hi2 < hi)").select("file", "line", "hi").distinct()
    g = s.join(outer, ["file", "line", "hi"], "left_anti").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("k"))
    pct = F.lit(100.0) * F.col("k") / F.col("n")
    return g.where(pct < 90).select("feature", "n", numbers.round_half(pct, 1).alias("pct"))


@query("j18_moved_text", """WITH p AS (SELECT feature || ':' || inv AS promise, max(statement) AS statement, bool_or(deleted_at IS NULL) AS lives FROM invariants WHERE feature IS NOT NULL AND inv IS NOT NULL GROUP BY 1),
 w AS (SELECT statement, count(*) AS k, min(promise) AS now FROM p WHERE lives AND statement IS NOT NULL GROUP BY 1)
 SELECT promise, CASE WHEN k = 1 THEN 'moved' WHEN k > 1 THEN 'ambiguous' ELSE 'removed' END AS reason, CASE WHEN k = 1 THEN now END AS now FROM p LEFT JOIN w USING (statement) WHERE NOT lives""")
def j18(t):
    """Promises that went: moved if exactly one living promise has their text."""
    p = t("invariants").where("feature IS NOT NULL AND inv IS NOT NULL").groupBy(F.concat("feature", F.lit(":"), "inv").alias("promise")).agg(F.max("statement").alias("statement"), F.bool_or(F.col("deleted_at").isNull()).alias("lives"))
    w = p.where("lives AND statement IS NOT NULL").groupBy("statement").agg(F.count(F.lit(1)).alias("k"), F.min("promise").alias("now"))
    k = F.col("k")
    return p.where("NOT lives").join(w, "statement", "left").select("promise", F.when(k == 1, "moved").when(k > 1, "ambiguous").otherwise("removed").alias("reason"), F.when(k == 1, F.col("now")).alias("now"))


@query("q12_references", _MATRIX + """, c AS (SELECT fqn, bool_or(is_test) AS test, bool_or(NOT is_test) AS code FROM symbols GROUP BY 1), n AS (SELECT DISTINCT source, trim(id) AS id, trim(parent) AS parent FROM catalogue_nodes WHERE trim(id) <> '')
 SELECT DISTINCT 'UNKNOWN_PROMISE' AS code, promise AS subject FROM p WHERE promise NOT IN (SELECT promise FROM i)
 UNION SELECT 'PROMISE_WITHOUT_ENFORCER', promise FROM i WHERE promise NOT IN (SELECT promise FROM pe) UNION SELECT 'PROMISE_WITHOUT_VERIFIER', promise FROM i WHERE promise NOT IN (SELECT promise FROM pv)
 UNION SELECT 'ENFORCER_IS_TEST', x FROM e JOIN c ON c.fqn = x WHERE test AND NOT code UNION SELECT 'VERIFIER_IS_CODE', x FROM v JOIN c ON c.fqn = x WHERE code AND NOT test
 UNION SELECT 'UNKNOWN_SYMBOL', x FROM (SELECT x FROM e UNION SELECT x FROM v) WHERE x <> '' AND x NOT IN (SELECT fqn FROM c)
 UNION SELECT 'FEATURE_WITHOUT_MANIFEST', feature FROM invariants WHERE feature IS NOT NULL AND feature NOT IN (SELECT feature_id FROM features WHERE feature_id IS NOT NULL)
 UNION SELECT 'PARENT_MISSING', source || '/' || id FROM n WHERE parent <> '' AND NOT EXISTS (SELECT 1 FROM n o WHERE o.source = n.source AND o.id = n.parent) UNION SELECT 'OWN_PARENT', source || '/' || id FROM n WHERE id = parent""")
def q12(t):
    """Findings of nine rules on references, each once: what is referred to is not there or of the wrong kind."""
    refs = rtm_references(t("rtm_rows")).select("field", "ref_key").distinct()
    of = lambda *fields: refs.where(F.col("field").isin(*fields)).select(F.col("ref_key").alias("subject")).distinct()
    _, pe, pv = _matrix(t)
    have = _promises(t).select(F.col("promise").alias("subject"))
    named = lambda df: df.select(F.col("promise").alias("subject"))
    c = t("symbols").groupBy(F.col("fqn").alias("subject")).agg(F.bool_or("is_test").alias("test"), F.bool_or(~F.col("is_test")).alias("code"))
    n = t("catalogue_nodes").select("source", F.trim("id").alias("id"), F.trim("parent").alias("parent")).where("id <> ''").distinct()
    there = n.select("source", F.col("id").alias("parent")).distinct()
    node = F.concat("source", F.lit("/"), "id").alias("subject")
    found = {
        "UNKNOWN_PROMISE": of("maps_to", "invariant_id").join(have, "subject", "left_anti"),
        "PROMISE_WITHOUT_ENFORCER": have.join(named(pe), "subject", "left_anti"),
        "PROMISE_WITHOUT_VERIFIER": have.join(named(pv), "subject", "left_anti"),
        "ENFORCER_IS_TEST": of("enforcers").join(c.where("test AND NOT code"), "subject", "left_semi"),
        "VERIFIER_IS_CODE": of("verifiers").join(c.where("code AND NOT test"), "subject", "left_semi"),
        "UNKNOWN_SYMBOL": of("enforcers", "verifiers").join(c, "subject", "left_anti"),
        "FEATURE_WITHOUT_MANIFEST": t("invariants").where("feature IS NOT NULL").select(F.col("feature").alias("subject")).join(t("features").select(F.col("feature_id").alias("subject")), "subject", "left_anti"),
        "PARENT_MISSING": n.where("parent <> ''").join(there, ["source", "parent"], "left_anti").select(node),
        "OWN_PARENT": n.where("id = parent").select(node),
    }
    out = None
    for code, rows in found.items():
        rows = rows.where("subject IS NOT NULL").select(F.lit(code).alias("code"), "subject")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


@query("q12_dependencies")
def q12_dependencies(t):
    """Dependencies of manifests that do not exist, and features that depend on themselves in a circle."""
    own = t("features").where("feature_id IS NOT NULL").select("manifest_id", F.col("feature_id").alias("src")).distinct()
    e = nested.manifest_table(t("features"), "depends_on").join(own, "manifest_id").select("src", F.trim("text").alias("dst")).where("dst <> ''").distinct()
    missing = e.join(own.select(F.col("src").alias("dst")), "dst", "left_anti").select(F.lit("DEPENDS_ON_MISSING").alias("code"), F.concat("src", F.lit(" > "), "dst").alias("subject"))
    return missing.unionByName(graph.cyclic(e).select(F.lit("DEPENDS_ON_CYCLE").alias("code"), F.col("node").alias("subject")))
