"""Join operators bound to the bundled tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import aggregates, joins, sets
from weftline.operators.orphans import rtm_references
from weftline.plans.registry import query

_REFS = r"""WITH raw AS (SELECT DISTINCT row_id, feature_id, trim(invariant_id) AS inv, unnest(enforcers) AS e FROM rtm_rows WHERE trim(invariant_id) <> ''),
 c AS (SELECT DISTINCT feature_id, inv, regexp_replace(trim(e), '\(\)$', '') AS e FROM raw WHERE trim(e) <> '')"""


@query("j1_traceability", _REFS + r""", g AS (SELECT feature_id, inv, string_agg(e, ',' ORDER BY e) AS enforcers, count(*) AS n_enforcers FROM c GROUP BY 1, 2)
 SELECT i.feature, i.inv, coalesce(g.enforcers, '') AS enforcers, coalesce(g.n_enforcers, 0) AS n_enforcers FROM (SELECT DISTINCT feature, inv FROM invariants) i LEFT JOIN g ON g.feature_id = i.feature AND g.inv = i.inv""")
def j1(t):
    """Invariants with the enforcers that the matrix names for them."""
    r = t("rtm_rows").select("feature_id", F.trim("invariant_id").alias("inv"), F.explode("enforcers").alias("e")).where("inv <> '' AND trim(e) <> ''")
    links = r.select(F.col("feature_id").alias("feature"), "inv", F.regexp_replace(F.trim("e"), r"\(\)$", "").alias("e"))
    got = joins.grouped_refs(links, ["feature", "inv"], "e", "enforcers")
    return t("invariants").select("feature", "inv").distinct().join(got, ["feature", "inv"], "left").select("feature", "inv", F.coalesce("enforcers", F.lit("")).alias("enforcers"), F.coalesce("n_enforcers", F.lit(0)).alias("n_enforcers"))


@query("j5_declared_implemented", "SELECT coalesce(a.k, b.k) AS feature, a.k IS NOT NULL AS declared, b.k IS NOT NULL AS implemented FROM (SELECT DISTINCT feature_id AS k FROM features WHERE feature_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT feature AS k FROM symbols WHERE feature IS NOT NULL) b ON a.k = b.k")
def j5(t):
    a = t("features").where("feature_id IS NOT NULL").select(F.col("feature_id").alias("feature"))
    return joins.flags_outer(a, t("symbols").where("feature IS NOT NULL"), ["feature"], "declared", "implemented")


@query("j6_suffix_path", r"""WITH f AS (SELECT DISTINCT file FROM symbols WHERE file IS NOT NULL), r AS (SELECT DISTINCT regexp_replace(file, '^([^/]+/){3}', '') AS report FROM f),
 m AS (SELECT report, file, CASE WHEN report = file OR ends_with(file, '/' || report) THEN len(report) ELSE len(file) END AS n FROM r JOIN f ON report = file OR ends_with(file, '/' || report) OR ends_with(report, '/' || file)),
 b AS (SELECT report, max(n) AS n FROM m GROUP BY 1)
 SELECT report, CASE WHEN count(DISTINCT file) = 1 THEN min(file) END AS file, count(DISTINCT file) AS matches FROM m JOIN b USING (report, n) GROUP BY 1""")
def j6(t):
    f = t("symbols").where("file IS NOT NULL").select("file").distinct()
    return joins.suffix_join(f.select(F.regexp_replace("file", "^([^/]+/){3}", "").alias("report")), f, "report", "file")


@query("j7_interval", """WITH s AS (SELECT user_id, event_id AS span, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM events WHERE event_type = 'signup')
 SELECT e.event_id, s.span FROM events e JOIN s ON e.user_id = s.user_id AND e.ts > s.lo AND e.ts <= s.hi""")
def j7(t):
    """Events within the span from one signup to the next; a signup without a next one opens no span."""
    e = t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span"), F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"))
    return joins.interval_join(e.select("event_id", "user_id", "at"), s, ["user_id"], "at", "lo", "hi", 86_400e6).select("event_id", "span")


@query("j8_innermost", """WITH s AS (SELECT DISTINCT file, fqn, line, end_line FROM symbols WHERE end_line > line), p AS (SELECT DISTINCT file, line AS at_line FROM symbols WHERE line IS NOT NULL)
 SELECT file, at_line, fqn FROM p JOIN s USING (file) WHERE at_line > s.line AND at_line <= s.end_line QUALIFY row_number() OVER (PARTITION BY file, at_line ORDER BY s.end_line - s.line, fqn) = 1""")
def j8(t):
    """The innermost symbol around each symbol's first line."""
    s = t("symbols").select("file", "fqn", F.col("line").alias("lo"), F.col("end_line").alias("hi")).distinct()
    p = t("symbols").select("file", F.col("line").alias("at_line")).distinct()
    return joins.innermost(joins.interval_join(p, s, ["file"], "at_line", "lo", "hi", 64.0), ["file", "at_line"], "lo", "hi", "fqn")


@query("j9_tail_match")
def j9(t):
    """Verifiers of the matrix and the tests they mean, by their longest common tail."""
    r = t("rtm_rows").select(F.explode("verifiers").alias("v")).select(F.regexp_replace(F.trim("v"), r"\(\)$", "").alias("ref"))
    return joins.tail_match(r, t("symbols").where("is_test"), "ref", "fqn")


@query("j12_routes", r"""WITH n AS (SELECT DISTINCT kind, http_method, http_path, array_to_string(list_transform(list_filter(string_split(http_path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(:.+|\{.*\}|\[.*\])$') THEN '{}' ELSE s END), '/') AS k FROM catalogue_nodes WHERE http_path IS NOT NULL),
 c AS (SELECT DISTINCT http_method AS method, http_path AS path, k FROM n), r AS (SELECT http_method, http_path, k FROM n WHERE kind = 'route'),
 j AS (SELECT c.method, c.path, count(DISTINCT r.k) AS routes, min(r.http_path) AS route FROM c LEFT JOIN r ON r.k = c.k AND (r.http_method = c.method OR r.http_method IS NULL OR c.method IS NULL) GROUP BY 1, 2)
 SELECT method, path, routes, CASE WHEN routes = 1 THEN route END AS route, CASE routes WHEN 0 THEN 'no_route' WHEN 1 THEN 'edge' ELSE 'ambiguous' END AS outcome FROM j""")
def j12(t):
    n = t("catalogue_nodes").where("http_path IS NOT NULL").select("kind", F.col("http_method").alias("method"), F.col("http_path").alias("path"))
    return joins.route_join(n, n.where("kind = 'route'"))


@query("j13_channels", "SELECT coalesce(a.c, b.c) AS channel, coalesce(a.n, 0) AS publishers, coalesce(b.n, 0) AS consumers, CASE WHEN a.c IS NULL THEN 'no_publisher' WHEN b.c IS NULL THEN 'no_consumer' ELSE 'joined' END AS state FROM (SELECT to_id AS c, count(*) AS n FROM block_edges WHERE kind = 'calls' GROUP BY 1) a FULL JOIN (SELECT to_id AS c, count(*) AS n FROM block_edges WHERE kind = 'fulfills' GROUP BY 1) b ON a.c = b.c")
def j13(t):
    e = t("block_edges").withColumnRenamed("to_id", "channel")
    return joins.channel_ends(e.where("kind = 'calls'"), e.where("kind = 'fulfills'"), "channel")


@query("j14_cascade", r"""WITH r AS (SELECT DISTINCT regexp_replace(trim(unnest(enforcers)), '\(\)$', '') AS ref FROM rtm_rows),
 a AS (SELECT fqn AS ref, min(file) AS t, count(DISTINCT file) AS n FROM symbols GROUP BY 1), b AS (SELECT name AS ref, min(file) AS t, count(DISTINCT file) AS n FROM symbols GROUP BY 1)
 SELECT r.ref, CASE WHEN a.n IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.t END WHEN b.n = 1 THEN b.t END AS target, CASE WHEN a.n IS NOT NULL THEN 'fqn' WHEN b.n IS NOT NULL THEN 'name' ELSE 'missing' END AS basis, coalesce(a.n, b.n, 0) AS candidates
 FROM r LEFT JOIN a USING (ref) LEFT JOIN b ON b.ref = r.ref WHERE r.ref IS NOT NULL""")
def j14(t):
    r = t("rtm_rows").select(F.explode("enforcers").alias("r")).where("r IS NOT NULL").select(F.regexp_replace(F.trim("r"), r"\(\)$", "").alias("ref"))
    s = t("symbols")
    return joins.first_resolved(r, "ref", [("fqn", s, "fqn", "file"), ("name", s, "name", "file")])


@query("j16_unique_source", """WITH l AS (SELECT DISTINCT unnest(next_ids) AS id FROM catalogue_nodes), p AS (SELECT id, count(DISTINCT source) AS n, min(source) AS s FROM catalogue_nodes GROUP BY 1)
 SELECT l.id, coalesce(p.n, 0) AS sources, CASE WHEN p.n = 1 THEN p.s END AS source, CASE coalesce(p.n, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS state FROM l LEFT JOIN p USING (id)""")
def j16(t):
    n = t("catalogue_nodes")
    return joins.unique_source(n.select(F.explode("next_ids").alias("id")).where("id IS NOT NULL").distinct(), n, "id", "source").select("id", "sources", F.col("only").alias("source"), "state")


@query("j19_overlap", """WITH s AS (SELECT DISTINCT file, line AS lo, coalesce(end_line, line) AS hi, fqn FROM symbols WHERE line IS NOT NULL)
 SELECT a.file, a.fqn AS a, b.fqn AS b, a.lo AS lo FROM s a JOIN s b ON a.file = b.file AND a.lo <= b.hi AND b.lo <= a.hi AND (a.lo, a.hi, a.fqn) < (b.lo, b.hi, b.fqn)""")
def j19(t):
    """Symbols of one file whose lines overlap, each pair once."""
    s = t("symbols").where("line IS NOT NULL").select("file", F.col("line").alias("lo"), F.coalesce("end_line", "line").alias("hi"), "fqn").distinct()
    o = joins.overlap_join(s, s.select("file", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("fqn").alias("b")), ["file"], "lo", "hi", "lo2", "hi2")
    return o.where(F.struct("lo", "hi", "fqn") < F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("b").alias("fqn"))).select("file", F.col("fqn").alias("a"), "b", "lo")


@query("j21_without_manifest", "SELECT DISTINCT feature FROM invariants WHERE NOT EXISTS (SELECT 1 FROM features WHERE feature_id = feature)")
def j21(t):
    """Features with promises but no manifest."""
    return t("invariants").select("feature").distinct().join(t("features").select(F.col("feature_id").alias("feature")), "feature", "left_anti")


@query("j22_disappeared", """WITH s AS (SELECT min(snapshot_no) AS a, max(snapshot_no) AS b FROM audit_rows)
 SELECT DISTINCT feature, invariant FROM audit_rows, s WHERE snapshot_no = s.a AND feature IS NOT NULL AND invariant IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM audit_rows x WHERE x.snapshot_no = s.b AND x.feature = audit_rows.feature AND x.invariant = audit_rows.invariant)
 AND NOT EXISTS (SELECT 1 FROM invariants i WHERE i.feature = audit_rows.feature AND i.inv = audit_rows.invariant AND i.deleted_at IS NOT NULL)""")
def j22(t):
    """In the first snapshot, not in the last, and no deletion explains it."""
    a = t("audit_rows").select("snapshot_no", "feature", "invariant")
    ends = F.broadcast(a.agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi")))  # one row
    rows = a.join(ends)
    gone = t("invariants").where("deleted_at IS NOT NULL").select("feature", F.col("inv").alias("invariant"))
    first = rows.where("snapshot_no = lo AND feature IS NOT NULL AND invariant IS NOT NULL").select("feature", "invariant").distinct()
    return first.join(rows.where("snapshot_no = hi").select("feature", "invariant"), ["feature", "invariant"], "left_anti").join(gone, ["feature", "invariant"], "left_anti")


@query("j23_one_sided", """WITH a AS (SELECT DISTINCT trim(from_id) AS p, trim(to_id) AS c FROM block_edges WHERE kind = 'contains'), b AS (SELECT DISTINCT trim(to_id) AS p, trim(from_id) AS c FROM block_edges WHERE kind = 'part_of')
 SELECT coalesce(a.p, b.p) AS p, coalesce(a.c, b.c) AS c, CASE WHEN b.p IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.p = b.p AND a.c = b.c WHERE a.p IS NULL OR b.p IS NULL""")
def j23(t):
    """Nesting told by the outer or the inner block only."""
    e = t("block_edges")
    a = e.where("kind = 'contains'").select(F.trim("from_id").alias("p"), F.trim("to_id").alias("c"))
    return sets.one_sided(a, e.where("kind = 'part_of'").select(F.trim("to_id").alias("p"), F.trim("from_id").alias("c")), ["p", "c"])


@query("j24_prefix_overlap", """WITH s AS (SELECT DISTINCT feature AS owner, regexp_replace(file, '/[^/]*$', '') AS path FROM symbols WHERE feature IS NOT NULL AND file IS NOT NULL UNION SELECT DISTINCT 'area:' || regexp_extract(file, '^[^/]+/([^/]+)/', 1), regexp_extract(file, '^([^/]+/[^/]+)/', 1) FROM symbols),
 k AS (SELECT path, count(*) AS owners FROM s GROUP BY 1)
 SELECT k.path, k.owners, count(*) AS under FROM s JOIN k ON s.path = k.path OR starts_with(s.path, k.path || '/') WHERE EXISTS (SELECT 1 FROM s z WHERE z.path = k.path AND z.owner <> s.owner) AND k.path <> '' GROUP BY 1, 2""")
def j24(t):
    s = t("symbols")
    own = s.where("feature IS NOT NULL AND file IS NOT NULL").select(F.col("feature").alias("owner"), F.regexp_replace("file", "/[^/]*$", "").alias("path"))
    area = s.select(F.concat(F.lit("area:"), F.regexp_extract("file", "^[^/]+/([^/]+)/", 1)).alias("owner"), F.regexp_extract("file", "^([^/]+/[^/]+)/", 1).alias("path"))
    return joins.prefix_overlaps(own.unionByName(area), "owner", "path").select("path", "owners", "under")


@query("j28_fallback", """WITH o AS (SELECT l_orderkey, max(l_shipdate) AS v FROM lineitem GROUP BY 1), w AS (SELECT o_custkey, max(o_orderdate) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
 SELECT CASE WHEN o.v IS NOT NULL THEN 'own' WHEN w.v IS NOT NULL THEN 'group' ELSE 'none' END AS basis, count(*) AS n, max(coalesce(o.v, w.v)) AS latest FROM orders r LEFT JOIN o ON o.l_orderkey = r.o_orderkey LEFT JOIN w ON w.o_custkey = r.o_custkey GROUP BY 1""")
def j28(t):
    own = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("v"))
    wide = t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("v"))
    return joins.fallback_join(t("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], own, wide, ["o_custkey"], "v").groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("latest"))


@query("j32_neighbour_tests", r"""WITH f AS (SELECT DISTINCT file, regexp_replace(regexp_replace(regexp_replace(file, '^(src|tests)/', ''), '/[^/]*$', ''), '/__tests__$', '') AS dir, regexp_replace(regexp_replace(regexp_replace(file, '^.*/', ''), '\.[a-z]+$', ''), '^test_', '') AS stem, starts_with(file, 'tests/') OR contains(file, '/__tests__/') AS test FROM symbols)
 SELECT a.file, b.file AS test_file FROM f a JOIN f b ON a.dir = b.dir AND a.stem = b.stem WHERE NOT a.test AND b.test""")
def j32(t):
    """Test files of the same stem, in the same folder or its `__tests__`."""
    f = t("symbols").select("file").distinct().select("file", F.regexp_replace(F.regexp_replace(F.regexp_replace("file", "^(src|tests)/", ""), "/[^/]*$", ""), "/__tests__$", "").alias("dir"), F.regexp_replace(F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[a-z]+$", ""), "^test_", "").alias("stem"), (F.col("file").startswith("tests/") | F.contains("file", F.lit("/__tests__/"))).alias("test"))
    return f.where("NOT test").join(f.where("test").select("dir", "stem", F.col("file").alias("test_file")), ["dir", "stem"]).select("file", "test_file")


@query("j33_token_match", r"""WITH i AS (SELECT DISTINCT name AS item, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS tk FROM symbols WHERE NOT is_test),
 g AS (SELECT DISTINCT title AS target, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> ''))) AS t FROM catalogue_nodes WHERE title IS NOT NULL),
 d AS (SELECT t, count(*) AS df FROM g GROUP BY 1), e AS (SELECT item, len(tk) AS n, unnest(tk) AS t FROM i),
 s AS (SELECT item, target, sum(1.0 / df) / max(n) AS score FROM e JOIN d USING (t) JOIN g USING (t) GROUP BY 1, 2)
 SELECT item, target, floor(score * 10000 + 0.5) / 10000 AS score FROM s WHERE score >= 0.01 - 1e-9 QUALIFY row_number() OVER (PARTITION BY item ORDER BY floor(score * 1e9 + 0.5) DESC, target) = 1""")
def j33(t):
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    i = t("symbols").where("NOT is_test").select("name").distinct().select("name", tokens("name").alias("tk"))
    g = t("catalogue_nodes").where("title IS NOT NULL").select("title").distinct().select("title", tokens("title").alias("tt"))
    return joins.token_match(i, g, "name", "tk", "title", "tt", 0.01)


@query("j35_preceding", "SELECT e.event_id, (SELECT max(s.ts) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts) AS signed_up FROM events e")
def j35(t):
    """The last signup at or before each event."""
    e = t("events").select("event_id", "user_id", "ts")
    s = t("events").where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("v"))
    return joins.asof_backward(e, s, ["user_id"], "ts", "v", "signed_up").select("event_id", "signed_up")


@query("a22_cochange", """WITH o AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS i FROM lineitem), n AS (SELECT c, count(*) AS n FROM o GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
 SELECT x.i AS a, y.i AS b, count(*) AS shared, floor(sum(1.0 / n.n) * 10000 + 0.5) / 10000 AS score FROM o x JOIN o y ON x.c = y.c AND x.i < y.i JOIN n ON n.c = x.c GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(1.0 / n.n) >= 0.25 - 1e-9""")
def a22(t):
    p = aggregates.cochange(t("lineitem"), "l_orderkey", "l_partkey")
    return p.select("a", "b", "shared", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


@query("d6_similar_suites", r"""WITH m AS (SELECT DISTINCT feature_id AS o, regexp_replace(trim(unnest(enforcers)), '\(\)$', '') AS m FROM rtm_rows), s AS (SELECT o, list_sort(list(m)) AS s FROM m WHERE m IS NOT NULL AND o IS NOT NULL GROUP BY 1),
 c AS (SELECT min(o) AS o, s FROM s GROUP BY s), f AS (SELECT o, len(s) AS n, unnest(s) AS m FROM c)
 SELECT x.o AS a, y.o AS b, count(*) AS shared, floor(count(*)::DOUBLE / (max(x.n) + max(y.n) - count(*)) * 10000 + 0.5) / 10000 AS similarity FROM f x JOIN f y ON x.m = y.m AND x.o < y.o GROUP BY 1, 2 HAVING count(*)::DOUBLE / (max(x.n) + max(y.n) - count(*)) >= 0.1 - 1e-9""")
def d6(t):
    """Features whose sets of enforcers are alike. The threshold is low, for few are."""
    m = t("rtm_rows").select("feature_id", F.explode("enforcers").alias("m")).select("feature_id", F.regexp_replace(F.trim("m"), r"\(\)$", "").alias("m"))
    return sets.similar_sets(m, "feature_id", "m", 0.1)


@query("d6_suite_classes", r"""WITH m AS (SELECT DISTINCT feature_id AS o, regexp_replace(trim(unnest(enforcers)), '\(\)$', '') AS m FROM rtm_rows), s AS (SELECT o, list_sort(list(m)) AS s FROM m WHERE m IS NOT NULL AND o IS NOT NULL GROUP BY 1)
 SELECT o AS owner, min(o) OVER (PARTITION BY s) AS class, len(s) AS size, count(*) OVER (PARTITION BY s) AS owners FROM s""")
def d6_classes(t):
    """The class of each feature: those whose sets of enforcers are equal, and so similar by 1."""
    m = t("rtm_rows").select("feature_id", F.explode("enforcers").alias("m")).select("feature_id", F.regexp_replace(F.trim("m"), r"\(\)$", "").alias("m"))
    c = sets.set_classes(m, "feature_id", "m")
    n = c.groupBy("class").agg(F.count(F.lit(1)).alias("owners"))
    return c.join(n, "class").select("owner", "class", F.size("set").cast("long").alias("size"), "owners")


@query("j31_promise_tiers", r"""WITH r AS (SELECT tier, trim(unnest(string_split(maps_to, ','))) AS r, feature_id FROM rtm_rows), c AS (SELECT tier, regexp_replace(r, '#.*$', '') AS r, feature_id FROM r)
 SELECT CASE WHEN position(':' IN r) > 1 THEN r ELSE feature_id || ':' || r END AS promise, max(tier) AS tier, count(*) AS n FROM c WHERE r <> '' GROUP BY 1""")
def j31(t):
    r = t("rtm_rows").select("tier", "feature_id", F.explode(F.split("maps_to", ",")).alias("r")).select("tier", "feature_id", refs.base(F.trim("r")).alias("r")).where("r <> ''")
    p = F.when(F.instr("r", ":") > 1, F.col("r")).otherwise(F.concat("feature_id", F.lit(":"), "r"))
    return r.groupBy(p.alias("promise")).agg(F.max("tier").alias("tier"), F.count(F.lit(1)).alias("n"))


@query("g2_reference_counts")
def g2(t):
    """References per field and target as the matrix tells them."""
    return rtm_references(t("rtm_rows")).groupBy("field", "target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ref_key").alias("keys"))


@query("a33_area_titles", "SELECT area, count(DISTINCT title) AS titles, count(*) AS n FROM catalogue_nodes GROUP BY 1")
def a33(t):
    return t("catalogue_nodes").groupBy("area").agg(F.countDistinct("title").alias("titles"), F.count(F.lit(1)).alias("n"))
