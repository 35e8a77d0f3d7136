"""Aggregates, windows, orders and set operations bound to the bundled tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import numbers, text
from weftline.operators import aggregates, manifests, sets
from weftline.plans.registry import query

STATUS = ("phantom", "unenforced", "failing", "unverified", "unmapped", "partial", "verified", "demonstrated", "exercised")
CLASSES = ("fake", "unenforced", "unverified", "not_demonstrated", "unknown", "demonstrated_only", "exercised", "break_tested")
OUTCOMES = ("fail", "skip", "pass")
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUS)
_CASE = lambda c, order: "CASE " + c + " " + " ".join(f"WHEN '{v}' THEN {n}" for n, v in enumerate(order)) + " END"
_PLAIN_CLASS = r"regexp_replace(lower(trim(class)), '[- ]', '_', 'g')"


def _plain_class(c):
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


@query("a1_status_counts", f"SELECT brd_id, count(*) AS total, {_COUNTS}, CASE WHEN count(*) = 0 THEN 0.0 ELSE floor((count(*) FILTER (status IN ('verified', 'demonstrated')))::DOUBLE / count(*) * 10000 + 0.5) / 10000 END AS rate FROM (SELECT DISTINCT row_id, brd_id, status FROM rtm_rows) GROUP BY 1")
def a1(t):
    return aggregates.status_summary(t("rtm_rows").select("row_id", "brd_id", "status").distinct(), ["brd_id"], "status", ("verified", "demonstrated"), STATUS)


@query("a2_total_ratio", "SELECT count(*) AS total, floor((count(*) FILTER (status IN ('verified', 'demonstrated')))::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS rate FROM (SELECT DISTINCT row_id, status FROM rtm_rows)")
def a2(t):
    d = t("rtm_rows").select("row_id", "status").distinct()
    good = F.sum(F.when(F.col("status").isin("verified", "demonstrated"), 1).otherwise(0))
    return d.agg(F.count(F.lit(1)).alias("total"), numbers.ratio(good, F.count(F.lit(1))).alias("rate"))


@query("a3_filled_classes", f"SELECT f.feature, c.class, count(a.class) AS n FROM (SELECT DISTINCT feature FROM audit_rows) f CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in CLASSES)}) c(class) LEFT JOIN (SELECT feature, {_PLAIN_CLASS} AS class FROM audit_rows) a ON a.class = c.class AND a.feature IS NOT DISTINCT FROM f.feature GROUP BY 1, 2")
def a3(t):
    return aggregates.filled_counts(t("audit_rows").select("feature", _plain_class("class").alias("class")), "class", CLASSES, ["feature"])


@query("a4_worst_status", f"SELECT brd_id, (array[{', '.join(f"'{s}'" for s in STATUS)}])[min({_CASE('status', STATUS)}) + 1] AS status FROM rtm_rows GROUP BY 1")
def a4(t):
    return aggregates.worst_of(t("rtm_rows"), ["brd_id"], "status", STATUS)


@query("a6_result_fold", "SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failing' WHEN bool_and(l_returnflag = 'A') THEN 'demonstrated' ELSE 'undecided' END AS result FROM lineitem GROUP BY 1")
def a6(t):
    return t("lineitem").groupBy("l_partkey").agg(aggregates.result_fold(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("result"))


@query("a7_worst_outcome", "SELECT l_orderkey, l_linenumber, (array['fail', 'skip', 'pass'])[min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) + 1] AS outcome FROM lineitem GROUP BY 1, 2")
def a7(t):
    o = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "N", "skip").otherwise("pass")
    return aggregates.worst_of(t("lineitem").select("l_orderkey", "l_linenumber", o.alias("outcome")), ["l_orderkey", "l_linenumber"], "outcome", OUTCOMES)


@query("a8_merged_hits", "SELECT l_partkey, l_linenumber, count(*) AS reports, floor(sum(l_quantity) * 100 + 0.5) / 100 AS hits FROM lineitem GROUP BY 1, 2")
def a8(t):
    return t("lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("reports"), numbers.round_half(F.sum("l_quantity"), 2).alias("hits"))


@query("a9_effective", "SELECT feature, inv, arg_max(statement, (created_at, loaded_at, statement)) AS statement, max(created_at) AS created_at FROM invariants GROUP BY 1, 2")
def a9(t):
    """The definition in force: the last statement of each promise."""
    last = aggregates.latest(t("invariants"), ["feature", "inv"], ["created_at", "loaded_at", "statement"], ["statement", "created_at"])
    return last.select("feature", "inv", "statement", "created_at")


@query("a10_all_or_suite", "SELECT o_custkey, CASE WHEN bool_and(n IS NOT NULL) THEN sum(n) ELSE (SELECT count(*) FROM lineitem) END::BIGINT AS evidence_lines, CASE WHEN bool_and(n IS NOT NULL) THEN 'verifiers' ELSE 'suite' END AS over_what FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1")
def a10(t):
    """Lines of a customer's orders if every order has some, else those of the whole suite."""
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    suite = t("lineitem").agg(F.count(F.lit(1)).alias("suite"))  # one row
    per = t("orders").join(n, "o_orderkey", "left").groupBy("o_custkey").agg(F.bool_and(F.col("n").isNotNull()).alias("all"), F.sum("n").alias("n"))
    return per.join(F.broadcast(suite)).select("o_custkey", F.when(F.col("all"), F.col("n")).otherwise(F.col("suite")).alias("evidence_lines"), F.when(F.col("all"), "verifiers").otherwise("suite").alias("over_what"))


@query("a11_floors", "SELECT feature, count(*) AS n, floor(100.0 * count(end_line) / count(*) * 10 + 0.5) / 10 AS pct FROM symbols WHERE feature IS NOT NULL AND NOT is_test GROUP BY 1 HAVING 100.0 * count(end_line) / count(*) < 90")
def a11(t):
    g = t("symbols").where("feature IS NOT NULL AND NOT is_test").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("end_line").alias("k"))
    return g.where(F.lit(100.0) * F.col("k") / F.col("n") < 90).select("feature", "n", numbers.round_half(F.lit(100.0) * F.col("k") / F.col("n"), 1).alias("pct"))


@query("a12_mean_score", "SELECT l_partkey, floor(avg(s) * 10000 + 0.5) / 10000 AS score FROM (SELECT l_partkey, l_suppkey, count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a12(t):
    s = t("lineitem").groupBy("l_partkey", "l_suppkey").agg((F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)) / F.count(F.lit(1))).alias("s"))
    return s.groupBy("l_partkey").agg(numbers.round_half(F.avg("s"), 4).alias("score"))


@query("a13_break_fold", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value < 1) THEN 'survived' WHEN bool_or(event_type = 'purchase' AND value > 100) THEN 'killed' WHEN bool_or(event_type = 'error') THEN 'partial_run' ELSE 'unknown' END AS signal FROM events GROUP BY 1")
def a13(t):
    e = F.col("event_type")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    sig = F.when(any_((e == "error") & (F.col("value") < 1)), "survived").when(any_((e == "purchase") & (F.col("value") > 100)), "killed").when(any_(e == "error"), "partial_run").otherwise("unknown")
    return t("events").groupBy("user_id").agg(sig.alias("signal"))


@query("a15_three_valued", "SELECT feature, CASE WHEN bool_or(signals.exercised.value = 'yes') THEN 'yes' WHEN bool_and(coalesce(signals.exercised.value = 'no', false)) THEN 'no' ELSE 'unknown' END AS exercised FROM audit_rows WHERE feature IS NOT NULL GROUP BY 1")
def a15(t):
    v = F.col("signals.exercised.value")
    return t("audit_rows").where("feature IS NOT NULL").groupBy("feature").agg(aggregates.three_valued(v == "yes", v.isin("yes", "no")).alias("exercised"))


@query("a16_levels", "SELECT lang, kind, count(*) AS n, count(*) FILTER (end_line IS NOT NULL) AS known, CASE WHEN count(end_line) > 0 THEN floor(1000.0 * count(*) FILTER (end_line > line) / count(end_line) + 0.5) / 10.0 END AS pct FROM symbols GROUP BY ROLLUP (lang, kind)")
def a16(t):
    """Levels per language and kind, per language and in all; null where nothing is known."""
    g = t("symbols").rollup("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("end_line").alias("known"), F.sum(F.when(F.col("end_line") > F.col("line"), 1).otherwise(0)).alias("run"))
    return g.select("lang", "kind", "n", "known", numbers.try_share(F.col("run"), F.col("known")).alias("pct"))


@query("a19_packages", r"SELECT regexp_replace(file, '/[^/]*$', '') AS dir, count(DISTINCT fqn) AS symbols, floor(count(DISTINCT CASE WHEN feature IS NOT NULL THEN fqn END)::DOUBLE / count(DISTINCT fqn) * 10000 + 0.5) / 10000 AS attributed FROM symbols GROUP BY 1 HAVING count(DISTINCT fqn) >= 3")
def a19(t):
    g = t("symbols").groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("dir")).agg(F.countDistinct("fqn").alias("symbols"), F.countDistinct(F.when(F.col("feature").isNotNull(), F.col("fqn"))).alias("a"))
    return g.where("symbols >= 3").select("dir", "symbols", numbers.ratio(F.col("a"), F.col("symbols")).alias("attributed"))


@query("a20_confidence", "SELECT feature, least(10, 5 + CASE WHEN bool_or(kind = 'class') THEN 3 ELSE 0 END + CASE WHEN bool_or(is_test) THEN 1 ELSE 0 END + CASE WHEN bool_or(kind = 'trait') THEN 1 ELSE 0 END) / 10.0 AS confidence FROM symbols WHERE feature IS NOT NULL GROUP BY 1")
def a20(t):
    has = lambda c, n: F.when(F.bool_or(F.coalesce(c, F.lit(False))), n).otherwise(0)
    k = F.col("kind")
    return t("symbols").where("feature IS NOT NULL").groupBy("feature").agg((F.least(F.lit(10), F.lit(5) + has(k == "class", 3) + has(F.col("is_test"), 1) + has(k == "trait", 1)) / 10.0).alias("confidence"))


@query("a21_mode", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def a21(t):
    return aggregates.mode(t("documents"), ["source"], "lang")


@query("a23_rollup_kinds", "SELECT area, kind, count(*) AS n, count(DISTINCT source) AS sources FROM catalogue_nodes GROUP BY 1, 2")
def a23(t):
    return t("catalogue_nodes").groupBy("area", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("a24_build_state", "SELECT area, CASE WHEN count(status) = 0 THEN 'unknown' WHEN bool_and(coalesce(status = 'built', false)) THEN 'built' WHEN bool_and(coalesce(status = 'planned', false)) THEN 'planned' ELSE 'mixed' END AS state FROM catalogue_nodes GROUP BY 1")
def a24(t):
    all_ = lambda v: F.bool_and(F.coalesce(F.col("status") == v, F.lit(False)))
    return t("catalogue_nodes").groupBy("area").agg(F.when(F.count("status") == 0, "unknown").when(all_("built"), "built").when(all_("planned"), "planned").otherwise("mixed").alias("state"))


@query("a25_merged_edges", "SELECT from_id, to_id, kind, coalesce(string_agg(l, ',' ORDER BY l), '') AS labels FROM (SELECT DISTINCT from_id, to_id, kind, unnest(CASE WHEN labels IS NULL OR len(labels) = 0 THEN [NULL] ELSE labels END) AS l FROM block_edges WHERE from_id <> to_id) GROUP BY 1, 2, 3")
def a25(t):
    return aggregates.merged_edges(t("block_edges"), ["from_id", "to_id", "kind"], "labels")


@query("a26_layer_sets", "SELECT feature, coalesce(string_agg(l, ',' ORDER BY l), '') AS layers FROM (SELECT DISTINCT feature, unnest(CASE WHEN layers IS NULL OR len(layers) = 0 THEN [NULL] ELSE layers END) AS l FROM audit_rows) GROUP BY 1")
def a26(t):
    x = t("audit_rows").groupBy("feature").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("layers", F.array().cast("array<string>")))))).alias("l"))
    return x.select("feature", F.array_join("l", ",").alias("layers"))


@query("a27_first_rule", r"SELECT DISTINCT file, CASE WHEN file LIKE 'tests/%' THEN 'test' WHEN regexp_matches(file, '\.(ts|php)$') THEN 'ui' WHEN lang = 'go' THEN 'api' ELSE 'unknown' END AS layer FROM symbols WHERE lang IS NOT NULL")
def a27(t):
    """The layer of a file by the first rule that fits."""
    layer = F.when(F.col("file").rlike(text.glob_regex("tests/**")), "test").when(F.col("file").rlike(r"\.(ts|php)$"), "ui").when(F.col("lang") == "go", "api").otherwise("unknown")
    return t("symbols").where("lang IS NOT NULL").select("file", layer.alias("layer")).distinct()


@query("a28_one_actor", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT json_extract_string(props, '$.k')) >= 10 AND bool_or(event_type IN ('purchase', 'signup'))")
def a28(t):
    k = F.get_json_object("props", "$.k")
    g = t("events").groupBy("user_id").agg(F.countDistinct(k).alias("n"), F.bool_or(F.coalesce(F.col("event_type").isin("purchase", "signup"), F.lit(False))).alias("m"))
    return g.where("n >= 10 AND m").select("user_id")


@query("a29_colocation", r"SELECT feature, count(DISTINCT string_split(file, '/')[2]) AS dirs FROM symbols WHERE feature IS NOT NULL GROUP BY 1 HAVING count(DISTINCT string_split(file, '/')[1]) > 1")
def a29(t):
    part = lambda i: F.try_element_at(F.split("file", "/"), F.lit(i))
    g = t("symbols").where("feature IS NOT NULL").groupBy("feature").agg(F.countDistinct(part(2)).alias("dirs"), F.countDistinct(part(1)).alias("tops"))
    return g.where("tops > 1").select("feature", "dirs")


@query("a31_max_tier", "SELECT brd_id, max(tier) AS tier FROM rtm_rows GROUP BY 1")
def a31(t):
    return t("rtm_rows").groupBy("brd_id").agg(F.max("tier").alias("tier"))


@query("w1_top_similar", "SELECT e.vec_id, floor(greatest(0.0, list_cosine_similarity(e.embedding::DOUBLE[], z.embedding::DOUBLE[])) * 1000 + 0.5) / 1000 AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) z ORDER BY 2 DESC, 1 LIMIT 10")
def w1(t):
    e = t("embeddings")
    z = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("z"))  # one row
    s = e.join(F.broadcast(z)).select("vec_id", numbers.round_half(numbers.cosine(F.col("embedding"), F.col("z")), 3).alias("similarity"))
    return aggregates.top_k(s, [F.desc("similarity"), F.asc("vec_id")], 10)


@query("w2_best_per_item", "SELECT l_partkey, l_suppkey, q FROM (SELECT l_partkey, l_suppkey, floor(sum(l_quantity) * 100 + 0.5) / 100 AS q FROM lineitem GROUP BY 1, 2) WHERE q >= 100 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) = 1")
def w2(t):
    q = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(numbers.round_half(F.sum("l_quantity"), 2).alias("q")).where("q >= 100")
    return q.groupBy("l_partkey").agg(F.min_by(F.struct("l_suppkey", "q"), F.struct(-F.col("q"), F.col("l_suppkey"))).alias("m")).select("l_partkey", "m.l_suppkey", "m.q")


@query("w3_changes_only", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def w3(t):
    return aggregates.changes_only(t("events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("w5_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def w5(t):
    return aggregates.latest(t("events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])


@query("w6_next_id", r"SELECT feature, max(regexp_extract(inv, '(\d+)$', 1)::BIGINT) + 1 AS next FROM invariants GROUP BY 1")
def w6(t):
    return t("invariants").groupBy("feature").agg((F.max(F.regexp_extract("inv", r"(\d+)$", 1).try_cast("long")) + 1).alias("next"))


@query("o3_numeric_order", r"SELECT feature, inv, dense_rank() OVER (PARTITION BY feature ORDER BY regexp_replace(inv, '\d+$', ''), regexp_extract(inv, '(\d+)$', 1)::BIGINT, inv)::INT AS place FROM (SELECT DISTINCT feature, inv FROM invariants)")
def o3(t):
    w = Window.partitionBy("feature").orderBy(*numbers.id_order(F.col("inv")))
    return t("invariants").select("feature", "inv").distinct().withColumn("place", F.dense_rank().over(w))


@query("o2_distinct_edges", "SELECT DISTINCT from_id, kind, to_id FROM block_edges ORDER BY 1, 2, 3")
def o2(t):
    return t("block_edges").select("from_id", "kind", "to_id").distinct().orderBy("from_id", "kind", "to_id")


@query("o4_bounded_list", "SELECT source, count(*) AS n, greatest(count(*) - 5, 0) AS truncated, (array_agg(id ORDER BY id))[1] AS head FROM (SELECT DISTINCT source, id FROM catalogue_nodes) GROUP BY 1")
def o4(t):
    return t("catalogue_nodes").select("source", "id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.count(F.lit(1)) - 5, F.lit(0)).alias("truncated"), F.min("id").alias("head"))


@query("o5_islands", "SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, g")
def o5(t):
    return aggregates.islands(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("o5_ranges", "SELECT l_orderkey, string_agg(CASE WHEN f = l THEN f::VARCHAR ELSE f || '-' || l END, ', ' ORDER BY f) AS ranges FROM (SELECT l_orderkey, min(l_linenumber) AS f, max(l_linenumber) AS l FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, g) GROUP BY 1")
def o5_ranges(t):
    return aggregates.compact_ranges(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("d1_union_first", "SELECT feature, arg_min(origin, n) AS origin FROM (SELECT DISTINCT feature_id AS feature, 'manifest' AS origin, 0 AS n FROM features UNION ALL SELECT DISTINCT feature, 'promise', 1 FROM invariants UNION ALL SELECT DISTINCT feature, 'code', 2 FROM symbols) WHERE feature IS NOT NULL GROUP BY 1")
def d1(t):
    part = lambda name, c, o: t(name).where(F.col(c).isNotNull()).select(F.col(c).alias("feature")).distinct().withColumn("origin", F.lit(o))
    return sets.union_first([part("features", "feature_id", "manifest"), part("invariants", "feature", "promise"), part("symbols", "feature", "code")], ["feature"])


@query("d2_snapshot_diff", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n""")
def d2(t):
    at = lambda day: t("orders").where(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return sets.record_diff(at("1997-01-01"), at("1999-01-01"), ["o_custkey"], ["n"])


@query("d3_path_diff", """WITH v AS (SELECT feature_id, version, min(status) AS status, min(source_path) AS source_path FROM features GROUP BY 1, 2), e AS (SELECT feature_id, min(version) AS a, max(version) AS b FROM v GROUP BY 1 HAVING min(version) < max(version)),
 l AS (SELECT v.feature_id, version, unnest(['status', 'source_path']) AS path, unnest([status, source_path]) AS value FROM v),
 o AS (SELECT l.feature_id, path, value FROM l JOIN e ON l.feature_id = e.feature_id AND version = a), n AS (SELECT l.feature_id, path, value FROM l JOIN e ON l.feature_id = e.feature_id AND version = b)
 SELECT feature_id, path, 'changed' AS change, o.value AS old, n.value AS new FROM o JOIN n USING (feature_id, path) WHERE o.value IS DISTINCT FROM n.value""")
def d3(t):
    """Fields of the first and last version of a manifest, by path."""
    v = t("features").groupBy("feature_id", "version").agg(F.min("status").alias("status"), F.min("source_path").alias("source_path"))
    e = v.groupBy("feature_id").agg(F.min("version").alias("a"), F.max("version").alias("b")).where("a < b")
    flat = v.join(e, "feature_id").select("feature_id", "version", "a", "b", F.inline(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).alias("value")) for c in ("status", "source_path")))))
    side = lambda c: flat.where(F.col("version") == F.col(c)).select("feature_id", "path", "value")
    return sets.value_diff(side("a"), side("b"), ["feature_id", "path"], "value")


@query("d3_manifest_changes")
def d3_changes(t):
    """Every change of a manifest between one version and the next, by path."""
    return manifests.manifest_changes(t("features"))


@query("d4_introduced_resolved", "WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R') SELECT l_suppkey, 'introduced' AS what, count(*) AS n FROM b ANTI JOIN a USING (l_suppkey, l_partkey) GROUP BY 1 UNION ALL SELECT l_suppkey, 'resolved', count(*) FROM a ANTI JOIN b USING (l_suppkey, l_partkey) GROUP BY 1")
def d4(t):
    l = t("lineitem").where("l_returnflag = 'R'")  # noqa: E741
    day = F.lit("1997-01-01").cast("timestamp_ntz")
    sides = sets.one_sided(l.where(F.col("l_shipdate") < day), l.where(F.col("l_shipdate") >= day), ["l_suppkey", "l_partkey"])
    return sides.groupBy("l_suppkey", F.when(F.col("side") == "left", "resolved").otherwise("introduced").alias("what")).agg(F.count(F.lit(1)).alias("n"))
