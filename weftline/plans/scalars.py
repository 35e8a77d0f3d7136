"""Scalar functions and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import numbers, refs, text
from weftline.operators import filters
from weftline.plans.registry import query


@query("c1_words", r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL")
def c1(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n"))


@query("c2_content_words", "SELECT row_id, statement, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(statement), '[^a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN ('the', 'a', 'an', 'of', 'to', 'and', 'or', 'is', 'are', 'be', 'for', 'in', 'on', 'with', 'that', 'this', 'it', 'as', 'by', 'from', 'must', 'not', 'can', 'will'))), ' ') AS words FROM rtm_rows WHERE statement IS NOT NULL")
def c2(t):
    return t("rtm_rows").where("statement IS NOT NULL").select("row_id", "statement", F.array_join(text.content_words(F.col("statement")), " ").alias("words"))


@query("c3_fnv")
def c3(t):
    return t("symbols").select("name").distinct().select("name", text.fnv1a(F.col("name")).alias("bucket"))


@query("c4_cosine", "SELECT e.vec_id, floor(greatest(0.0, list_cosine_similarity(e.embedding::DOUBLE[], z.embedding::DOUBLE[])) * 1000 + 0.5) / 1000 AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) z")
def c4(t):
    e = t("embeddings")
    z = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("z"))  # one row
    return e.join(F.broadcast(z)).select("vec_id", numbers.round_half(numbers.cosine(F.col("embedding"), F.col("z")), 3).alias("similarity"))


@query("c6_slug", "SELECT DISTINCT p_name, CASE WHEN s = '' THEN 'test' ELSE s END AS slug FROM (SELECT p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def c6(t):
    return t("part").select("p_name").distinct().select("p_name", text.slug(F.col("p_name")).alias("slug"))


@query("c7_dotted", r"SELECT DISTINCT file, regexp_replace(regexp_replace(lower(file), '[:\\/#\s().]+', '.', 'g'), '^\.+|\.+$', '', 'g') AS dotted FROM symbols WHERE file IS NOT NULL")
def c7(t):
    return t("symbols").where("file IS NOT NULL").select("file").distinct().select("file", text.dotted(F.col("file")).alias("dotted"))


@query("c8_percent", "SELECT l_orderkey, CASE WHEN count(*) = 0 THEN 100.0 ELSE floor(1000.0 * count(*) FILTER (l_returnflag = 'A') / count(*) + 0.5) / 10.0 END AS pct FROM lineitem GROUP BY 1")
def c8(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("l_orderkey", numbers.percent(F.col("a"), F.col("n")).alias("pct"))


@query("c10_word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\x0b\f\r]+'), lambda w: w <> ''))::BIGINT AS n, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS lines FROM documents WHERE text IS NOT NULL")
def c10(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n"), text.line_count(F.col("text")).cast("long").alias("lines"))


@query("c11_inline", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def c11(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.md5(text.inline(F.col("text"))).alias("digest"))


@query("c12_segments", r"SELECT DISTINCT http_path, array_to_string(list_transform(list_filter(string_split(http_path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(:.+|\{.*\}|\[.*\])$') THEN '{}' ELSE s END), '/') AS shape FROM catalogue_nodes WHERE http_path IS NOT NULL")
def c12(t):
    return t("catalogue_nodes").where("http_path IS NOT NULL").select("http_path").distinct().select("http_path", F.array_join(text.wild_segments(F.col("http_path")), "/").alias("shape"))


@query("c14_canonical_hash")
def c14(t):
    return t("supplier").select("s_suppkey", text.canonical_hash("s_name", "s_nationkey", "s_acctbal").alias("hash"))


@query("c17_short_sha", "SELECT DISTINCT fqn, left(sha256(fqn), 8) AS sha FROM symbols")
def c17(t):
    return t("symbols").select("fqn").distinct().select("fqn", text.short_sha(F.col("fqn")).alias("sha"))


@query("g1_reference_grammar", r"""SELECT DISTINCT r, CASE WHEN regexp_matches(r, '^.+:[^:]*$') THEN regexp_extract(r, '^(.+):[^:]*$', 1) ELSE feature_id END AS scope,
  CASE WHEN regexp_matches(r, '^.+:[^:]*$') THEN regexp_extract(r, '([^:]*)$', 1) ELSE r END AS item, regexp_extract(r, '#([^#]*)$', 1) AS case_id
  FROM (SELECT feature_id, trim(unnest(string_split(maps_to, ','))) AS r FROM rtm_rows)""")
def g1(t):
    r = t("rtm_rows").select("feature_id", F.explode(F.split("maps_to", ",")).alias("r")).select("feature_id", F.trim("r").alias("r"))
    return r.select("r", refs.scope(F.col("r"), F.col("feature_id")).alias("scope"), refs.item(F.col("r")).alias("item"), refs.case(F.col("r")).alias("case_id")).distinct()


@query("f1_search_filter", "SELECT DISTINCT id, source, kind, area FROM catalogue_nodes WHERE kind = 'screen' AND status = 'built' ORDER BY id, source, kind, area LIMIT 50")
def f1(t):
    return filters.search(t("catalogue_nodes").select("id", "source", "kind", "area", "status"), {"kind": "screen", "status": "built", "area": ""}, ["id", "source", "kind", "area"])


@query("f2_predicate", "SELECT p_partkey, p_brand, p_size FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size >= 20 AND p_retailprice < 1500")
def f2(t):
    return t("part").where(filters.parse_predicate("brand=Brand#1 size>=20 price<1500", {"brand": "p_brand"}, {"size": "p_size", "price": "p_retailprice"})).select("p_partkey", "p_brand", "p_size")


@query("f3_scope", "SELECT DISTINCT fqn, file FROM symbols WHERE file = 'src/payments' OR starts_with(file, 'src/payments/')")
def f3(t):
    return t("symbols").where(text.in_scope(F.col("file"), "src/payments/")).select("fqn", "file").distinct()


@query("f4_glob", r"SELECT DISTINCT fqn, file FROM symbols WHERE NOT regexp_matches(file, '^(?:[^/]+/)*test_[^/]*\.py$')")
def f4(t):
    return t("symbols").where(~F.col("file").rlike(text.glob_regex("**/test_*.py"))).select("fqn", "file").distinct()


@query("f5_narrow_unknown", "SELECT w.feature, CASE WHEN f.feature IS NULL THEN 'unknown' ELSE 'known' END AS state, coalesce(f.n, 0) AS n FROM (VALUES ('payments.ledger'), ('no.such.feature')) w(feature) LEFT JOIN (SELECT feature, count(*) AS n FROM audit_rows GROUP BY 1) f USING (feature)")
def f5(t):
    return filters.narrowed_counts(t("audit_rows"), "feature", ["payments.ledger", "no.such.feature"])


@query("f6_narrow_totals", "SELECT l_suppkey, count(*) AS n, floor(sum(l_quantity) * 100 + 0.5) / 100 AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def f6(t):
    return t("lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), numbers.round_half(F.sum("l_quantity"), 2).alias("quantity"))


@query("f8_product_files", r"SELECT DISTINCT file FROM symbols WHERE NOT regexp_matches(file, '(\.d\.ts|\.config\.[a-z]+)$') AND NOT starts_with(file, 'tests/')")
def f8(t):
    return t("symbols").where(filters.is_product(F.col("file")) & ~F.col("file").startswith("tests/")).select("file").distinct()


@query("f9_attribution", "SELECT file, bool_or(NOT is_test AND kind IN ('class', 'function', 'method', 'trait')) AS production, bool_or(feature IS NOT NULL) AS attributed FROM symbols GROUP BY 1")
def f9(t):
    return filters.attribution(t("symbols"))


@query("f10_severity", "SELECT severity, count(*) AS n FROM (SELECT coalesce(o.s, 'warning') AS severity FROM events e LEFT JOIN (VALUES ('error', 'error'), ('view', 'off'), ('click', 'info')) o(k, s) ON e.event_type = o.k) WHERE severity <> 'off' GROUP BY 1")
def f10(t):
    return filters.with_severity(t("events"), "event_type", {"error": "error", "view": "off", "click": "info"}, "warning").where("severity <> 'off'").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("f11_allowlist", "SELECT 'accepted' AS state, count(*) AS n FROM symbols WHERE kind IN ('trait', 'enum') UNION ALL SELECT 'open', count(*) FROM symbols WHERE kind NOT IN ('trait', 'enum') UNION ALL SELECT 'stale', 1")
def f11(t):
    spark = t("symbols").sparkSession
    allow = spark.createDataFrame([("trait",), ("enum",)], "kind string")
    return filters.allowlisted(t("symbols").select("kind"), allow, "kind")


@query("f13_usable", "SELECT a.brd_id, count(*) AS n FROM rtm_rows a WHERE a.feature_id IS NULL OR a.feature_id = '' OR starts_with(a.brd_id, 'brd.' || string_split(a.feature_id, '.')[1]) GROUP BY 1")
def f13(t):
    r = t("rtm_rows")
    return r.where(F.col("feature_id").isNull() | (F.col("feature_id") == "") | F.col("brd_id").startswith(F.concat(F.lit("brd."), refs.top_group(F.col("feature_id"))))).groupBy("brd_id").agg(F.count(F.lit(1)).alias("n"))


@query("f14_active", "SELECT feature, inv, max(created_at) AS created_at FROM invariants WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '2025-06-01' GROUP BY 1, 2")
def f14(t):
    return filters.active(t("invariants"), "deleted_at", "2025-06-01").groupBy("feature", "inv").agg(F.max("created_at").alias("created_at"))


@query("f15_actionable", "SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')")
def f15(t):
    return t("orders").where("o_orderstatus <> 'F'").join(t("lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("f16_broad", r"""SELECT doc_id FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS w,
  greatest(len(list_filter(regexp_split_to_array(text, '[.!?]+([ \t\n\x0b\f\r]+|$)'), lambda s: trim(s) <> '')), 1) AS s FROM documents) WHERE w >= 60 AND s >= 2 OR s >= 3 OR w >= 70""")
def f16(t):
    return t("documents").where(text.is_broad(F.col("text"))).select("doc_id")


@query("f17_mentionable", r"""SELECT DISTINCT name FROM symbols WHERE len(name) >= 4 AND NOT regexp_matches(name, '^[0-9]')
  AND (regexp_matches(name, '[a-z][A-Z]') OR regexp_matches(name, '[A-Z][A-Z][a-z]') OR regexp_matches(name, '[A-Za-z0-9]_[A-Za-z0-9]'))
  AND lower(name) NOT IN ('beforeeach', 'aftereach', 'beforeall', 'afterall', 'setup', 'teardown', 'setupclass', 'tobe', 'toequal', 'tobevisible', 'tohavetext', 'tocontain', 'tomatch', 'tothrow', 'getbyrole', 'getbytext', 'getbytestid', 'getbylabel', 'getbylabeltext', 'queryselector', 'foreach', 'tostring', 'tojson', 'valueof', 'hasownproperty', 'isarray', 'usestate', 'useeffect', 'usememo', 'usecallback', 'useref', 'usecontext', 'setstate', 'onclick', 'onchange', 'onsubmit', 'onload', 'onerror', 'onclose', 'isempty', 'isvalid', 'isenabled', 'getvalue', 'setvalue', 'getname', 'setname', 'getdata', 'setdata', 'getitem', 'setitem', 'getid')""")
def f17(t):
    return t("symbols").where(filters.mentionable(F.col("name"))).select("name").distinct()


@query("f18_narrowing_terms")
def f18(t):
    return filters.narrowing_terms(t("rtm_rows").select("row_id", F.concat("feature_id", F.lit(":"), F.trim("invariant_id")).alias("key"), "statement"), t("invariants").groupBy("feature", "inv").agg(F.max("statement").alias("statement")).select(F.concat("feature", F.lit(":"), "inv").alias("key"), F.col("statement").alias("promise")), "key", "statement", "promise")
