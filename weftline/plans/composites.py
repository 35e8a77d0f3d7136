"""Classification queries composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.numbers import ratio
from weftline.operators import aggregates
from weftline.plans.registry import query
from weftline.plans.rollups import CLASSES

#: Severity of a criterion's status, worst first; names in STATUS order of the cards.
LADDER = ("phantom", "unenforced", "failing", "unverified", "unmapped", "partial", "verified", "demonstrated", "exercised")

_PARTS = """v AS (SELECT l_partkey, l_suppkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END) AS o, bool_or(l_quantity >= 40) AS ran FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2),
 pv AS (SELECT l_partkey, count(*) AS n, count(o) AS known, coalesce(bool_or(o = 0), false) AS failed, bool_and(coalesce(o = 1, false)) AS passed, bool_or(ran) AS ran FROM v GROUP BY 1),
 pe AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax = 0.0),
 ps AS (SELECT p.p_partkey, p.p_size, CASE WHEN p.p_size = 13 THEN 0 WHEN pe.l_partkey IS NULL THEN 1 WHEN pv.n IS NULL THEN 3 WHEN p.p_size <= 4 THEN 5 WHEN pv.failed THEN 2 WHEN pv.known > 0 AND pv.passed THEN CASE WHEN pv.ran THEN 8 ELSE 7 END ELSE 6 END AS sev,
   pe.l_partkey IS NOT NULL AS enforced, coalesce(pv.n, 0) AS verifiers, coalesce(pv.failed, false) AS failed, coalesce(pv.ran, false) AS ran FROM part p LEFT JOIN pe ON pe.l_partkey = p.p_partkey LEFT JOIN pv ON pv.l_partkey = p.p_partkey)"""
_LADDER_SQL = "WITH " + _PARTS + """, r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
 c AS (SELECT l_orderkey, min(coalesce(ps.sev, 0)) AS sev FROM r LEFT JOIN ps ON ps.p_partkey = r.l_partkey GROUP BY 1),
 q AS (SELECT o_orderkey, o_orderpriority, coalesce(c.sev, 4) AS sev FROM orders LEFT JOIN c ON c.l_orderkey = o_orderkey)"""


def _promises(t) -> DataFrame:
    """Status of each part taken as a promise: enforced, verified and proven by its line items."""
    l = t("lineitem")  # noqa: E741
    outcome = F.min(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1))
    v = l.where("l_discount >= 0.09").groupBy("l_partkey", "l_suppkey").agg(outcome.alias("o"), F.bool_or(F.col("l_quantity") >= 40).alias("ran"))
    no = F.lit(False)
    pv = v.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count("o").alias("known"), F.bool_or(F.coalesce(F.col("o") == 0, no)).alias("failed"), F.bool_and(F.coalesce(F.col("o") == 1, no)).alias("passed"), F.bool_or("ran").alias("ran"))
    pe = l.where("l_tax = 0.0").select("l_partkey").distinct().withColumn("enforced", F.lit(True))
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_size").join(pe, "l_partkey", "left").join(pv, "l_partkey", "left")
    sev = (
        F.when(F.col("p_size") == 13, 0).when(F.col("enforced").isNull(), 1).when(F.col("n").isNull(), 3).when(F.col("p_size") <= 4, 5).when(F.col("failed"), 2)
        .when((F.col("known") > 0) & F.col("passed"), F.when(F.col("ran"), 8).otherwise(7)).otherwise(6)
    )
    return p.select("l_partkey", "p_size", sev.alias("sev"), F.coalesce("enforced", no).alias("enforced"), F.coalesce("n", F.lit(0)).alias("verifiers"), F.coalesce("failed", no).alias("failed"), F.coalesce("ran", no).alias("ran"))


def _criteria(t) -> DataFrame:
    """Each order as a criterion with the worst status of the parts it refers to."""
    refs = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    worst = refs.join(_promises(t), "l_partkey", "left").groupBy("o_orderkey").agg(F.min(F.coalesce("sev", F.lit(0))).alias("sev"))
    return t("orders").select("o_orderkey", "o_orderpriority").join(worst, "o_orderkey", "left").withColumn("sev", F.coalesce("sev", F.lit(4)))


@query("q1_ladder", _LADDER_SQL + f" SELECT o_orderkey, (array[{', '.join(f"'{s}'" for s in LADDER)}])[sev + 1] AS status FROM q")
def q1(t):
    return _criteria(t).select("o_orderkey", aggregates.named(F.col("sev"), LADDER).alias("status"))


@query("q1_requirements", _LADDER_SQL + """, s AS (SELECT o_orderpriority AS requirement, count(*) AS total, count(*) FILTER (sev = 0) AS phantom, count(*) FILTER (sev = 1) AS unenforced, count(*) FILTER (sev = 2) AS failing, count(*) FILTER (sev = 3) AS unverified, count(*) FILTER (sev = 4) AS unmapped, count(*) FILTER (sev = 5) AS partial, count(*) FILTER (sev = 6) AS verified, count(*) FILTER (sev >= 7) AS demonstrated, count(*) FILTER (sev = 8) AS exercised FROM q GROUP BY 1)
 SELECT *, CASE WHEN total = 0 THEN 'unmapped' WHEN phantom > 0 THEN 'phantom' WHEN unenforced > 0 THEN 'unenforced' WHEN failing > 0 THEN 'failing' WHEN unverified > 0 THEN 'unverified' WHEN partial > 0 THEN 'partial' WHEN unmapped > 0 AND verified = 0 AND demonstrated = 0 THEN 'unmapped' WHEN verified > 0 THEN 'verified' WHEN exercised > 0 AND exercised = demonstrated THEN 'exercised' ELSE 'demonstrated' END AS worst,
 floor((verified + demonstrated)::DOUBLE / total * 10000 + 0.5) / 10000 AS rate FROM s""")
def q1_requirements(t):
    """Counts per requirement, its rate and its worst status by the cascade."""
    sev = F.col("sev")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    s = _criteria(t).groupBy(F.col("o_orderpriority").alias("requirement")).agg(
        F.count(F.lit(1)).alias("total"), *(n(sev == i).alias(LADDER[i]) for i in range(7)), n(sev >= 7).alias("demonstrated"), n(sev == 8).alias("exercised")
    )
    has = lambda c: F.col(c) > 0
    worst = F.when(F.col("total") == 0, "unmapped")
    for c in ("phantom", "unenforced", "failing", "unverified", "partial"):
        worst = worst.when(has(c), c)
    worst = worst.when(has("unmapped") & ~has("verified") & ~has("demonstrated"), "unmapped").when(has("verified"), "verified").when(has("exercised") & (F.col("exercised") == F.col("demonstrated")), "exercised").otherwise("demonstrated")
    return s.select("*", worst.alias("worst"), ratio(F.col("verified") + F.col("demonstrated"), F.col("total")).alias("rate"))


@query("q2_audit", "WITH " + _PARTS + f""", k AS (SELECT p_partkey, CASE WHEN enforced AND verifiers > 0 AND NOT ran AND p_size % 5 = 0 THEN 'fake' WHEN enforced AND verifiers > 0 AND ran AND NOT failed AND sev > 0 THEN 'break_tested' WHEN sev = 8 THEN 'exercised' WHEN sev = 7 THEN 'demonstrated_only' WHEN sev = 1 THEN 'unenforced' WHEN sev = 3 THEN 'unverified' WHEN sev IN (2, 6) THEN 'not_demonstrated' ELSE 'unknown' END AS class FROM ps)
 SELECT c.class, count(k.class) AS n FROM (VALUES {', '.join(f"('{c}')" for c in CLASSES)}) c(class) LEFT JOIN k USING (class) GROUP BY 1""")
def q2(t):
    """Classes of all promises, with zeros."""
    p, sev, wired = _promises(t), F.col("sev"), F.col("enforced") & (F.col("verifiers") > 0)
    cls = (
        F.when(wired & ~F.col("ran") & (F.col("p_size") % 5 == 0), "fake").when(wired & F.col("ran") & ~F.col("failed") & (sev > 0), "break_tested").when(sev == 8, "exercised").when(sev == 7, "demonstrated_only")
        .when(sev == 1, "unenforced").when(sev == 3, "unverified").when(sev.isin(2, 6), "not_demonstrated").otherwise("unknown")
    )
    return aggregates.filled_counts(p.select(cls.alias("class")), "class", CLASSES)


@query("q12_findings", """SELECT 'UNMAPPED_ROW' AS code, row_id::VARCHAR AS subject FROM rtm_rows WHERE trim(coalesce(maps_to, '')) = '' UNION SELECT 'NO_ENFORCER', row_id::VARCHAR FROM rtm_rows WHERE enforcers IS NULL OR len(enforcers) = 0
 UNION SELECT 'NO_VERIFIER', row_id::VARCHAR FROM rtm_rows WHERE verifiers IS NULL OR len(verifiers) = 0 UNION SELECT 'ORPHAN_FEATURE', feature FROM symbols WHERE feature IS NOT NULL AND feature NOT IN (SELECT feature FROM invariants) UNION SELECT 'SELF_LINK', trim(from_id) FROM block_edges WHERE trim(from_id) = trim(to_id)""")
def q12(t):
    """Findings of several rules, each once, by code and subject."""
    r = t("rtm_rows")
    row = lambda code, cond: r.where(cond).select(F.lit(code).alias("code"), F.col("row_id").cast("string").alias("subject"))
    none = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    orphan = t("symbols").where("feature IS NOT NULL").join(t("invariants").select("feature"), "feature", "left_anti").select(F.lit("ORPHAN_FEATURE").alias("code"), F.col("feature").alias("subject"))
    loop = t("block_edges").where(F.trim("from_id") == F.trim("to_id")).select(F.lit("SELF_LINK").alias("code"), F.trim("from_id").alias("subject"))
    return row("UNMAPPED_ROW", F.trim(F.coalesce("maps_to", F.lit(""))) == "").unionByName(row("NO_ENFORCER", none("enforcers"))).unionByName(row("NO_VERIFIER", none("verifiers"))).unionByName(orphan).unionByName(loop).distinct()


@query("q13_coverage_findings", """WITH b AS (SELECT feature, count(*) AS n, count(end_line) AS known FROM symbols WHERE feature IS NOT NULL GROUP BY 1)
 SELECT feature, CASE WHEN known = 0 THEN 'unknown' WHEN known < n THEN 'partial' ELSE 'full' END AS state, n - known AS missing FROM b""")
def q13(t):
    """No data raises no finding: unknown is its own state."""
    b = t("symbols").where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("end_line").alias("known"))
    return b.select("feature", F.when(F.col("known") == 0, "unknown").when(F.col("known") < F.col("n"), "partial").otherwise("full").alias("state"), (F.col("n") - F.col("known")).alias("missing"))


@query("q19_candidates", r"""WITH d AS (SELECT regexp_replace(file, '/[^/]*$', '') AS dir, lang, count(*) AS n FROM symbols WHERE NOT is_test GROUP BY 1, 2)
 SELECT dir, sum(n)::BIGINT AS symbols, (array_agg(lang ORDER BY n DESC, lang))[1] AS lang FROM d WHERE lang IS NOT NULL GROUP BY 1 HAVING sum(n) >= 3""")
def q19(t):
    """Folders with three symbols or more and their dominant language."""
    d = t("symbols").where("NOT is_test AND lang IS NOT NULL").groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("dir"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("dir").agg(F.sum("n").alias("symbols"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang")).where("symbols >= 3")


@query("q22_lexical_search", "SELECT 'document' AS entity, doc_id::VARCHAR AS id FROM documents WHERE contains(lower(text), 'retry queue') UNION ALL SELECT DISTINCT 'promise', feature || ':' || inv FROM invariants WHERE contains(lower(statement), 'retry queue') UNION ALL SELECT DISTINCT 'node', source || '/' || id FROM catalogue_nodes WHERE contains(lower(title), 'retry queue')")
def q22(t):
    """Entities whose text contains a phrase."""
    phrase = "retry queue"
    hit = lambda c: F.lower(F.col(c)).contains(phrase)
    d = t("documents").where(hit("text")).select(F.lit("document").alias("entity"), F.col("doc_id").cast("string").alias("id"))
    p = t("invariants").where(hit("statement")).select(F.lit("promise").alias("entity"), F.concat_ws(":", "feature", "inv").alias("id")).distinct()
    n = t("catalogue_nodes").where(hit("title")).select(F.lit("node").alias("entity"), F.concat_ws("/", "source", "id").alias("id")).distinct()
    return d.unionByName(p).unionByName(n)


@query("q23_prefix_search", r"SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(list_filter(w, lambda x: starts_with(x, 'vouch'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'retr'))) > 0")
def q23(t):
    """Documents in which every term is the beginning of some word."""
    w = text.words(F.col("text"))
    return t("documents").where("text IS NOT NULL").where(text.has_prefixes(w, ["vouch", "retr"])).select("doc_id")


@query("q24_area_assurance", f"SELECT feature, (array[{', '.join(f"'{c}'" for c in CLASSES)}])[min(CASE regexp_replace(lower(trim(class)), '[- ]', '_', 'g') {' '.join(f"WHEN '{v}' THEN {n}" for n, v in enumerate(CLASSES))} END) + 1] AS class FROM audit_rows WHERE feature IS NOT NULL GROUP BY 1")
def q24(t):
    """Worst class per feature."""
    c = F.regexp_replace(F.lower(F.trim("class")), "[- ]", "_")
    return aggregates.worst_of(t("audit_rows").where("feature IS NOT NULL").select("feature", c.alias("class")), ["feature"], "class", CLASSES)


@query("q7_impact", """WITH ch AS (SELECT DISTINCT fqn, feature FROM symbols WHERE deleted_at IS NOT NULL), r AS (SELECT DISTINCT row_id, brd_id, regexp_replace(trim(unnest(enforcers)), '\\(\\)$', '') AS e FROM rtm_rows)
 SELECT brd_id, count(DISTINCT row_id) AS criteria, count(DISTINCT e) AS symbols FROM r JOIN (SELECT DISTINCT fqn FROM ch) c ON c.fqn = r.e GROUP BY 1""")
def q7(t):
    """Requirements and criteria touched by symbols that were deleted."""
    gone = t("symbols").where("deleted_at IS NOT NULL").select(F.col("fqn").alias("e")).distinct()
    r = t("rtm_rows").select("row_id", "brd_id", F.explode("enforcers").alias("e")).select("row_id", "brd_id", F.regexp_replace(F.trim("e"), r"\(\)$", "").alias("e")).distinct()
    return r.join(gone, "e", "left_semi").groupBy("brd_id").agg(F.countDistinct("row_id").alias("criteria"), F.countDistinct("e").alias("symbols"))


@query("q5_class_falls", r"""WITH s AS (SELECT feature, invariant, snapshot_no, min(CASE regexp_replace(lower(trim(class)), '[- ]', '_', 'g') """ + " ".join(f"WHEN '{v}' THEN {n}" for n, v in enumerate(CLASSES)) + r""" END) AS r FROM audit_rows WHERE feature IS NOT NULL AND invariant IS NOT NULL GROUP BY 1, 2, 3),
 l AS (SELECT *, lag(r) OVER (PARTITION BY feature, invariant ORDER BY snapshot_no) AS p FROM s) SELECT feature, invariant, snapshot_no, CASE WHEN r <= 3 THEN 'broken' ELSE 'weaker' END AS verdict FROM l WHERE r < p""")
def q5(t):
    """Promises whose class fell from one snapshot they are in to the next."""
    c = F.regexp_replace(F.lower(F.trim("class")), "[- ]", "_")
    s = t("audit_rows").where("feature IS NOT NULL AND invariant IS NOT NULL").groupBy("feature", "invariant", "snapshot_no").agg(F.min(F.when(c.isin(*CLASSES), aggregates.ranked(c, CLASSES))).alias("r"))
    p = F.lag("r").over(Window.partitionBy("feature", "invariant").orderBy("snapshot_no"))
    return s.withColumn("p", p).where("r < p").select("feature", "invariant", "snapshot_no", F.when(F.col("r") <= 3, "broken").otherwise("weaker").alias("verdict"))
