"""Joins beyond plain keys, all as equi-joins on derived keys: no operator compares all pairs of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import checked_broadcast, small_or_none
from weftline.functions.text import dotted, wild_segments


def grouped_refs(links: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct values per key, sorted and joined by commas, with their number. Nulls are left out."""
    one = links.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return one.groupBy(*keys).agg(F.concat_ws(",", F.sort_array(F.collect_list(value))).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))


def flags_outer(left: DataFrame, right: DataFrame, keys: list[str], left_flag: str, right_flag: str) -> DataFrame:
    """Full outer join of the distinct keys of both sides with a flag for each side."""
    a = left.select(*keys).distinct().withColumn(left_flag, F.lit(True))
    b = right.select(*keys).distinct().withColumn(right_flag, F.lit(True))
    no = F.lit(False)
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce(left_flag, no).alias(left_flag), F.coalesce(right_flag, no).alias(right_flag))


def path_suffixes(path: Column) -> Column:
    """All whole-segment suffixes of a path, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_join(reports: DataFrame, files: DataFrame, report: str, file: str) -> DataFrame:
    """Each report path with the file it names: ``report, file, matches``.

    A path fits a file if either ends with the other in whole segments. The longest fit counts;
    if several files tie, ``file`` is null (never guess) and ``matches`` their number.
    """
    r = reports.where(F.col(report).isNotNull()).select(F.col(report).alias("_r")).distinct()
    f = files.where(F.col(file).isNotNull()).select(F.col(file).alias("_f")).distinct()
    short = r.join(f.select("_f", F.explode(path_suffixes(F.col("_f"))).alias("_r")), "_r").select("_r", "_f", F.length("_r").alias("n"))
    long = f.join(r.select("_r", F.explode(path_suffixes(F.col("_r"))).alias("_f")), "_f").select("_r", "_f", F.length("_f").alias("n"))
    fits = short.unionByName(long).groupBy("_r", "n").agg(F.min("_f").alias("_f"), F.countDistinct("_f").alias("matches"))
    best = fits.groupBy("_r").agg(F.max(F.struct("n", "matches", "_f")).alias("b"))
    return best.select(F.col("_r").alias("report"), F.when(F.col("b.matches") == 1, F.col("b._f")).alias("file"), F.col("b.matches").alias("matches"))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points in spans ``(lo, hi]`` of the same key. Spans are cut into buckets of ``width``, so
    that the join is one on key and bucket; long spans repeat once per bucket."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = points.where(F.col(at).isNotNull()).withColumn("_b", bucket(F.col(at)))
    s = spans.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) < F.col(hi))).withColumn("_b", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    return p.join(s, [*keys, "_b"]).where((F.col(at) > F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_b")


def innermost(contained: DataFrame, point: list[str], lo: str, hi: str, owner: str) -> DataFrame:
    """Of the spans around each point the shortest, ties by owner."""
    return contained.groupBy(*point).agg(F.min(F.struct((F.col(hi) - F.col(lo)).alias("n"), F.col(owner).alias("o"))).alias("m")).select(*point, F.col("m.o").alias(owner))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: int = 64) -> DataFrame:
    """Ranges of both sides that overlap within the same key, by shared buckets; each pair once,
    in the bucket of the later start."""
    cutup = lambda df, lo, hi: df.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    j = cutup(a, a_lo, a_hi).join(cutup(b, b_lo, b_hi), [*keys, "_b"])
    return j.where((F.col(a_lo) <= F.col(b_hi)) & (F.col(b_lo) <= F.col(a_hi)) & (F.col("_b") == F.floor(F.greatest(a_lo, b_lo) / width))).drop("_b")


def dotted_tails(name: Column) -> Column:
    """All dotted tails of a name, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tail_match(refs: DataFrame, cases: DataFrame, ref: str, case: str) -> DataFrame:
    """Each reference with the report case it means: ``ref, case, score, candidates``.

    Names are compared in dotted form. A case that is a tail of the reference scores its own
    length, one of which the reference is a tail the reference's, one that shares only the
    last part that part's. The best score wins; several cases at it give no case (null).
    """
    r = refs.where(F.col(ref).isNotNull()).select(dotted(F.col(ref)).alias("r")).where("r <> ''").distinct()
    c = cases.where(F.col(case).isNotNull()).select(dotted(F.col(case)).alias("c")).where("c <> ''").distinct()
    tail_of_ref = r.select("r", F.explode(dotted_tails(F.col("r"))).alias("c")).join(c, "c").select("r", "c", F.length("c").alias("score"))
    tail_of_case = c.select("c", F.explode(dotted_tails(F.col("c"))).alias("r")).join(r, "r").select("r", "c", F.length("r").alias("score"))
    full = tail_of_ref.unionByName(tail_of_case).groupBy("r", "score").agg(F.min("c").alias("c"), F.countDistinct("c").alias("n"))
    last = lambda x: F.regexp_extract(x, r"([^.]*)$", 1)
    # For the weakest match only the number of cases per last part matters: no pairs.
    by_last = c.groupBy(last(F.col("c")).alias("l")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"))
    weak = r.withColumn("l", last(F.col("r"))).join(by_last, "l").select("r", F.length("l").alias("score"), "c", "n")
    # A tail that is just the last part is the weak match itself: keep the larger count of the two.
    best = full.unionByName(weak.select("r", "score", "c", "n")).groupBy("r", "score").agg(F.max(F.struct("n", "c")).alias("m")).groupBy("r").agg(F.max(F.struct("score", "m")).alias("b"))
    return best.select(F.col("r").alias("ref"), F.when(F.col("b.m.n") == 1, F.col("b.m.c")).alias("case"), F.col("b.score").alias("score"), F.col("b.m.n").alias("candidates"))


def template_regex(name: Column) -> Column:
    """A parameterised title as a pattern: each `_` among the hyphens of its last part stands for one or more words."""
    word = r"[a-z0-9]+?(?:-[a-z0-9]+)*?"
    parts = F.transform(F.split(F.regexp_extract(name, r"([^.]*)$", 1), "-"), lambda p: F.when(p == "_", F.lit(word)).otherwise(F.regexp_replace(p, r"([\\.^$|?*+()\[\]{}])", r"\\$1")))
    return F.concat(F.lit("^"), F.array_join(parts, "-"), F.lit("$"))


def template_join(templates: DataFrame, cases: DataFrame, ref: str, case: str) -> DataFrame:
    """Templates with the cases they expand to: ``ref, case``.

    Blocked on the dotted path before the title and on the title's first word, or its last one
    where the first is a placeholder; only templates with placeholders at both ends meet all titles
    of their path.
    """
    head = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    title = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    first, last = (lambda c: F.substring_index(c, "-", 1)), (lambda c: F.substring_index(c, "-", -1))
    t = templates.select(F.col(ref).alias("ref")).distinct().where(F.col("ref").rlike(r"(^|[.-])_(-|$)")).select("ref", head(F.col("ref")).alias("h"), title(F.col("ref")).alias("w"), template_regex(F.col("ref")).alias("x"))
    by = F.when(first("w") != "_", "first").when(last("w") != "_", "last").otherwise("any")
    t = t.withColumn("by", by).withColumn("word", F.when(F.col("by") == "first", first("w")).when(F.col("by") == "last", last("w")).otherwise(""))
    c = cases.select(F.col(case).alias("case")).distinct().select("case", head(F.col("case")).alias("h"), title(F.col("case")).alias("title"))
    ways = F.array(*(F.struct(F.lit(n).alias("by"), w.alias("word")) for n, w in (("first", first("title")), ("last", last("title")), ("any", F.lit("")))))
    return t.join(c.select("case", "h", "title", F.inline(ways)), ["h", "by", "word"]).where(F.expr("title rlike x")).select("ref", "case")


def route_join(calls: DataFrame, routes: DataFrame, method: str = "method", path: str = "path") -> DataFrame:
    """Calls with the routes they reach: ``method, path, routes, route, outcome``.

    Equal method (a null route method fits any), equal number of segments, each route segment
    equal or a parameter. Each call is written with parameters in place of segments, in the ways
    that routes of as many segments have them, and joined on that; paths may have any length.
    """
    wild = F.array_join(F.transform("s", lambda x: F.when(x == "{}", F.lit("1")).otherwise(F.lit("0"))), "")
    seg = routes.where(F.col(path).isNotNull()).select(F.col(method).alias("rm"), F.col(path).alias("route")).distinct().withColumn("s", wild_segments(F.col("route")))
    r = seg.select("rm", F.array_join("s", "/").alias("k"), "route")
    masks = seg.select(wild.alias("m")).distinct().withColumn("n", F.length("m"))
    c = calls.where(F.col(path).isNotNull()).select(F.col(method).alias("method"), F.col(path).alias("path")).distinct()
    ways = c.withColumn("s", wild_segments(F.col("path"))).withColumn("n", F.size("s")).join(checked_broadcast(masks), "n")
    forms = ways.select("method", "path", F.array_join(F.transform("s", lambda x, i: F.when(F.substring(F.col("m"), i + 1, F.lit(1)) == "1", F.lit("{}")).otherwise(x)), "/").alias("k")).distinct()
    hit = forms.join(r, "k").where(F.col("rm").isNull() | (F.col("rm") == F.col("method")) | F.col("method").isNull())
    per = hit.groupBy("method", "path").agg(F.countDistinct("k").alias("n"), F.min("route").alias("route"))
    per = per.withColumnsRenamed({"method": "_m", "path": "_p"})
    out = c.join(per, F.col("method").eqNullSafe(F.col("_m")) & (F.col("path") == F.col("_p")), "left").select("method", "path", F.coalesce("n", F.lit(0)).alias("routes"), "route")
    return out.select("method", "path", "routes", F.when(F.col("routes") == 1, F.col("route")).alias("route"), F.when(F.col("routes") == 0, "no_route").when(F.col("routes") == 1, "edge").otherwise("ambiguous").alias("outcome"))


def channel_ends(publishers: DataFrame, consumers: DataFrame, channel: str) -> DataFrame:
    """Per channel the publishers and consumers, and whether an end dangles."""
    p = publishers.groupBy(channel).agg(F.count(F.lit(1)).alias("publishers"))
    c = consumers.groupBy(channel).agg(F.count(F.lit(1)).alias("consumers"))
    z = F.lit(0)
    out = p.join(c, channel, "full_outer").select(channel, F.coalesce("publishers", z).alias("publishers"), F.coalesce("consumers", z).alias("consumers"))
    return out.withColumn("state", F.when(F.col("publishers") == 0, "no_publisher").when(F.col("consumers") == 0, "no_consumer").otherwise("joined"))


def first_resolved(refs: DataFrame, ref: str, sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Resolution cascade: ``ref, target, basis, candidates``. ``sources`` are (basis, table, key,
    target) in order; the first with any candidate decides, and only if it has exactly one."""
    out = refs.select(F.col(ref).alias("ref")).distinct()
    basis, target, n = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long")
    for i, (name, table, key, to) in enumerate(sources):
        one = table.groupBy(F.col(key).alias("ref")).agg(F.min(to).alias(f"t{i}"), F.countDistinct(to).alias(f"n{i}"))
        out = out.join(one, "ref", "left")
        has = F.coalesce(f"n{i}", F.lit(0)) > 0
        target = F.coalesce(target, F.when(basis.isNull() & has & (F.col(f"n{i}") == 1), F.col(f"t{i}")))
        n = F.coalesce(n, F.when(has, F.col(f"n{i}")))
        basis = F.coalesce(basis, F.when(has, F.lit(name)))
    return out.select("ref", target.alias("target"), F.coalesce(basis, F.lit("missing")).alias("basis"), F.coalesce(n, F.lit(0)).alias("candidates"))


def unique_source(links: DataFrame, targets: DataFrame, key: str, source: str) -> DataFrame:
    """Links to targets that exactly one source has; others are kept with state `none` or `several`."""
    per = targets.groupBy(key).agg(F.countDistinct(source).alias("sources"), F.min(source).alias("only"))
    out = links.join(per, key, "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return out.withColumn("state", F.when(F.col("sources") == 0, "none").when(F.col("sources") == 1, "one").otherwise("several")).withColumn("only", F.when(F.col("sources") == 1, F.col("only")))


def fallback_join(rows: DataFrame, keys: list[str], own: DataFrame, wide: DataFrame, wide_keys: list[str], value: str) -> DataFrame:
    """Each row with its own evidence, else that of its wider group, else none: ``value, basis``."""
    o = own.select(*keys, F.col(value).alias("_own"))
    w = wide.select(*wide_keys, F.col(value).alias("_wide"))
    out = rows.join(o, keys, "left").join(w, wide_keys, "left")
    basis = F.when(F.col("_own").isNotNull(), "own").when(F.col("_wide").isNotNull(), "group").otherwise("none")
    return out.withColumn(value, F.coalesce("_own", "_wide")).withColumn("basis", basis).drop("_own", "_wide")


def prefix_overlaps(scopes: DataFrame, owner: str, path: str) -> DataFrame:
    """Paths of different owners where one lies under the other, or both are equal:
    ``path, owners, under``. Every path is joined with the paths above it, not with all others."""
    s = scopes.select(F.col(owner).alias("owner"), F.regexp_replace(path, "/+$", "").alias("path")).where("path <> '' AND owner IS NOT NULL").distinct()
    parts = F.split("path", "/")
    above = s.select("owner", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up"))
    # Per shared path only the extremes of the owners are needed to tell whether another owner is there.
    at = s.groupBy(F.col("path").alias("up")).agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.count(F.lit(1)).alias("owners"))
    clash = above.join(at, "up").where((F.col("lo") != F.col("owner")) | (F.col("hi") != F.col("owner")))
    return clash.groupBy("up").agg(F.count(F.lit(1)).alias("under"), F.max("owners").alias("owners")).withColumnRenamed("up", "path")


def asof_backward(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """Each row with ``value`` of the last mark of its key at or before ``at`` (null before the first)."""
    cols = [c for c in rows.columns if c not in keys and c != at]
    m = marks.select(*keys, at, F.col(value).alias(name), F.lit(0).alias("_side"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols))
    u = m.unionByName(rows.select(*keys, at, *cols).withColumn(name, F.lit(None).cast(marks.schema[value].dataType)).withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(name, F.last(F.when(F.col("_side") == 0, F.col(name)), ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def token_match(items: DataFrame, targets: DataFrame, item: str, item_tokens: str, target: str, target_tokens: str, least: float = 0.5) -> DataFrame:
    """Each item with the target whose tokens it shares best: the sum of ``1 / document frequency``
    over shared tokens by the number of the item's tokens; ties go to the first target by name.

    A sum of n shares reaches ``least * n`` only if one of them reaches ``least``, so pairs come from
    tokens of at most ``1 / least`` targets; frequent tokens only add to pairs that are there.
    """
    it = items.select(F.col(item).alias("item"), F.array_distinct(item_tokens).alias("tk")).distinct()
    tt = targets.select(F.col(target).alias("target"), F.explode(F.array_distinct(target_tokens)).alias("t")).distinct()
    df = tt.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    flat = it.select("item", F.size("tk").alias("n"), F.explode("tk").alias("t")).join(df, "t")
    rare = df.where(F.col("df") * least <= 1 + 1e-9).select("t")
    pairs = flat.select("item", "t").join(rare, "t").join(tt, "t").select("item", "target").distinct()
    shared = pairs.join(flat, "item").join(tt, ["target", "t"])
    score = shared.groupBy("item", "n", "target").agg((F.sum(1 / F.col("df")) / F.col("n")).alias("score"))
    best = score.groupBy("item").agg(F.max("score").alias("score"), F.min_by("target", F.struct(-F.col("score"), F.col("target"))).alias("target"))
    return best.where(F.col("score") >= least - 1e-9).select("item", "target", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


def resolve_ids(ids: DataFrame, known: DataFrame, prefixes: DataFrame, id: str = "id") -> DataFrame:
    """Ids as the known ids they stand for: ``id, resolved``, null where none does.

    An id that is known stands for itself, else for the known id that the first prefix makes of it.
    ``prefixes (prefix, rank)`` is a short list (checked): each id is written once for each, then joined.
    """
    known_prefixes = small_or_none(prefixes.select("prefix", "rank"), 1000)
    if known_prefixes is None:
        raise ValueError("more than 1000 prefixes")
    ways = F.array(*(F.struct(F.lit(r["prefix"]).alias("prefix"), F.lit(r["rank"]).cast("int").alias("rank")) for r in [*known_prefixes, {"prefix": "", "rank": -1}]))
    one = ids.where(F.col(id).isNotNull()).select(F.col(id).alias("id")).distinct()
    ways = one.select("id", F.inline(ways)).select("id", F.concat("prefix", "id").alias("k"), "rank")
    hit = ways.join(known.select(F.col(id).alias("k")).distinct(), "k", "left_semi").groupBy("id").agg(F.min_by("k", "rank").alias("resolved"))
    return one.join(hit, "id", "left").select("id", "resolved")


def policy_test(subjects: DataFrame, enabled: DataFrame, policies: DataFrame, members: DataFrame) -> DataFrame:
    """Whether each of ``subjects (object, op, role)`` is let through: ``state`` allowed, unknown or denied.

    An object that is not in ``enabled (object)`` lets all through. Else a policy of ``policies
    (object, op, role, restrictive)`` must name the op (null: every op) and the role, the role
    ``public`` or one the role is a member of; restrictive ones never let through. ``members
    (role, of, certain)``: where only an uncertain membership leads to a policy, the state is unknown.
    """
    s = subjects.where("object IS NOT NULL AND role IS NOT NULL").select("object", "op", "role").distinct()
    own = s.select("object", "op", "role", F.inline(F.array(F.struct(F.col("role").alias("as"), F.lit(True).alias("certain")), F.struct(F.lit("public").alias("as"), F.lit(True).alias("certain")))))
    led = s.join(members.groupBy("role", F.col("of").alias("as")).agg(F.bool_or("certain").alias("certain")), "role").select("object", "op", "role", "as", "certain")
    p = policies.where("NOT coalesce(restrictive, false)").select("object", F.col("op").alias("for_op"), F.col("role").alias("as")).distinct()
    hit = own.unionByName(led).join(p, ["object", "as"]).where("for_op IS NULL OR for_op = op").groupBy("object", "op", "role").agg(F.bool_or("certain").alias("sure"))
    hit = hit.withColumn("k", F.coalesce("op", F.lit(""))).drop("op")
    on = enabled.select("object").distinct().withColumn("on", F.lit(True))
    state = F.when(F.col("on").isNull() | F.col("sure"), "allowed").when(F.col("sure").isNotNull(), "unknown").otherwise("denied")
    return s.withColumn("k", F.coalesce("op", F.lit(""))).join(on, "object", "left").join(hit, ["object", "role", "k"], "left").select("object", "op", "role", state.alias("state"))


def killers(breaks: DataFrame, verifiers: DataFrame) -> DataFrame:
    """Which verifiers of a promise fail when its enforcer is broken: ``promise, verifier, killed``.

    ``breaks (promise, failed)``: cases that failed in the break's run; ``verifiers (promise,
    verifier)``. A verifier means the case that :func:`tail_match` finds among all failed ones;
    ambiguous ones mean none, and their state is null.
    """
    v = verifiers.where("promise IS NOT NULL AND verifier IS NOT NULL").select("promise", "verifier").distinct().withColumn("ref", dotted(F.col("verifier")))
    met = tail_match(v, breaks, "ref", "failed").select("ref", "case", "candidates")
    failed = breaks.where("failed IS NOT NULL").select("promise", dotted(F.col("failed")).alias("case")).distinct().withColumn("hit", F.lit(True))
    j = v.join(met, "ref", "left").join(failed, ["promise", "case"], "left")
    killed = F.when(F.col("hit"), True).when(F.col("candidates") > 1, F.lit(None)).otherwise(False)
    return j.select("promise", "verifier", killed.alias("killed"))
