"""URL filtering: explicit rules, and a path-template tree per host (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import staged

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its path.
Rules = list[tuple[str, str, str]]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null; of equal length the first given."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _at_least(n: Column, all_: Column, share: float, z: float) -> Column:
    """Whether ``n`` of ``all_`` repeat and are surely (lower Wilson bound at ``z``) a ``share`` or more."""
    p = n / all_
    low = (p + z * z / (2 * all_) - z * F.sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))) / (1 + z * z / all_)
    return (n >= 2) & (low >= share)


def _literals(now: DataFrame, share: float, z: float) -> DataFrame:
    """``now(host, template, segment)`` -> the segments that stay literal at their node, at most 2 / ``share`` a node."""
    counts = staged(now.where("segment is not null").groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n")), "url-counts")
    total = counts.groupBy("host", "template").agg(F.sum("n").alias("all"))
    here = counts.join(total, ["host", "template"]).where(_at_least(F.col("n"), F.col("all"), share, z)).select("host", "template", "segment")
    pooled = counts.groupBy("template", "segment").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("template").agg(F.sum("n").alias("all"))
    common = pooled.join(whole, "template").where(_at_least(F.col("n"), F.col("all"), share, z)).select("template", "segment")
    there = counts.select("host", "template", "segment").join(common, ["template", "segment"], "left_semi")
    return here.unionByName(there).distinct()


def template_tree(
    urls: DataFrame, share: float = 0.05, z: float = 1.96, weight: float = 10.0
) -> tuple[DataFrame, DataFrame]:
    """``urls(key, host, path, label)`` -> ``(templates(key, host, label, template, node), branches)``.

    Level by level, a segment stays literal where it is surely a ``share`` of its node's
    pages, at the host or over the nodes of that name at all hosts, and becomes ``*``
    otherwise; so a small host has the form that its like have elsewhere. A template is a
    path of the tree. A node's pages are done once their path ends, and when all pages of
    its name have the same rest (literal if they are several, else wildcards). Segments
    that all pages of a name share are passed at once, as nothing branches there: so
    levels are branchings, not segments, and no path is cut. In ``node`` such a rest or
    run of segments is one step. ``merge_branches`` then merges alike
    subtrees by their ``evidence``. ``label`` is 1 bad, 0 good, null unknown. Rows of a hot host meet only in sums that are combined before the shuffle, and in
    joins that adaptive execution splits.
    """
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s == "*", "%2A").otherwise(s))
    now = staged(urls.select("key", "host", "label", segments.alias("rest"), F.lit("").alias("template"), F.lit("").alias("node")), "url-segments")
    done = []
    slashed = lambda a: F.array_join(F.transform(a, lambda s: F.concat(F.lit("/"), s)), "")
    open_rest = F.when(F.size("rest") > 0, F.col("rest"))
    # what the least and the greatest of some arrays have in common at their beginning, all have
    common = F.expr("coalesce(nullif(array_position(zip_with(low, high, (a, b) -> a <=> b), false), 0) - 1, size(low), 0)")
    while True:
        rests = now.groupBy("template").agg(
            F.count(F.lit(1)).alias("pages"), (F.min(F.xxhash64("rest")) == F.max(F.xxhash64("rest"))).alias("alike"),
            F.count(open_rest).alias("open"), F.min(open_rest).alias("low"), F.max(open_rest).alias("high"),
        )
        several = F.when(F.col("alike"), F.col("pages") > 1)
        sure = _at_least(F.col("open"), F.greatest("open", F.lit(1)), share, z)
        now = now.join(staged(rests.select("template", several.alias("several"), common.cast("int").alias("common"), sure.alias("sure")), "url-alike"), "template")
        tail = F.transform("rest", lambda s: F.when(F.col("several"), s).otherwise("*"))
        closed = now.where("several is not null or size(rest) = 0").select(
            "key", "host", "label", F.concat("template", slashed(tail)).alias("template"), F.concat("node", F.lit("/"), F.array_join(tail, "\x1f")).alias("node"),
        )
        done.append(closed)
        now = now.where("several is null and size(rest) > 0").withColumn("segment", F.when(F.col("common") == 0, F.col("rest")[0]))
        now = staged(now.drop("several"), "url-open")
        if now.isEmpty():
            break
        literal = _literals(now, share, z).select(F.col("host").alias("h2"), F.col("template").alias("t2"), F.col("segment").alias("s2"))
        one = F.array(F.coalesce("s2", F.lit("*")))
        shared = F.expr("slice(rest, 1, common)")
        step = F.when(F.col("common") == 0, one).when(F.col("sure"), shared).otherwise(F.transform(shared, lambda s: F.lit("*")))
        now = now.join(literal, F.expr("host = h2 and template = t2 and segment = s2"), "left").select(
            "key", "host", "label", F.expr("slice(rest, greatest(common, 1) + 1, size(rest))").alias("rest"),
            F.concat("template", slashed(step)).alias("template"), F.concat("node", F.lit("/"), F.array_join(step, "\x1f")).alias("node"),
        )
        now = staged(now, "url-segments")  # each level reads the one before several times
    templates = staged(reduce(DataFrame.unionByName, done), "url-templates")
    nodes = templates.groupBy("host", "template", "node").agg(
        F.count("label").alias("seen"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")
    )
    return templates, merge_branches(evidence(nodes, weight), z)


def evidence(nodes: DataFrame, weight: float) -> DataFrame:
    """``nodes(host, template, node, seen, bad)`` with what each template is worth on all hosts.

    ``prior`` is the template's rate over all hosts, smoothed by ``weight`` pseudo-pages at
    the rate of all templates beside it, itself smoothed by as many at the overall rate
    (0.5 without labels). A node without labels of its own has those of its template
    elsewhere, for at most ``weight`` pages.
    """
    sums = [F.sum("seen").alias("s"), F.sum("bad").alias("b")]
    smooth = lambda rate: (F.col("b") + weight * F.col(rate)) / (F.col("s") + weight)
    overall = nodes.agg(*sums).select(F.coalesce(F.try_divide("b", "s"), F.lit(0.5)).alias("overall"))
    every = staged(nodes.groupBy("template").agg(*sums).withColumn("beside", F.regexp_replace("template", "/[^/]*$", "")), "url-pooled")
    beside = every.groupBy("beside").agg(F.sum("s").alias("s"), F.sum("b").alias("b")).crossJoin(F.broadcast(overall))  # one row
    beside = beside.select("beside", smooth("overall").alias("rate"))
    lent = F.least(F.col("s"), F.lit(weight))
    prior = every.join(beside, "beside").select(
        "template", smooth("rate").alias("prior"), lent.alias("lent"), F.coalesce(lent * F.try_divide("b", "s"), F.lit(0.0)).alias("lent_bad")
    )
    own = F.col("seen") > 0
    return nodes.join(prior, "template").select(
        "host", "template", "node", F.when(own, F.col("seen")).otherwise(F.col("lent")).alias("seen"),
        F.when(own, F.col("bad")).otherwise(F.col("lent_bad")).alias("bad"), "prior",
    )


def merge_branches(nodes: DataFrame, alike: float = 1.96) -> DataFrame:
    """``nodes(host, template, node, seen, bad, prior)`` -> the same with ``branch``, the merged subtree that a node is in.

    From the bottom up: siblings in order of their rate of bad labels join the group
    before them unless a two-sided z test of two shares at ``alike`` tells them apart;
    those without evidence stand at the rate of all siblings. If all become one group, their parent is a sibling on its own level with their sums;
    otherwise the groups are branches, and nothing above merges with them. A branch is
    named after its first subtree. Pages that end at an inner node are a child of it,
    whose name ends in ``/``. A node's list holds its children only, which ``share`` bounds.
    """
    double = [F.col(c).cast("double").alias(c) for c in ("seen", "bad")]
    leaves = staged(nodes.select("host", "template", "node", *double, "prior", (F.size(F.split("node", "/")) - 1).alias("level")), "url-nodes")
    deepest = leaves.agg(F.max("level")).first()[0] or 1
    parent = F.regexp_replace("node", "/[^/]*$", "").alias("parent")
    told_apart = """coalesce(abs(k.bad / nullif(k.seen, 0) - g.bad / nullif(g.seen, 0)) > {alike} * sqrt(
        (k.bad + g.bad) / (k.seen + g.seen) * (1 - (k.bad + g.bad) / (k.seen + g.seen)) * (1 / k.seen + 1 / g.seen)), false)"""
    last = "element_at(done, -1)"
    apart = told_apart.format(alike=alike).replace("g.", f"{last}.")
    joined = f"named_struct('seen', {last}.seen + k.seen, 'bad', {last}.bad + k.bad, 'nodes', concat({last}.nodes, array(k.node)))"
    alone = "named_struct('seen', k.seen, 'bad', k.bad, 'nodes', array(k.node))"
    in_order = "array_sort(transform(kids, k -> named_struct('rate', coalesce(k.bad / nullif(k.seen, 0), all_rate), 'node', k.node, 'seen', k.seen, 'bad', k.bad)))"
    fold = f"""aggregate({in_order}, cast(array() as array<struct<seen: double, bad: double, nodes: array<string>>>), (done, k) ->
        case when size(done) = 0 then array({alone}) when {apart} then concat(done, array({alone}))
        else concat(slice(done, 1, size(done) - 1), array({joined})) end)"""
    up, closed = None, []
    for level in range(deepest, -1, -1):
        here = leaves.where(F.col("level") == level).select("host", "node", "seen", "bad", F.lit(False).alias("mixed"))
        here = here if up is None else here.unionByName(up)
        if not level:  # the roots: hosts that are one branch
            closed.append(here.where("not mixed").select("host", "node", F.col("node").alias("branch")))
            break
        kids = here.groupBy("host", parent).agg(
            F.max("mixed").alias("mixed"), F.expr("coalesce(sum(bad) / nullif(sum(seen), 0), 0D)").alias("all_rate"),
            F.expr("collect_list(case when not mixed then struct(node, seen, bad) end)").alias("kids"),
        )
        groups = kids.select("host", "parent", "mixed", F.expr(fold).alias("groups"))
        groups = staged(groups.withColumn("mixed", F.expr("mixed or size(groups) > 1")), "url-groups")
        up = groups.select(
            "host", F.col("parent").alias("node"), *(F.expr(f"if(mixed, 0D, groups[0].{c})").alias(c) for c in ("seen", "bad")), "mixed"
        )
        split = groups.where("mixed").select("host", F.explode("groups.nodes").alias("nodes"))
        closed.append(split.select("host", F.explode("nodes").alias("node"), F.array_min("nodes").alias("branch")))
    above = F.expr("transform(sequence(1, level + 1), i -> array_join(slice(split(node, '/'), 1, i), '/'))")
    paths = leaves.select("host", "template", F.col("node").alias("leaf"), "seen", "bad", "prior", F.explode(above).alias("node"))
    found = paths.join(reduce(DataFrame.unionByName, closed), ["host", "node"])
    return found.select("host", "template", F.col("leaf").alias("node"), "seen", "bad", "prior", "branch")


def url_filter(
    pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None,
    least: float = 0.8, weight: float = 10.0, share: float = 0.05, alike: float = 1.96,
) -> DataFrame:
    """``pages`` -> one row per row: id, ``host, path, rule, verdict, template, branch, purity``.

    The longest fitting rule decides; other pages are judged by their template's branch.
    Labels (1 bad, 0 good) come from ``label_col`` or, without one, from the rules'
    verdicts on the pages they fit. The purity of a template is its branch's share of bad
    labels, smoothed by ``weight`` pseudo-pages at the template's ``prior`` over all hosts
    (see ``evidence``); with ``least`` or more its pages are blocked. Null urls and those without ``://`` have empty host and path
    and are judged like any other, as are urls of any length. Rows that repeat count as
    often as they come and get one verdict each; no rows give no rows.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        (F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")).alias("given"),
        host.alias("host"), path.alias("path"),
    ).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("by_rule.verdict") == "block", 1).when(F.col("by_rule.verdict") == "allow", 0)
    key = F.struct("id", "path", F.col("by_rule.rule").alias("rule"), F.col("by_rule.verdict").alias("said"))
    urls = base.select(key.alias("key"), "host", "path", (F.col("given") if label_col else by_rule).alias("label"))
    templates, branches = template_tree(urls, share, alike, weight)
    branches = staged(branches, "url-branches")
    merged = branches.groupBy("host", "branch").agg(F.sum("seen").alias("s"), F.sum("bad").alias("b"))
    purity = (F.col("b") + weight * F.col("prior")) / (F.col("s") + weight)
    scored = branches.join(merged, ["host", "branch"]).select(
        F.col("host").alias("h2"), F.col("node").alias("n2"), "branch", purity.alias("purity")
    )
    out = templates.join(scored, F.expr("host = h2 and node = n2"), "left")
    said = F.coalesce("key.said", F.when(F.col("purity") >= least, "block").otherwise("allow"))
    return out.select(
        F.col("key.id").alias(id_col), "host", F.col("key.path").alias("path"), F.col("key.rule").alias("rule"),
        said.alias("verdict"), "template", "branch", "purity",
    )
