"""URL filters by a path-template tree for each host, in DataFrame operations only.

Explicit rules come first. URLs without a rule are judged by the tree that all URLs build: level by level, a path
segment stays itself if it has paths enough of its own; the rare segments of a node that has many become a wildcard, as
identifiers do, unless a few of them hold all labels. A leaf of the tree is a template. Labels, given or else what the
rules say, are counted for each template and for its generalisations: the branches of one node that go on alike, that
is, the templates that differ from it in one segment. Of those that go on alike below the host, templates with labels are
merged where their shares of blocked ones don't differ significantly. A template's purity is its share of blocked
labels, smoothed towards what its generalisations expect, the widest first: there, rows without labels count as part
of a label of the expectation so far, so that a template without labels is rejected only where what is labelled of
branches like it is large enough to speak for them all. Templates are rejected from a purity of THRESHOLD on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, pick, stage

#: Verdict, host and path prefix of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Levels that every path has; deeper ones only frequent segments have, rare ones become one tail. Children of a node
#: beyond which its rare segments are wildcards, and paths from which a segment is frequent.
DEPTH, FANOUT, MIN_PATHS = 4, 8, 5
#: Smoothing: so many blocked and allowed labels are expected of a host before any are seen, and an
#: expectation weighs as many; templates from THRESHOLD on are rejected.
PLUS_BLOCKED, PLUS_ALLOWED, THRESHOLD = 1.0, 2.0, 0.5
#: Share of a label that a row without one counts for in what is expected of templates like it.
BARE = 0.5
#: Rare segments that stay themselves if they hold all labels of a node: fewer than so many. Deviation in standard
#: errors from which branches differ.
MIN_LABELS, DIFFER = 5, 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), upper, upper.lower()), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. A rule fits its host and all subdomains."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """The path's segments, identifiers as wildcards: those with a digit, keeping what follows the last dot."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s))


def grow(paths: DataFrame, depth: int, fanout: int, min_paths: int = MIN_PATHS) -> DataFrame:
    """Adds template to paths(host, segs, n, labelled): the tree's levels, one after another, while paths have more.

    A node's rare children become one wildcard, those of a node at `depth` with all that follows. If fewer than
    MIN_LABELS of them hold all their labels, these stay themselves, so that the others don't inherit their labels. The
    wildcard has another name beside the one of identifiers.
    """
    tree = paths.withColumn("template", F.col("host"))
    done, level = [], 0
    while total := tree.where(F.size("segs") > level).count():
        ended = tree.where(F.size("segs") <= level)
        done.append(ended)
        tree = tree.where(F.size("segs") > level).withColumn("seg", F.element_at("segs", level + 1))
        children = tree.groupBy("template", "seg").agg(F.count("*").alias("rows"), (F.sum("labelled") > 0).alias("known"))
        rare = (F.col("rows") < min_paths) & ((F.col("seg") != "*") | F.lit(level >= depth))
        children = stage(children.withColumn("rare", rare), "children")
        count = {"children": F.lit(True), "with": F.col("rare") & F.col("known"), "bare": F.col("rare") & ~F.col("known"), "ids": F.col("seg") == "*"}
        nodes = children.groupBy("template").agg(*[F.count_if(c).alias(k) for k, c in count.items()], F.sum("rows").alias("all")).withColumnRenamed("template", "node")
        nodes = lookup(children.withColumnRenamed("template", "node"), stage(nodes, "nodes"), ["node"], "children", children.count(), F.xxhash64("seg"))
        own = F.col("known") & (F.col("bare") > 0) & (F.col("with") < MIN_LABELS)
        many = F.lit(True) if level >= depth else F.col("children") > fanout
        wild = F.lit("**") if level >= depth else F.when(F.col("ids") > 0, "*w").otherwise("*")
        named = nodes.select(F.col("node").alias("template"), "seg", "rows", F.when(F.col("rare") & many & ~own, wild).otherwise(F.col("seg")).alias("name"))
        tree = lookup(tree, stage(named, "named"), ["template", "seg"], "rows", total, F.xxhash64("segs"))
        tree = tree.withColumn("template", F.concat("template", F.lit("/"), "name"))
        tree = stage(tree.withColumn("tail", F.col("name") == "**").drop("seg", "rows", "name"), f"tree{level}")
        done.append(tree.where("tail").drop("tail"))
        tree, level = tree.where("not tail").drop("tail"), level + 1
    done.append(tree)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def merged_branches(leaves: DataFrame, differ: float = DIFFER) -> DataFrame:
    """(wide, blocked, labelled, b, l): the labels b of l with which each of leaves(wide, blocked, labelled) is judged.

    Leaves of one `wide` are ordered by their smoothed share; one starts a new branch where it differs from the one
    before by `differ` standard errors. Leaves with the same labels are one row there, which bounds a group's rows.
    """
    n = F.col("labelled") + PLUS_BLOCKED + PLUS_ALLOWED
    many = leaves.where("labelled > 0").groupBy("wide", "blocked", "labelled").agg(F.count("*").alias("alike"))
    many = many.withColumn("share", (F.col("blocked") + PLUS_BLOCKED) / n).withColumn("error", F.col("share") * (1 - F.col("share")) / n)
    order = W.partitionBy("wide").orderBy("share", "labelled")
    apart = (F.col("share") - F.lag("share").over(order)) > differ * F.sqrt(F.col("error") + F.lag("error").over(order))
    branch = many.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("branch", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    both = W.partitionBy("wide", "branch")
    pooled = [F.sum(F.col(c) * F.col("alike")).over(both).alias(a) for c, a in (("blocked", "b"), ("labelled", "l"))]
    return branch.select("wide", "blocked", "labelled", *pooled)


def generalised(template: Column) -> Column:
    """The template with its 2nd, 3rd, ... segment left open, the host being the first; and at last the template itself."""
    parts = F.split(template, "/")
    size = F.size(parts)

    def opened(i: Column) -> Column:
        return F.array_join(F.concat(F.slice(parts, F.lit(1), i), F.array(F.lit("?")), F.slice(parts, i + 2, size)), "/")

    return F.concat(F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), opened)).otherwise(F.array().cast("array<string>")), F.array(template))


def judge(templates: DataFrame, differ: float = DIFFER, threshold: float = THRESHOLD) -> DataFrame:
    """(template, purity, rejected) of templates(template, n, blocked, labelled)."""
    templates = stage(templates, "templates")
    lines = stage(templates.select("*", F.posexplode(generalised(F.col("template"))).alias("level", "node")), "lines")
    nodes = lines.groupBy("node").agg(F.count("*").alias("under"), *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    wide = templates.withColumn("wide", F.element_at(generalised(F.col("template")), 1))
    pools = merged_branches(wide, differ).toDF("w", "x", "y", "b", "l")
    own = wide.join(pools, (F.col("wide") == F.col("w")) & (F.col("blocked") == F.col("x")) & (F.col("labelled") == F.col("y"))).select(F.col("template").alias("t"), "b", "l")
    judged = nodes.join(own, F.col("node") == F.col("t"), "left")
    bare = BARE * (F.col("n") - F.col("labelled"))
    counts = F.struct(F.coalesce("b", "blocked").alias("b"), F.coalesce("l", "labelled").alias("l"), bare.alias("bare"))
    judged = stage(judged.select("node", "under", counts.alias("counts")), "judged")
    met = lookup(lines.select("template", "level", "node"), judged, ["node"], "under", lines.count(), F.xxhash64("template"))
    weight, base = PLUS_BLOCKED + PLUS_ALLOWED, PLUS_BLOCKED / (PLUS_BLOCKED + PLUS_ALLOWED)

    def down(state: Column, line: Column) -> Column:
        c, expected = line["counts"], state["expected"]
        purity = (c["b"] + weight * expected) / (c["l"] + weight)
        below = (c["b"] + (weight + c["bare"]) * expected) / (c["l"] + weight + c["bare"])
        return F.struct(below.alias("expected"), purity.alias("purity"))

    line = F.sort_array(F.collect_list(F.struct("level", "counts")))  # one for each segment of the template
    start = F.struct(F.lit(base).alias("expected"), F.lit(base).alias("purity"))
    out = met.groupBy("template").agg(line.alias("line")).select("template", F.aggregate("line", start, down, lambda s: s["purity"]).alias("purity"))
    return out.select("template", "purity", (F.col("purity") >= threshold).alias("rejected"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, depth: int = DEPTH, fanout: int = FANOUT) -> DataFrame:
    """Judges every url of pages(page_id, url).

    Returns one row for each input row: page_id, host, path, rule, verdict, template, purity. labels(page_id, blocked 0/1)
    train the tree; without them the rules' verdicts do. A null url or one without "://" has empty host and path
    and the template of the empty host; a null page_id is kept; repeated rows count as often as they occur; an empty
    table gives an empty result; other columns are ignored. Rules are a short list and become one expression.
    """
    rows = pick(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", ruled(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    if labels is None:
        rows = rows.withColumn("blocked", (F.col("ruled.verdict") == "block").cast("int"))
    else:
        known = pick(labels, "page_id", "blocked").where("blocked is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked")).withColumnRenamed("page_id", "p")
        rows = rows.join(known, F.col("page_id") == F.col("p"), "left").drop("p")
    rows = stage(rows.withColumn("joined", F.array_join("segs", "/")), "urls")
    paths = rows.groupBy("host", "joined").agg(F.first("segs").alias("segs"), F.count("*").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"), F.count("blocked").alias("labelled"))
    tree = stage(grow(stage(paths, "paths"), depth, fanout), "tree")
    templates = tree.groupBy("template").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    verdicts = judge(templates)
    leaves = tree.join(verdicts.withColumnRenamed("template", "t"), F.col("template") == F.col("t")).select("host", "joined", "n", "template", "purity", "rejected")
    out = lookup(rows, stage(leaves, "leaves"), ["host", "joined"], "n", rows.count(), F.xxhash64("page_id"))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
