"""Queries over concepts: containment, polysemy, comparison of maps, reports, graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import density as D


def against(rhos: DataFrame, term, contains: bool) -> DataFrame:
    """(concept, score) of every other concept: how far it lies in term, or term in it."""
    one = D.with_mass(rhos.where(F.col("concept") == F.lit(term))).select(F.lit(1).alias("_one"), F.col("rho").alias("x"), F.col("mass").alias("mass_x"))
    rest = D.with_mass(rhos.where(F.col("concept") != F.lit(term))).select(F.lit(1).alias("_one"), "concept", F.col("rho").alias("y"), F.col("mass").alias("mass_y"))
    both = rest.join(F.broadcast(one), "_one")  # one row: the term's matrix
    a, b = ("y", "x") if contains else ("x", "y")
    return D.per_matrix(both.select("concept", F.col(a).alias("rho_a"), F.col(b).alias("rho_b")), D.hyponymy_kernel, "score", ("rho_a", "rho_b"))


def contains(rhos: DataFrame, term, k: int = 10) -> DataFrame:
    """The k concepts that lie furthest in term."""
    return against(rhos, term, True).orderBy(F.desc("score"), "concept").limit(k)


def contained_in(rhos: DataFrame, term, k: int = 10) -> DataFrame:
    """The k concepts in which term lies furthest."""
    return against(rhos, term, False).orderBy(F.desc("score"), "concept").limit(k)


def polysemy_ranking(rhos: DataFrame, least: int = 3, k: int = 15) -> DataFrame:
    return D.entropy(rhos.where(F.col("n") >= least)).select("concept", "entropy").orderBy(F.desc("entropy"), "concept").limit(k)


def richness(parts: DataFrame, k: int | None = None) -> DataFrame:
    """Concepts by number of components."""
    out = parts.groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept")
    return out.limit(k) if k else out


def asymmetry(rhos: DataFrame, k: int = 8, reach: int = 3, least: float = 0.01) -> DataFrame:
    """Pairs of the k richest concepts, up to `reach` ranks apart, whose containment differs by direction."""
    ranked = rhos.orderBy(F.desc("n"), "concept").limit(k).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "concept")))
    a = ranked.select(F.col("concept").alias("a"), F.col("r").alias("ra"), F.col("rho").alias("rho_a"))
    b = ranked.select(F.col("concept").alias("b"), F.explode(F.sequence(F.col("r") - reach, F.col("r") - 1)).alias("ra"), F.col("rho").alias("rho_b"))
    both = a.join(b, "ra").withColumn("x", F.col("rho_a")).withColumn("y", F.col("rho_b"))
    one = D.hyponymy(both, "ab").withColumnsRenamed({"x": "rho_b", "y": "rho_a"})
    return D.hyponymy(one.select("a", "b", "ab", "rho_a", "rho_b"), "ba").where(F.abs(F.col("ab") - F.col("ba")) > least).select("a", "b", "ab", "ba")


def compare_maps(rhos: DataFrame, one, other, k: int = 20) -> DataFrame:
    """Shared concepts of two maps by similarity: (concept, similarity, kind, rank, overall); kind is divergent for the k least
    alike and aligned for the k most alike, overall the mean of all. rhos: space_id, concept, rho."""
    m = D.with_mass(rhos)
    a = m.where(F.col("space_id") == one).select("concept", F.col("rho").alias("rho_a"), F.col("mass").alias("mass_a"))
    b = m.where(F.col("space_id") == other).select("concept", F.col("rho").alias("rho_b"), F.col("mass").alias("mass_b"))
    shared = a.join(b, "concept").select("concept", D.similarity().alias("similarity"))
    overall = shared.agg(F.avg("similarity").alias("overall")).withColumn("_one", F.lit(1))
    key = F.round("similarity", 10)
    far = shared.orderBy(key, "concept").limit(k).select("*", F.lit("divergent").alias("kind"), F.row_number().over(W.orderBy(key, "concept")).alias("rank"))
    near = shared.orderBy(F.desc(key), "concept").limit(k).select("*", F.lit("aligned").alias("kind"), F.row_number().over(W.orderBy(F.desc(key), "concept")).alias("rank"))
    return far.unionByName(near).withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one").drop("_one")


def concept_report(rhos: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(concept, n, mass, entropy, purity, facets) of every concept."""
    m = D.with_mass(rhos).withColumn("purity", D.purity())
    counts = D.facets(rhos, threshold).groupBy("concept").agg(F.count("*").alias("facets"))
    return D.entropy(m).join(counts, "concept", "left").select("concept", "n", "mass", "entropy", "purity", F.coalesce("facets", F.lit(0)).alias("facets"))


def containers(rhos: DataFrame, term, verbs: DataFrame, k: int = 10, nouns: int = 5, most_verbs: int = 3) -> DataFrame:
    """(direction, is_verb, concept, score, rank): what a term contains and what contains it, as a report shows it: of the k
    best of each direction the first `nouns` that aren't verbs and the first `most_verbs` that are. verbs: concept."""
    both = contains(rhos, term, k).withColumn("direction", F.lit("contains")).unionByName(contained_in(rhos, term, k).withColumn("direction", F.lit("contained_in")))
    known = verbs.select("concept").distinct().withColumn("_v", F.lit(True))
    rows = both.join(known, "concept", "left").withColumn("is_verb", F.coalesce("_v", F.lit(False)))
    best = D.top(rows, ["direction", "is_verb"], [F.desc("score"), F.col("concept")], k)
    return best.where(F.col("rank") <= F.when(F.col("is_verb"), most_verbs).otherwise(nouns)).select("direction", "is_verb", "concept", "score", "rank")


def self_report(judgments: DataFrame, k: int = 15) -> DataFrame:
    """The first k different (verb, object) of judgments(seq, verb, object) about oneself."""
    first = judgments.groupBy("verb", "object").agg(F.min("seq").alias("seq"))
    return first.orderBy("seq", "verb", "object").limit(k)


def nodes(rhos: DataFrame, least: int = 3, k: int = 50) -> DataFrame:
    """(concept, n, mass, entropy, rho) of the k richest concepts: the nodes of a view."""
    best = rhos.where(F.col("n") >= least).orderBy(F.desc("n"), "concept").limit(k).withColumn("_r", F.col("rho"))
    return D.entropy(D.with_mass(best)).withColumnRenamed("_r", "rho")


def edges(view: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(a, b, weight): ordered pairs of a view's nodes with hyponymy above the threshold. A view has at most `k` nodes."""
    rows = D.hyponymy(D.pairs(view.select("concept", "rho")).select("a", "b", F.col("rho_b").alias("rho_a"), F.col("rho_a").alias("rho_b")), "weight")
    return rows.withColumn("weight", F.round("weight", 3)).where(F.col("weight") > threshold)


def degrees(links: DataFrame, k: int = 8) -> DataFrame:
    """The k nodes of most incoming and of most outgoing weight: (direction, node, degree, rank). links: a, b, weight."""
    out = links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")).withColumn("direction", F.lit("out"))
    into = links.groupBy(F.col("b").alias("node")).agg(F.sum("weight").alias("degree")).withColumn("direction", F.lit("in"))
    return D.top(out.unionByName(into), ["direction"], [F.desc(F.round("degree", 6)), F.col("node")], k).select("direction", "node", "degree", "rank")


def strongest(links: DataFrame, k: int = 10) -> DataFrame:
    """The k edges of most weight."""
    return links.orderBy(F.desc("weight"), "a", "b").limit(k)


def graph_counts(links: DataFrame) -> DataFrame:
    """One row: numbers of nodes with an edge and of edges."""
    nodes_ = links.select(F.explode(F.array("a", "b")).alias("n")).agg(F.countDistinct("n").alias("nodes")).withColumn("_one", F.lit(1))
    return nodes_.join(links.agg(F.count("*").alias("edges")).withColumn("_one", F.lit(1)), "_one").drop("_one")


def ego(links: DataFrame, node, threshold: float = 0.2) -> DataFrame:
    """(a, b, weight, kind): edges to children and from parents of a node, parents that are children left out, and edges
    among its neighbours."""
    strong = links.where(F.col("weight") >= threshold)
    child = strong.where(F.col("a") == F.lit(node)).select("a", "b", "weight", F.lit("child").alias("kind"))
    parent = strong.where(F.col("b") == F.lit(node)).join(child.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b", "weight", F.lit("parent").alias("kind"))
    near = child.select(F.col("b").alias("n")).unionByName(parent.select(F.col("a").alias("n"))).distinct()
    cross = strong.where((F.col("a") != F.lit(node)) & (F.col("b") != F.lit(node))).join(near, F.col("a") == F.col("n"), "left_semi").join(near, F.col("b") == F.col("n"), "left_semi")
    return child.unionByName(parent).unionByName(cross.select("a", "b", "weight", F.lit("cross").alias("kind")))


def panel(links: DataFrame, threshold: float = 0.2, k: int = 15) -> DataFrame:
    """(node, direction, other, weight, rank): each node's k strongest edges either way."""
    strong = links.where(F.col("weight") >= threshold)
    both = strong.select(F.col("a").alias("node"), F.lit("contains").alias("direction"), F.col("b").alias("other"), "weight").unionByName(strong.select(F.col("b").alias("node"), F.lit("contained_in").alias("direction"), F.col("a").alias("other"), "weight"))
    return D.top(both, ["node", "direction"], [F.desc("weight"), F.col("other")], k)


def provenance(judgments: DataFrame, most: int = 200) -> DataFrame:
    """The first judgment of each (concept, subject, verb, object, quality), its text cut to `most` characters."""
    key = ["concept", "subject", "verb", "object", "quality"]
    rest = [c for c in judgments.columns if c not in (*key, "seq")]
    cut = judgments.withColumn("source_text", F.substring("source_text", 1, most))
    first = cut.groupBy(*key).agg(F.min_by(F.struct("seq", *rest), "seq").alias("_first"))  # combined before the shuffle
    return first.select(*key, "_first.*").select(*judgments.columns)


def panel_judgments(judgments: DataFrame, badge: float = 0.85) -> DataFrame:
    """What a node's panel shows of its judgments, each once (`provenance`): the columns given, kind (anomaly, negative, conditional
    or plain, the first that holds), anomaly_percent (null below the badge), layer (null at 0) and confirmation (confirmed or
    rejected, else null).

    judgments: as for `provenance`, with anomaly, condition_id, interpretation_layer and status; nulls count as nothing to show.
    """
    strange = F.col("anomaly") >= badge
    kind = F.when(strange, "anomaly").when(F.col("quality") == "NEGATIVE", "negative").when(F.col("condition_id").isNotNull(), "conditional").otherwise("plain")
    return provenance(judgments).select(
        *judgments.columns, kind.alias("kind"), F.when(strange, F.round(F.col("anomaly") * 100)).cast("int").alias("anomaly_percent"),
        F.when(F.col("interpretation_layer") > 0, F.col("interpretation_layer")).alias("layer"), F.when(F.col("status").isin("confirmed", "rejected"), F.col("status")).alias("confirmation"))


def corpus_stats(judgments: DataFrame) -> DataFrame:
    """One row of statistics of judgments(subject, verb, object, quality, modality, confidence, anomaly)."""
    terms = judgments.select(F.explode(F.array("subject", "verb", "object")).alias("t")).agg(F.countDistinct("t").alias("terms"))
    facts = judgments.agg(
        F.count("*").alias("judgments"), F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"),
        F.percentile("confidence", 0.5).alias("confidence_median"), F.count_if(F.col("confidence") < 0.5).alias("under_50"), F.count_if(F.col("confidence") < 0.7).alias("under_70"),
        F.count_if(F.col("quality") == "NEGATIVE").alias("negative"), F.count_if(F.col("anomaly") > 0.7).alias("anomalous"), F.count_if(F.col("anomaly") > 0.85).alias("very_anomalous"))
    return facts.withColumn("_one", F.lit(1)).join(terms.withColumn("_one", F.lit(1)), "_one").drop("_one")


def modality_buckets(judgments: DataFrame) -> DataFrame:
    bucket = F.when(F.col("modality") >= 0.9, "factual").when(F.col("modality") > 0.4, "epistemic").otherwise("conditional")
    return judgments.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == "NEGATIVE").alias("negative"))


def per_sender(judgments: DataFrame) -> DataFrame:
    """judgments once in their sender's map and once in the map of all: space_id is the sender or 'all'."""
    return judgments.withColumn("space_id", F.explode(F.array(F.col("sender").cast("string"), F.lit("all"))))


def pmi(judgments: DataFrame) -> DataFrame:
    """(subject, object, n, pmi): pointwise mutual information of subjects and objects."""
    pair = judgments.groupBy("subject", "object").agg(F.count("*").alias("n"))
    s, o = judgments.groupBy("subject").agg(F.count("*").alias("ns")), judgments.groupBy("object").agg(F.count("*").alias("no"))
    total = judgments.agg(F.count("*").alias("all")).withColumn("_one", F.lit(1))
    rows = pair.join(s, "subject").join(o, "object").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return rows.select("subject", "object", "n", F.log(F.col("n") * F.col("all") / (F.col("ns") * F.col("no"))).alias("pmi"))


def user_tau(messages: DataFrame, factor: float = 100.0) -> DataFrame:
    """(sender, tau): a hundred times the median gap between a sender's messages. messages: sender, ts."""
    gap = F.col("ts") - F.lag("ts").over(W.partitionBy("sender").orderBy("ts"))
    return messages.withColumn("gap", gap).where("gap is not null").groupBy("sender").agg((F.percentile("gap", 0.5) * factor).alias("tau"))


def self_node(view: DataFrame, name: str = "[self]") -> DataFrame:
    """The node of oneself, if the map has one."""
    return view.where(F.col("concept") == F.lit(name))


def at_least(links: DataFrame, threshold: float) -> DataFrame:
    """Edges of at least this weight, as a threshold slider shows them."""
    return links.where(F.col("weight") >= threshold)
