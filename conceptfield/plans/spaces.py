"""Queries on senses and product spaces: customers and embeddings stand for components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.config import Config
from ..functions.shared import dealt
from ..operators import density as D
from ..operators import factors, senses, tensor
from .density import parts
from .judgments import AS_OF, JUDGMENTS_SQL, judgments
from .registry import query, table

#: Coordinates of the spaces that an embedding is cut into.
DIMS = (52, 8, 4)
MAP = Config(as_of=AS_OF, dim=16)


def markets(spark, sf_dir):
    """Components of a nation, and of a market segment: the segment's vector, a little turned for each customer."""
    c, dim = dealt(table(spark, sf_dir, "customer"), "c_custkey"), 100
    terms = c.select("c_mktsegment").distinct().select("c_mktsegment", vectors.hash_vector(F.col("c_mktsegment"), dim).alias("s"))
    own = F.transform(vectors.hash_vector(F.col("c_name"), dim), lambda x: 0.3 * x)
    rows = c.join(terms, "c_mktsegment").withColumn("vector", vectors.unit(F.zip_with("s", own, lambda a, b: a + b)))
    concept = F.explode(F.array(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.concat(F.lit("market "), "c_mktsegment")))
    return rows.select(concept.alias("concept"), "c_custkey", "c_mktsegment", "vector", F.lit(1.0).alias("w"))


@query("""SELECT 'nation ' || c_nationkey AS concept, count(*) AS n, CAST(count(DISTINCT c_mktsegment) AS INTEGER) AS senses, count(DISTINCT c_mktsegment) > 1 AS potential_homonym FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'market ' || c_mktsegment, count(*), 1, false FROM customer GROUP BY c_mktsegment""")
def potential_homonyms(spark, sf_dir):
    """Nations have a sense for each market of their customers, a market has one."""
    return senses.potential_homonyms(markets(spark, sf_dir), facet=0.02, share=0.0, least=1).select("concept", "n", "senses", "potential_homonym")


@query("""WITH g AS (SELECT 'nation ' || c_nationkey AS concept, c_mktsegment AS market, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'market ' || c_mktsegment, c_mktsegment, count(*) FROM customer GROUP BY ALL)
    SELECT concept, CAST(row_number() OVER (PARTITION BY concept ORDER BY n DESC, market) AS INTEGER) AS place, n, round(n / sum(n) OVER (PARTITION BY concept), 6) AS share, 1::BIGINT AS markets FROM g""")
def sense_members(spark, sf_dir):
    """Sizes of senses, largest first, and how many markets are in each."""
    rows = senses.members(markets(spark, sf_dir), facet=0.02)[0].where("sense IS NOT NULL")
    sizes = rows.groupBy("concept", "sense").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w"), F.countDistinct("c_mktsegment").alias("markets"))
    masses = senses.sense_masses(rows).select("concept", "sense", F.round("share", 6).alias("share"))
    return sizes.join(masses, ["concept", "sense"]).select("concept", F.col("sense").alias("place"), "n", "share", "markets")


def cut(spark, sf_dir):
    """Embeddings as components over three spaces."""
    a, b, c = DIMS
    v = F.col("vector")
    return parts(spark, sf_dir).select("concept", "seq", F.slice(v, 1, a).alias("semantic"), F.slice(v, 1 + a, b).alias("relational"), F.slice(v, 1 + a + b, c).alias("contextual"), "w")


CUT_SQL = """e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), p AS (SELECT vec_id, label, v[1:52] AS s, v[53:60] AS r, v[61:64] AS c FROM e)"""


@query(f"WITH {CUT_SQL} SELECT label AS concept, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(s[i] * s[j] * list_dot_product(r, r) * list_dot_product(c, c)) + 1e-9, 8) + 0.0 AS val FROM p, range(1, 53) a(i), range(1, 53) b(j) GROUP BY ALL")
def partial_trace_semantic(spark, sf_dir):
    """Meaning alone, relation and context traced out."""
    return D.entries(tensor.partial_trace(cut(spark, sf_dir), ["semantic"])).withColumn("val", F.round(F.col("val") + 1e-9, 8) + 0.0)


@query(f"""WITH {CUT_SQL} SELECT label AS concept, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(list_dot_product(s, s) * r[i // 4 + 1] * c[i % 4 + 1] * r[j // 4 + 1] * c[j % 4 + 1]) + 1e-9, 8) + 0.0 AS val
    FROM p, range(32) a(i), range(32) b(j) GROUP BY ALL""")
def partial_trace_relation_context(spark, sf_dir):
    """Relation and context together, meaning traced out."""
    return D.entries(tensor.partial_trace(cut(spark, sf_dir), ["relational", "contextual"])).withColumn("val", F.round(F.col("val") + 1e-9, 8) + 0.0)


@query(f"""WITH {CUT_SQL}, g AS (SELECT label * 10 + vec_id % 10 AS g, s, r, c, list_dot_product(s, s) * list_dot_product(r, r) * list_dot_product(c, c) AS q FROM p), m AS (SELECT g, sum(q) AS mass FROM g GROUP BY g),
    t AS (SELECT x.g AS a, y.g AS b, sum((list_dot_product(x.s, y.s) * list_dot_product(x.r, y.r) * list_dot_product(x.c, y.c)) ** 2) AS t FROM g x JOIN g y ON x.g < y.g AND x.g // 10 = y.g // 10 GROUP BY ALL)
    SELECT a, b, round(t / (x.mass * y.mass), 8) AS similarity, true AS enclosed FROM t JOIN m x ON x.g = a JOIN m y ON y.g = b""")
def tensor_similarity(spark, sf_dir):
    """Likeness of the parts of a label over the product of three spaces, and whether sketches of rank 12 enclose it."""
    rows = cut(spark, sf_dir).withColumn("concept", F.col("concept") * 10 + F.col("seq") % 10).withColumn("label", F.floor(F.col("concept") / 10))
    names = rows.select("concept").distinct()
    pairs = names.select(F.col("concept").alias("a")).join(names.select(F.col("concept").alias("b")), (F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10)) & (F.col("a") < F.col("b")))  # ten parts of a label
    whole = tensor.products(rows, "label").select("a", "b", factors.alike().alias("similarity"))
    some = factors.inner(factors.joined(tensor.sketches(rows, 12), pairs), 12).select("a", "b", factors.alike().alias("low"), factors.alike("inner_most").alias("high"))
    enclosed = (F.col("low") <= F.col("similarity") + 1e-9) & (F.col("high") >= F.col("similarity") - 1e-9)
    return whole.join(some, ["a", "b"]).select("a", "b", F.round("similarity", 8).alias("similarity"), enclosed.alias("enclosed"))


@query(f"""WITH {JUDGMENTS_SQL}, f AS (SELECT object AS concept, 0.5 * w AS w, CASE WHEN quality = 'NEGATIVE' THEN [0.0, 1.0] ELSE [1.0, 0.0] END AS q, [sqrt(modality), sqrt(1 - modality)] AS m, power(1 + greatest(0, {AS_OF} - t) / 2592000.0, -0.5) AS h FROM b
    UNION ALL SELECT subject, w, CASE WHEN quality = 'NEGATIVE' THEN [0.0, 1.0] ELSE [1.0, 0.0] END, [sqrt(modality), sqrt(1 - modality)], power(1 + greatest(0, {AS_OF} - t) / 2592000.0, -0.5) FROM b),
    k AS (SELECT concept, w, [q[i // 4 + 1] * m[i // 2 % 2 + 1] * CASE WHEN i % 2 = 0 THEN sqrt(h) ELSE sqrt(1 - h) END FOR i IN range(8)] AS c FROM f)
    SELECT concept, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(w * c[i] * c[j]) + 1e-9, 6) + 0.0 AS val FROM k, range(1, 9) x(i), range(1, 9) y(j) GROUP BY ALL""")
def partial_trace_context(spark, sf_dir):
    """In what context concepts are spoken of: quality, modality and time, from judgments."""
    rows = tensor.components(judgments(spark, sf_dir), MAP)
    return D.entries(tensor.partial_trace(rows, ["contextual"])).withColumn("val", F.round(F.col("val") + 1e-9, 6) + 0.0)


@query()
def context_dependence(spark, sf_dir):
    """How much relation and context tell of one another, by label."""
    rows = tensor.dependence(cut(spark, sf_dir), "relational", "contextual")
    return rows.select("concept", "n", *[F.round(c, 6).alias(c) for c in ("entropy_first", "entropy_second", "entropy_both", "dependence")])
