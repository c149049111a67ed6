"""Density-matrix queries: embeddings stand for components, their labels for concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.config import Config
from ..operators import deepen as deepening
from ..operators import density as D
from ..operators import feedback, maps, materialize
from .registry import query, table

#: Thresholds at which the queries have something to tell on these vectors.
CFG = Config(dim=64, consolidation=0.3, contrast_low=0.015, contrast_high=0.0165, deepen_containment=0.6, deepen_top_k=3)


def parts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("concept"), (F.col("vec_id") % 2).alias("space_id"), F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.lit(1.0).alias("w"))


def rhos(spark, sf_dir):
    return D.matrices(parts(spark, sf_dir))


E_SQL = """e AS (SELECT vec_id, label, vec_id % 2 AS space, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), m AS (SELECT label, sum(list_dot_product(v, v)) AS mass, count(*) AS n FROM e GROUP BY label),
    cells AS (SELECT label, space, i, j, sum(v[i] * v[j]) AS val FROM e, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL), rho AS (SELECT label, i, j, sum(val) AS val FROM cells GROUP BY ALL),
    tr AS (SELECT a.label AS a, b.label AS b, sum(a.val * b.val) AS t FROM rho a JOIN rho b USING (i, j) GROUP BY ALL)"""


@query(f"WITH {E_SQL} SELECT label AS concept, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(val + 1e-9, 6) + 0.0 AS val FROM rho")
def rho_entries(spark, sf_dir):
    return D.entries(rhos(spark, sf_dir)).withColumn("val", F.round(F.col("val") + 1e-9, 6) + 0.0)


@query(f"WITH {E_SQL} SELECT label AS concept, n, round(mass, 4) AS mass FROM m")
def mass(spark, sf_dir):
    return D.with_mass(rhos(spark, sf_dir)).select("concept", "n", F.round("mass", 4).alias("mass"))


@query(f"WITH {E_SQL} SELECT label AS concept, round(t / (mass * mass), 8) AS purity FROM tr JOIN m ON m.label = tr.a WHERE a = b")
def purity(spark, sf_dir):
    return D.with_mass(rhos(spark, sf_dir)).select("concept", F.round(D.purity(), 8).alias("purity"))


@query(f"WITH {E_SQL} SELECT a, b, round(t, 5) AS inner FROM tr WHERE a <> b")
def trace_inner(spark, sf_dir):
    return D.pairs(rhos(spark, sf_dir)).select("a", "b", F.round(D.inner(F.col("rho_a"), F.col("rho_b")), 5).alias("inner"))


@query(f"WITH {E_SQL} SELECT a, b, round(t / mass, 6) AS containment FROM tr JOIN m ON m.label = tr.a WHERE a <> b")
def containment(spark, sf_dir):
    return D.pairs(rhos(spark, sf_dir)).select("a", "b", F.round(D.containment(), 6).alias("containment"))


@query(f"WITH {E_SQL} SELECT a, b, round(t / (x.mass * y.mass), 8) AS similarity FROM tr JOIN m x ON x.label = tr.a JOIN m y ON y.label = tr.b WHERE a <> b")
def similarity(spark, sf_dir):
    return D.pairs(rhos(spark, sf_dir)).select("a", "b", F.round(D.similarity(), 8).alias("similarity"))


@query(f"WITH {E_SQL} SELECT a, b, round(t / (x.mass * y.mass), 8) AS similarity FROM tr JOIN m x ON x.label = tr.a JOIN m y ON y.label = tr.b WHERE a < b AND t / (x.mass * y.mass) > 0.015 AND t / (x.mass * y.mass) < 0.0165")
def contrast_pairs(spark, sf_dir):
    return feedback.contrast_pairs(rhos(spark, sf_dir), CFG).withColumn("similarity", F.round("similarity", 8))


@query(f"WITH {E_SQL} SELECT label AS concept, round(mass, 4) AS mass, round(t / (mass * mass), 8) AS purity FROM tr JOIN m ON m.label = tr.a WHERE a = b")
def relation_transform_trace(spark, sf_dir):
    """Turning components by a relation leaves mass and purity as they are."""
    turned = parts(spark, sf_dir).withColumn("vector", vectors.in_role(F.col("vector"), "transform:IsA", CFG.dim))
    return D.with_mass(D.matrices(turned)).select("concept", F.round("mass", 4).alias("mass"), F.round(D.purity(), 8).alias("purity"))


@query(f"WITH {E_SQL}, q AS (SELECT vec_id, e.label AS concept, sum(v[i] * v[j] * val) AS s FROM e JOIN rho ON rho.label = e.label GROUP BY ALL) SELECT vec_id, concept, round(least(1, greatest(0, 1 - s / mass)), 6) AS anomaly FROM q JOIN m ON m.label = q.concept")
def anomaly_batch(spark, sf_dir):
    out = D.anomaly(parts(spark, sf_dir), rhos(spark, sf_dir), CFG.anomaly_min_components)
    return out.select(F.col("seq").alias("vec_id"), "concept", F.round("anomaly", 6).alias("anomaly"))


@query(f"WITH {E_SQL} SELECT label AS concept, round(mass, 4) AS mass FROM m ORDER BY round(mass, 9) DESC, label LIMIT 5")
def mass_topk(spark, sf_dir):
    return deepening.heaviest(rhos(spark, sf_dir), CFG.deepen_min_mass, 5).withColumn("mass", F.round("mass", 4))


FOUND_SQL = f"{E_SQL}, c AS (SELECT a, b, t / mass AS weight FROM tr JOIN m ON m.label = tr.a WHERE a <> b AND t / mass > 0.6), f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(weight, 12) DESC, b) AS r FROM c)"


def found(spark, sf_dir):
    rho = rhos(spark, sf_dir)
    all_ = D.pairs(rho.select("concept", "rho")).select("a", "b")
    return rho, deepening.sources(rho, all_, CFG.deepen_containment, CFG.deepen_top_k)


@query(f"WITH {FOUND_SQL} SELECT a, b, round(weight, 6) AS weight FROM f WHERE r <= 3")
def candidate_topk(spark, sf_dir):
    return found(spark, sf_dir)[1].select("a", "b", F.round("weight", 6).alias("weight"))


def linked(spark, sf_dir):
    """Judgments of vectors: label, a verb, the vector's last digit."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("subject"), F.concat(F.lit("v"), (F.col("vec_id") % 5).cast("string")).alias("verb"), (F.col("vec_id") % 10).cast("string").alias("object"), F.lit(1.0).alias("weight"))


def named(spark, sf_dir):
    return rhos(spark, sf_dir).select(F.col("concept").cast("string").alias("concept"), "n", "rho")


@query(f"""WITH {E_SQL}, heavy AS (SELECT label AS b FROM m ORDER BY round(mass, 9) DESC, label LIMIT 3), l AS (SELECT DISTINCT label, vec_id % 10 AS o FROM embeddings WHERE label <> vec_id % 10 AND vec_id % 100 < 20),
    c AS (SELECT label AS a, o AS b FROM l UNION SELECT o, label FROM l UNION SELECT label, b FROM m, heavy WHERE label <> b), w AS (SELECT a, b, t / mass AS weight FROM c JOIN tr USING (a, b) JOIN m ON m.label = a WHERE t / mass > 0.6 AND a <> 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(weight, 12) DESC, b) AS r FROM w) SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, round(weight, 6) AS weight FROM r WHERE r <= 3""")
def deepen_sources(spark, sf_dir):
    """Sources of all concepts but one, from links of some vectors and the three heaviest concepts."""
    rho, few = named(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 100 < 20").select(F.col("label").cast("string").alias("subject"), F.lit("v").alias("verb"), (F.col("vec_id") % 10).cast("string").alias("object"))
    heavy, goal = deepening.heaviest(rho, CFG.deepen_min_mass, 3), rho.select("concept").where("concept <> '4'")
    near = deepening.candidates(goal, deepening.links(few), heavy)
    return deepening.sources(rho, near, CFG.deepen_containment, CFG.deepen_top_k, heavy, goal).select("a", "b", F.round("weight", 6).alias("weight"))


def perm_sql(role):
    return f"perm AS (SELECT row_number() OVER (ORDER BY md5('{role}:' || i)) AS i, i + 1 AS p, CASE WHEN ('0x' || right(md5('{role}:' || i), 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM range(64) t(i))"


@query(f"""WITH {FOUND_SQL}, {perm_sql("transform:_default")}, s AS (SELECT * FROM f WHERE r <= 3),
    turned AS (SELECT label, x.i AS i, y.i AS j, x.sign * y.sign * val AS val FROM rho JOIN perm x ON x.p = rho.i JOIN perm y ON y.p = rho.j),
    mean AS (SELECT a, i, j, sum(weight * val) / any_value(w) AS val FROM s JOIN turned ON turned.label = s.b JOIN (SELECT a AS wa, sum(weight) AS w FROM s GROUP BY a) ON wa = a GROUP BY a, i, j)
    SELECT rho.label AS concept, CAST(rho.i - 1 AS INTEGER) AS i, CAST(rho.j - 1 AS INTEGER) AS j, round(CASE WHEN mean.val IS NULL THEN rho.val ELSE 0.7 * rho.val + 0.3 * mean.val END + 1e-9, 5) + 0.0 AS val FROM rho LEFT JOIN mean ON mean.a = rho.label AND mean.i = rho.i AND mean.j = rho.j""")
def deepen_one_step(spark, sf_dir):
    rho, near = found(spark, sf_dir)
    return D.entries(deepening.blend(rho, rho, near, None, CFG.deepen_alpha)).withColumn("val", F.round(F.col("val") + 1e-9, 5) + 0.0)


@query(f"""WITH {E_SQL}, sm AS (SELECT label, space, sum(CASE WHEN i = j THEN val ELSE 0 END) AS mass FROM cells GROUP BY ALL), s AS (SELECT a.label AS concept, sum(a.val * b.val) / (any_value(x.mass) * any_value(y.mass)) AS similarity
        FROM cells a JOIN cells b ON a.label = b.label AND a.i = b.i AND a.j = b.j AND a.space = 0 AND b.space = 1 JOIN sm x ON x.label = a.label AND x.space = 0 JOIN sm y ON y.label = a.label AND y.space = 1 GROUP BY a.label),
    r AS (SELECT *, avg(similarity) OVER () AS overall, row_number() OVER (ORDER BY round(similarity, 10), concept) AS up, row_number() OVER (ORDER BY round(similarity, 10) DESC, concept) AS down FROM s)
    SELECT concept, round(similarity, 8) AS similarity, 'divergent' AS kind, CAST(up AS INTEGER) AS rank, round(overall, 8) AS overall FROM r WHERE up <= 4 UNION ALL SELECT concept, round(similarity, 8), 'aligned', CAST(down AS INTEGER), round(overall, 8) FROM r WHERE down <= 4""")
def compare_maps(spark, sf_dir):
    out = maps.compare_maps(D.matrices(parts(spark, sf_dir), ("space_id", "concept")), 0, 1, 4)
    return out.withColumns({c: F.round(c, 8) for c in ("similarity", "overall")})


@query()
def hyponymy(spark, sf_dir):
    return D.hyponymy(D.pairs(rhos(spark, sf_dir)).select("a", "b", "rho_a", "rho_b"))


@query()
def entropy(spark, sf_dir):
    return D.entropy(rhos(spark, sf_dir))


@query()
def facets(spark, sf_dir):
    return D.facets(rhos(spark, sf_dir), CFG.facet_threshold)


@query()
def personal_basis(spark, sf_dir):
    return D.personal_basis(parts(spark, sf_dir), 40)


@query()
def contains(spark, sf_dir):
    return maps.contains(rhos(spark, sf_dir), 3, 5)


@query()
def contained_in(spark, sf_dir):
    return maps.contained_in(rhos(spark, sf_dir), 3, 5)


@query()
def polysemy_ranking(spark, sf_dir):
    return maps.polysemy_ranking(rhos(spark, sf_dir))


@query()
def asymmetry_pairs(spark, sf_dir):
    return maps.asymmetry(rhos(spark, sf_dir))


@query()
def concept_report(spark, sf_dir):
    return maps.concept_report(rhos(spark, sf_dir))


@query()
def graph_view(spark, sf_dir):
    view = deepening.staged(maps.nodes(rhos(spark, sf_dir)))
    return maps.edges(view, CFG.edge_threshold)


@query()
def consolidate_vectors(spark, sf_dir):
    rows = parts(spark, sf_dir).select("space_id", "concept", "seq", F.col("seq").alias("judgment_id"), F.lit("subject").alias("role"), "vector", F.col("w").alias("weight"), F.lit(0.0).alias("ts"))
    return materialize.consolidate(rows, CFG)


@query()
def deepen_k(spark, sf_dir):
    out = deepening.deepen(named(spark, sf_dir), linked(spark, sf_dir), CFG)
    return D.with_mass(out).select("concept", "n", F.round("mass", 6).alias("mass"), F.round(D.purity(), 8).alias("purity"))
