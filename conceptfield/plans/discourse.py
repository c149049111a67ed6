"""Queries of pronouns in conversations of sentences made of events, and of rankings of compared parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discourse
from .language import TOKENS_SQL, sentences
from .registry import query, table

CHATS, REACH = 20, 3


def spoken(spark, sf_dir):
    """Tokens in conversations: sentence s is sentence s // CHATS of chat s % CHATS. Nouns agree by their last letter."""
    s = sentences(spark, sf_dir)
    rows = s.select((F.col("sent_id") % CHATS).alias("chat"), F.floor(F.col("sent_id") / CHATS).alias("seq"), F.explode("tokens").alias("t"))
    return rows.select("chat", "seq", F.col("t.i").alias("i"), "t.lemma", "t.pos", F.when(F.col("t.lemma").rlike("[ая]$"), "f").otherwise("m").alias("agreement"))


@query(f"""WITH {TOKENS_SQL}, k AS (SELECT s % {CHATS} AS chat, s // {CHATS} AS seq, i, lemma, pos, CASE WHEN regexp_matches(lemma, '[ая]$') THEN 'f' ELSE 'm' END AS agreement FROM t),
    p AS (SELECT * FROM k WHERE pos = 'PRON' AND lemma = 'он'),
    c AS (SELECT p.chat, p.seq, p.i, count(DISTINCT m.lemma) AS n, min(m.lemma) AS term FROM p JOIN k m ON m.chat = p.chat AND m.agreement = p.agreement AND m.pos = 'NOUN' AND m.seq BETWEEN p.seq - {REACH} AND p.seq AND (m.seq < p.seq OR m.i < p.i) GROUP BY ALL)
    SELECT p.chat, p.seq, p.i, CAST(least(coalesce(n, 0), 2) AS INTEGER) AS found, CASE WHEN n = 1 THEN term ELSE '' END AS term FROM p LEFT JOIN c ON c.chat = p.chat AND c.seq = p.seq AND c.i = p.i""")
def anaphora(spark, sf_dir):
    t = spoken(spark, sf_dir)
    he = t.where((F.col("pos") == "PRON") & (F.col("lemma") == "он")).select("chat", "seq", "i", "agreement")
    named = t.where(F.col("pos") == "NOUN").select("chat", "seq", "i", "agreement", F.col("lemma").alias("term"))
    return discourse.resolved(he, named, REACH).select("chat", "seq", "i", "found", F.coalesce("term", F.lit("")).alias("term"))


def compared(spark, sf_dir):
    """Each part's type is above that of the part before it if it costs more, within brands."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", F.col("p_brand").alias("dimension"))
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_type").alias("b"), F.col("p_retailprice").alias("less"))
    sign = F.when(F.col("p_retailprice") > F.col("less"), ">").when(F.col("p_retailprice") < F.col("less"), "<").otherwise("=")
    return p.join(before, "p_partkey").select(F.col("p_type").alias("a"), "b", "dimension", sign.alias("comparator"))


COMPARED_SQL = """c AS (SELECT p.p_type AS a, q.p_type AS b, p.p_brand AS dimension, sign(p.p_retailprice - q.p_retailprice) AS v FROM part p JOIN part q ON q.p_partkey = p.p_partkey - 1 WHERE p.p_type <> q.p_type),
    votes AS (SELECT dimension, least(a, b) AS x, greatest(a, b) AS y, sum(CASE WHEN a < b THEN v ELSE -v END) AS n FROM c GROUP BY ALL),
    e AS (SELECT dimension, CASE WHEN n > 0 THEN x ELSE y END AS a, CASE WHEN n > 0 THEN y ELSE x END AS b FROM votes WHERE n <> 0)"""


@query(f"WITH {COMPARED_SQL} SELECT dimension, a, b FROM e")
def comparison_edges(spark, sf_dir):
    return discourse.above(discourse.comparisons(compared(spark, sf_dir)))


@query(f"""WITH RECURSIVE {COMPARED_SQL}, r AS (SELECT dimension, a, b FROM e UNION SELECT r.dimension, r.a, e.b FROM r JOIN e ON r.dimension = e.dimension AND r.b = e.a),
    term AS (SELECT dimension, a AS t FROM e UNION SELECT dimension, b FROM e), own AS (SELECT dimension, a AS t FROM r WHERE a = b),
    up AS (SELECT t.dimension, t FROM term t WHERE EXISTS (SELECT 1 FROM own o WHERE o.dimension = t.dimension AND (o.t = t.t OR EXISTS (SELECT 1 FROM r WHERE r.dimension = t.dimension AND r.a = t.t AND r.b = o.t)))),
    down AS (SELECT t.dimension, t FROM term t WHERE EXISTS (SELECT 1 FROM own o WHERE o.dimension = t.dimension AND (o.t = t.t OR EXISTS (SELECT 1 FROM r WHERE r.dimension = t.dimension AND r.b = t.t AND r.a = o.t)))),
    good AS (SELECT * FROM term EXCEPT SELECT * FROM up),
    way AS (SELECT dimension, t, 0 AS n FROM good UNION SELECT e.dimension, e.a, w.n + 1 FROM way w JOIN e ON e.dimension = w.dimension AND e.b = w.t JOIN good g ON g.dimension = e.dimension AND g.t = e.a)
    SELECT t.dimension, t.t AS term, CAST(coalesce(max(w.n), -1) AS INTEGER) AS level, bool_or(u.t IS NOT NULL AND d.t IS NOT NULL) AS cycle FROM term t LEFT JOIN way w ON w.dimension = t.dimension AND w.t = t.t
        LEFT JOIN up u ON u.dimension = t.dimension AND u.t = t.t LEFT JOIN down d ON d.dimension = t.dimension AND d.t = t.t GROUP BY t.dimension, t.t""")
def comparison_ranking(spark, sf_dir):
    """Levels of types within each brand, -1 on cycles and above them."""
    return discourse.ranking(discourse.comparisons(compared(spark, sf_dir))).withColumn("level", F.coalesce("level", F.lit(-1)))
