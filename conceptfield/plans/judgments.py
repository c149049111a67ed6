"""Judgment, materialisation, feedback and graph queries: events stand for judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.config import Config
from ..functions.shared import dealt
from ..operators import deepen as deepening
from ..operators import density, feedback, maps, materialize
from ..sources import chat
from .density import CFG as VECTORS
from .density import E_SQL, rhos
from .registry import query, table

#: The moment of the queries: 31 January 2024, UTC.
AS_OF = 1706659200.0
CFG = Config(as_of=AS_OF, dim=16)
SELVES, IDENTITY, RELATION = ("u1", "u2", "u3"), ("view", "error"), ("click",)
PRONOUNS = ("u1", "u2", "u3", "u4", "u5", "k1", "k2", "k3")

JUDGMENTS_SQL = """j AS (SELECT event_id AS judgment_id, event_id AS seq, event_id % 2 AS space_id, 'u' || user_id AS subject, event_type AS verb, 'k' || (props->>'k') AS object,
    CASE WHEN event_id % 7 = 0 THEN 'NEGATIVE' ELSE 'AFFIRMATIVE' END AS quality, [1.0, 0.7, 0.5, 0.4][event_id % 4 + 1]::DOUBLE AS modality, least(1.0, value / 100) AS intensity, epoch(ts) AS t,
    ['GENERIC', 'HABITUAL', 'EPISODIC', 'UNKNOWN'][event_id % 4 + 1] AS clause_type, CAST(event_id % 3 AS INTEGER) AS interpretation_layer, event_id % 11 = 0 AS defeasible, event_id % 13 = 0 AS archived,
    CASE WHEN event_id % 5 = 0 THEN 'confirmed' ELSE 'unreviewed' END AS status, (100 - event_id % 60) / 100.0::DOUBLE AS confidence, (event_id % 100) / 100.0::DOUBLE AS anomaly, 'event ' || event_id AS source_text,
    CAST(1 + event_id % 4 AS INTEGER) AS activation, value AS weight FROM events),
    b AS (SELECT *, modality * intensity * CASE WHEN clause_type = 'EPISODIC' THEN 0.7 ELSE 1.0 END AS w FROM j)"""


def judgments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")

    def cycle(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))

    return e.select(
        i.alias("judgment_id"), i.alias("seq"), (i % 2).alias("space_id"), F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("verb"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"),
        F.when(i % 7 == 0, "NEGATIVE").otherwise("AFFIRMATIVE").alias("quality"), cycle(1.0, 0.7, 0.5, 0.4).alias("modality"), F.least(F.lit(1.0), F.col("value") / 100).alias("intensity"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), cycle("GENERIC", "HABITUAL", "EPISODIC", "UNKNOWN").alias("clause_type"), (i % 3).cast("int").alias("interpretation_layer"), (i % 11 == 0).alias("defeasible"), (i % 13 == 0).alias("archived"),
        F.when(i % 5 == 0, "confirmed").otherwise("unreviewed").alias("status"), ((100 - i % 60) / 100.0).alias("confidence"), ((i % 100) / 100.0).alias("anomaly"), F.concat(F.lit("event "), i.cast("string")).alias("source_text"),
        (1 + i % 4).cast("int").alias("activation"), F.col("value").alias("weight"))


@query(f"WITH {JUDGMENTS_SQL} SELECT judgment_id, round(w + 1e-9, 6) AS w FROM b")
def judgment_base_weight(spark, sf_dir):
    return judgments(spark, sf_dir).select("judgment_id", F.round(materialize.base_weight(CFG) + 1e-9, 6).alias("w"))


KIND_SQL = "CASE WHEN subject NOT IN ('u1', 'u2', 'u3') THEN 'none' WHEN verb IN ('view', 'error') THEN 'identity' WHEN verb = 'click' THEN 'relation' ELSE 'action' END"


@query(f"WITH {JUDGMENTS_SQL} SELECT {KIND_SQL} AS kind, count(*) AS n, round(sum(w), 4) AS w FROM b GROUP BY 1")
def self_routing(spark, sf_dir):
    kind = materialize.self_type(IDENTITY, RELATION, ("amod",), SELVES).alias("kind")
    return judgments(spark, sf_dir).withColumn("w", materialize.base_weight(CFG)).groupBy(kind).agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


FAN_SQL = f"""k AS (SELECT *, {KIND_SQL} AS kind, subject NOT IN ('u1', 'u2', 'u3', 'u4', 'u5', 'k1', 'k2', 'k3') AS s, object NOT IN ('u1', 'u2', 'u3', 'u4', 'u5', 'k1', 'k2', 'k3') AS o FROM b),
    fan AS (SELECT *, 'self' AS role, '[self]' AS concept, w * CASE kind WHEN 'identity' THEN 1.0 ELSE 0.5 END AS fw FROM k WHERE kind IN ('identity', 'relation') AND o
    UNION ALL SELECT *, 'subject', subject, w FROM k WHERE kind = 'none' AND s UNION ALL SELECT *, 'object', object, w * 0.5 FROM k WHERE o UNION ALL SELECT *, 'verb', verb, w * 0.2 FROM k WHERE kind = 'none' AND (s OR o))"""


def fan(spark, sf_dir):
    return materialize.fan_out(judgments(spark, sf_dir).drop("weight"), CFG, PRONOUNS, SELVES, identity=IDENTITY, relation=RELATION, dependencies=("amod",))


@query(f"WITH {JUDGMENTS_SQL}, {FAN_SQL} SELECT judgment_id, role, concept, round(fw + 1e-9, 6) AS weight FROM fan")
def component_fanout(spark, sf_dir):
    return fan(spark, sf_dir).select("judgment_id", "role", "concept", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


VECTOR_SQL = """terms AS (SELECT DISTINCT unnest([subject, verb, object]) AS term FROM j), coords AS (SELECT term, i, ('0x' || substr(md5(term || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5 AS x FROM terms, range(16) t(i)),
    vec AS (SELECT term, i, x / sqrt(sum(x * x) OVER (PARTITION BY term)) AS x FROM coords)"""


@query(f"WITH {JUDGMENTS_SQL}, {VECTOR_SQL} SELECT term, CAST(i AS INTEGER) AS i, round(x, 8) AS x FROM vec")
def hash_vector(spark, sf_dir):
    terms = judgments(spark, sf_dir).select(F.explode(F.array("subject", "verb", "object")).alias("term"))
    return vectors.term_vectors(terms, CFG.dim).select("term", F.posexplode("vector").alias("i", "x")).select("term", "i", F.round("x", 8).alias("x"))


def role_sql(*roles):
    values = ", ".join(f"('{r}')" for r in roles)
    return f"perm AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY md5(role || ':' || i)) - 1 AS i, i AS p, CASE WHEN ('0x' || right(md5(role || ':' || i), 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM (VALUES {values}) r(role), range(16) t(i))"


@query(f"WITH {role_sql('object', 'verb', 'subject_in_object', 'verb_in_object')} SELECT role, CAST(i AS INTEGER) AS i, CAST(p AS INTEGER) AS p, CAST(sign AS DOUBLE) AS sign FROM perm")
def role_permutation(spark, sf_dir):
    rows = [(r, i, p, s) for r in ("object", "verb", "subject_in_object", "verb_in_object") for i, (p, s) in enumerate(zip(*vectors.role_table(r, CFG.dim), strict=True))]
    return spark.createDataFrame(rows, "role string, i int, p int, sign double")


def encode_sql(noun, noun_role, verb_role):
    return f"""WITH {JUDGMENTS_SQL}, {VECTOR_SQL}, {role_sql(noun_role, verb_role)},
    turned AS (SELECT term, role, perm.i AS i, sign * x AS x FROM perm JOIN vec ON vec.i = perm.p),
    mixed AS (SELECT judgment_id, a.i AS i, a.x + CASE WHEN quality = 'NEGATIVE' THEN -intensity ELSE intensity END * v.x AS x FROM j JOIN turned a ON a.term = j.{noun} AND a.role = '{noun_role}' JOIN turned v ON v.term = j.verb AND v.role = '{verb_role}' AND v.i = a.i),
    n AS (SELECT judgment_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY judgment_id)) AS x FROM mixed)
    SELECT judgment_id, round(max(x) FILTER (WHERE i = 0), 6) AS x0, round(max(x) FILTER (WHERE i = 7), 6) AS x7, round(sum(x), 6) AS total FROM n GROUP BY judgment_id"""


def encoded(spark, sf_dir, name):
    rows = materialize.encoded(judgments(spark, sf_dir), CFG)
    total = F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
    return rows.select("judgment_id", F.round(F.element_at(name, 1), 6).alias("x0"), F.round(F.element_at(name, 8), 6).alias("x7"), F.round(total, 6).alias("total"))


@query(encode_sql("object", "object", "verb"))
def encode_subject(spark, sf_dir):
    return encoded(spark, sf_dir, "v_subject")


@query(encode_sql("subject", "subject_in_object", "verb_in_object"))
def encode_object(spark, sf_dir):
    return encoded(spark, sf_dir, "v_object")


DECAY_SQL = f"d AS (SELECT *, weight * activation * pow(1 + greatest(0, {AS_OF} - t) / 2592000.0, -0.5) AS dw FROM j)"


@query(f"WITH {JUDGMENTS_SQL}, {DECAY_SQL} SELECT judgment_id, round(dw, 4) AS w FROM d")
def decayed_weight(spark, sf_dir):
    return judgments(spark, sf_dir).select("judgment_id", F.round(density.decayed_weight(CFG), 4).alias("w"))


@query(f"WITH {JUDGMENTS_SQL}, {DECAY_SQL}, m AS (SELECT *, dw < 0.01 * max(dw) OVER (PARTITION BY verb) AS a FROM d) SELECT verb AS concept, count(*) AS n, count(*) FILTER (WHERE a) AS archived FROM m GROUP BY verb")
def archive_flag(spark, sf_dir):
    rows = density.with_archive(judgments(spark, sf_dir).withColumn("concept", F.col("verb")), CFG)
    return rows.groupBy("concept").agg(F.count("*").alias("n"), F.count_if("archived").alias("archived"))


@query(f"WITH {JUDGMENTS_SQL}, {DECAY_SQL} SELECT verb AS concept, interpretation_layer AS most, count(*) AS n, round(sum(dw), 2) AS mass FROM (SELECT d.verb, l.interpretation_layer, dw FROM d JOIN (SELECT DISTINCT interpretation_layer FROM j) l ON d.interpretation_layer <= l.interpretation_layer) GROUP BY ALL")
def rho_layer(spark, sf_dir):
    rows = density.layer(judgments(spark, sf_dir), 2).withColumn("w", density.decayed_weight(CFG))
    each = rows.select(F.col("verb").alias("concept"), "w", F.explode(F.sequence("interpretation_layer", F.lit(2))).alias("most"))
    return each.groupBy("concept", "most").agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("mass"))


def rho_sql(where: str) -> str:
    head = encode_sql("subject", "subject_in_object", "verb_in_object").rsplit("SELECT judgment_id, round(max(x)", 1)[0]
    return f"""{head}, p AS (SELECT judgment_id, object AS concept, 0.5 * w * activation * pow(1 + greatest(0, {AS_OF} - t) / 2592000.0, -0.5) AS dw FROM b WHERE {where}), q AS (SELECT *, max(dw) OVER (PARTITION BY concept) AS top FROM p),
    c AS (SELECT concept, x.i AS i, y.i AS j, sum(dw * x.x * y.x) AS val FROM q JOIN n x USING (judgment_id) JOIN n y USING (judgment_id) WHERE dw >= 0.01 * top GROUP BY ALL) SELECT concept, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(val + 1e-9, 5) + 0.0 AS val FROM c"""


def rho(judged, keep):
    """Matrices of objects: components with decayed weights, those of layers or clause types that `keep` takes, archived ones
    left out."""
    parts = materialize.encoded(judged.drop("weight", "archived"), CFG).select(F.col("object").alias("concept"), F.col("v_object").alias("vector"), (materialize.base_weight(CFG) * CFG.object_weight).alias("weight"), "ts", "activation", "interpretation_layer", "clause_type")
    active = density.with_archive(keep(parts), CFG).where("not archived")
    return density.entries(density.matrices(active)).withColumn("val", F.round(F.col("val") + 1e-9, 5) + 0.0)


@query(rho_sql("true"))
def rho_decayed(spark, sf_dir):
    return rho(judgments(spark, sf_dir), lambda p: p)


@query(rho_sql("interpretation_layer <= 1"))
def rho_layer_matrix(spark, sf_dir):
    return rho(judgments(spark, sf_dir), lambda p: density.layer(p, 1))


@query(rho_sql("clause_type <> 'EPISODIC'"))
def rho_semantic_matrix(spark, sf_dir):
    return rho(judgments(spark, sf_dir), density.semantic)


@query(f"WITH {JUDGMENTS_SQL} SELECT DISTINCT object AS concept FROM j WHERE NOT archived AND judgment_id % 9 = 1")
def personal_targets(spark, sf_dir):
    thesaurus = F.when(F.col("judgment_id") % 9 == 1, F.col("source_text")).otherwise("[thesaurus:conceptnet] x")
    return deepening.personal(judgments(spark, sf_dir).withColumn("concept", F.col("object")).withColumn("source_text", thesaurus))


@query(f"""WITH {JUDGMENTS_SQL} SELECT subject, verb, object, quality, t AS ts, 1.0::DOUBLE AS modality, 0.8::DOUBLE AS intensity, CAST(0 AS INTEGER) AS interpretation_layer, false AS defeasible, 'confirmed' AS status, '[dialogue] ' || substr(source_text, 1, 8) AS source_text
    FROM j WHERE length('the user said ' || source_text) >= 24""")
def dialogue_judgments(spark, sf_dir):
    """Replies in code fences back to judgments; texts of fewer than 24 characters are left out."""
    j = judgments(spark, sf_dir).select(F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("subject", "verb", "object", F.when(F.col("quality") == "NEGATIVE", F.col("quality")).alias("quality")))), F.lit("\n```")).alias("reply"), "ts", F.concat(F.lit("the user said "), "source_text").alias("said"), F.col("source_text").alias("text"))
    return materialize.from_triples(chat.triples(j, text="said", least=24), 8)


@query(f"WITH {JUDGMENTS_SQL}, {DECAY_SQL} SELECT object AS concept, count(*) AS n, round(sum(dw), 2) AS mass FROM d WHERE clause_type <> 'EPISODIC' GROUP BY object")
def rho_semantic(spark, sf_dir):
    rows = density.semantic(judgments(spark, sf_dir)).withColumn("w", density.decayed_weight(CFG))
    return rows.groupBy(F.col("object").alias("concept")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("mass"))


@query(f"WITH {JUDGMENTS_SQL}, {FAN_SQL} SELECT concept, count(*) AS n FROM fan WHERE NOT archived GROUP BY concept HAVING count(*) >= 60 AND count(*) FILTER (WHERE role = 'verb') = 0")
def queryable(spark, sf_dir):
    return density.queryable(fan(spark, sf_dir).withColumn("is_verb", F.col("role") == "verb"), 60, verbs=False)


@query(f"WITH {JUDGMENTS_SQL}, t AS (SELECT [subject, verb, object] AS x FROM j), p AS (SELECT DISTINCT a, b FROM (SELECT unnest(x) AS a, x FROM t) q, LATERAL (SELECT unnest(q.x) AS b) r WHERE a <> b) SELECT a, count(*) AS linked FROM p GROUP BY a")
def link_index(spark, sf_dir):
    return deepening.links(judgments(spark, sf_dir)).groupBy("a").agg(F.count("*").alias("linked"))


@query(f"WITH {JUDGMENTS_SQL}, s AS (SELECT a, b, verb, sum(weight) AS w FROM (SELECT subject AS a, object AS b, verb, weight FROM j UNION ALL SELECT object, subject, verb, weight * 0.5 FROM j) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(w, 9) DESC, verb) AS r FROM s) SELECT a, b, verb FROM r WHERE r = 1")
def dominant_relation(spark, sf_dir):
    return deepening.dominant_relation(judgments(spark, sf_dir))


@query(f"WITH {JUDGMENTS_SQL} SELECT object AS concept, count(*) AS n FROM j GROUP BY object ORDER BY n DESC, concept LIMIT 25")
def richness_rank(spark, sf_dir):
    return maps.richness(judgments(spark, sf_dir).select(F.col("object").alias("concept")), 25)


@query(f"""WITH {JUDGMENTS_SQL}, t AS (SELECT count(DISTINCT x) AS terms FROM (SELECT unnest([subject, verb, object]) AS x FROM j))
    SELECT count(*) AS judgments, round(avg(confidence), 6) AS confidence_mean, min(confidence) AS confidence_min, max(confidence) AS confidence_max, round(median(confidence), 6) AS confidence_median, count(*) FILTER (WHERE confidence < 0.5) AS under_50, count(*) FILTER (WHERE confidence < 0.7) AS under_70,
    count(*) FILTER (WHERE quality = 'NEGATIVE') AS negative, count(*) FILTER (WHERE anomaly > 0.7) AS anomalous, count(*) FILTER (WHERE anomaly > 0.85) AS very_anomalous, max(terms) AS terms FROM j, t""")
def corpus_stats(spark, sf_dir):
    out = maps.corpus_stats(judgments(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("confidence_mean", "confidence_median")})


@query(f"WITH {JUDGMENTS_SQL} SELECT CASE WHEN modality >= 0.9 THEN 'factual' WHEN modality > 0.4 THEN 'epistemic' ELSE 'conditional' END AS bucket, count(*) AS n, count(*) FILTER (WHERE quality = 'NEGATIVE') AS negative FROM j GROUP BY 1")
def modality_buckets(spark, sf_dir):
    return maps.modality_buckets(judgments(spark, sf_dir))


@query(f"WITH {JUDGMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY object, subject, verb, quality ORDER BY seq) AS r FROM j) SELECT object AS concept, subject, verb, quality, judgment_id, substr(source_text, 1, 9) AS source_text FROM r WHERE r = 1")
def provenance_dedup(spark, sf_dir):
    return maps.provenance(judgments(spark, sf_dir).withColumn("concept", F.col("object")), 9).select("concept", "subject", "verb", "quality", "judgment_id", "source_text")


@query(f"WITH {JUDGMENTS_SQL} SELECT verb, object, min(seq) AS seq FROM j WHERE subject IN ('u1', 'u2', 'u3') GROUP BY verb, object ORDER BY seq, verb, object LIMIT 15")
def self_report(spark, sf_dir):
    return maps.self_report(judgments(spark, sf_dir).where(F.col("subject").isin(*SELVES))).select("verb", "object", "seq")


@query(f"WITH {JUDGMENTS_SQL} SELECT space_id, object AS concept, count(*) AS n FROM (SELECT subject AS space_id, object FROM j UNION ALL SELECT 'all', object FROM j) GROUP BY ALL")
def sender_maps(spark, sf_dir):
    return maps.per_sender(judgments(spark, sf_dir).withColumn("sender", F.col("subject"))).groupBy("space_id", F.col("object").alias("concept")).agg(F.count("*").alias("n"))


@query(f"""WITH {JUDGMENTS_SQL}, p AS (SELECT subject, object, count(*) AS n FROM j GROUP BY ALL), s AS (SELECT subject, count(*) AS ns FROM j GROUP BY 1), o AS (SELECT object, count(*) AS no FROM j GROUP BY 1)
    SELECT subject, object, n, round(ln(n * (SELECT count(*) FROM j)::DOUBLE / (ns * no)), 6) AS pmi FROM p JOIN s USING (subject) JOIN o USING (object)""")
def pmi(spark, sf_dir):
    return maps.pmi(judgments(spark, sf_dir)).withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {JUDGMENTS_SQL}, g AS (SELECT subject AS sender, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS gap FROM j) SELECT sender, round(median(gap) * 100, 1) AS tau FROM g WHERE gap IS NOT NULL GROUP BY sender")
def user_tau(spark, sf_dir):
    return maps.user_tau(judgments(spark, sf_dir).withColumn("sender", F.col("subject"))).withColumn("tau", F.round("tau", 1))


LINKS_SQL = "links AS (SELECT subject AS a, object AS b, round(sum(weight), 2) AS weight FROM j GROUP BY ALL)"


def links(spark, sf_dir):
    return judgments(spark, sf_dir).groupBy(F.col("subject").alias("a"), F.col("object").alias("b")).agg(F.round(F.sum("weight"), 2).alias("weight"))


@query(f"""WITH {JUDGMENTS_SQL}, {LINKS_SQL}, d AS (SELECT 'out' AS direction, a AS node, sum(weight) AS degree FROM links GROUP BY a UNION ALL SELECT 'in', b, sum(weight) FROM links GROUP BY b),
    r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY round(degree, 6) DESC, node) AS rank FROM d) SELECT direction, node, round(degree, 2) AS degree, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def graph_degree(spark, sf_dir):
    return maps.degrees(links(spark, sf_dir)).withColumn("degree", F.round("degree", 2))


@query(f"WITH {JUDGMENTS_SQL}, {LINKS_SQL} SELECT a, b, weight FROM links ORDER BY weight DESC, a, b LIMIT 10")
def strongest_edges(spark, sf_dir):
    return maps.strongest(links(spark, sf_dir))


@query(f"WITH {JUDGMENTS_SQL}, {LINKS_SQL} SELECT (SELECT count(DISTINCT x) FROM (SELECT unnest([a, b]) AS x FROM links)) AS nodes, (SELECT count(*) FROM links) AS edges")
def graph_counts(spark, sf_dir):
    return maps.graph_counts(links(spark, sf_dir))


@query(f"""WITH {JUDGMENTS_SQL}, links AS (SELECT 'k' || (a % 40) AS a, 'k' || (b % 40) AS b, round(sum(weight), 2) AS weight FROM (SELECT CAST(substr(subject, 2) AS INTEGER) AS a, CAST(substr(object, 2) AS INTEGER) AS b, weight FROM j) GROUP BY ALL), s AS (SELECT * FROM links WHERE weight >= 400),
    c AS (SELECT a, b, weight, 'child' AS kind FROM s WHERE a = 'k7'), p AS (SELECT a, b, weight, 'parent' AS kind FROM s WHERE b = 'k7' AND a NOT IN (SELECT b FROM c)), n AS (SELECT b AS n FROM c UNION SELECT a FROM p)
    SELECT * FROM c UNION ALL SELECT * FROM p UNION ALL SELECT a, b, weight, 'cross' FROM s WHERE a <> 'k7' AND b <> 'k7' AND a IN (SELECT n FROM n) AND b IN (SELECT n FROM n)""")
def ego_network(spark, sf_dir):
    def node(c):
        return F.concat(F.lit("k"), (F.expr(f"cast(substring({c}, 2) as int)") % 40).cast("string"))

    rows = judgments(spark, sf_dir).groupBy(node("subject").alias("a"), node("object").alias("b")).agg(F.round(F.sum("weight"), 2).alias("weight"))
    return maps.ego(rows, "k7", 400.0)


@query(f"""WITH {JUDGMENTS_SQL}, {LINKS_SQL}, s AS (SELECT * FROM links WHERE weight >= 50), x AS (SELECT a AS node, 'contains' AS direction, b AS other, weight FROM s UNION ALL SELECT b, 'contained_in', a, weight FROM s),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node, direction ORDER BY weight DESC, other) AS INTEGER) AS rank FROM x) SELECT * FROM r WHERE rank <= 15""")
def node_panel(spark, sf_dir):
    return maps.panel(links(spark, sf_dir), 50.0)


@query(f"""WITH {JUDGMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY object, subject, verb, quality ORDER BY seq) AS r FROM j)
    SELECT object AS concept, judgment_id, CASE WHEN anomaly >= 0.85 THEN 'anomaly' WHEN quality = 'NEGATIVE' THEN 'negative' WHEN judgment_id % 5 = 2 THEN 'conditional' ELSE 'plain' END AS kind, CASE WHEN anomaly >= 0.85 THEN CAST(round(anomaly * 100) AS INTEGER) ELSE -1 END AS anomaly_percent,
    CASE WHEN interpretation_layer > 0 THEN interpretation_layer ELSE 0 END AS layer, CASE WHEN status = 'confirmed' THEN status ELSE '' END AS confirmation FROM r WHERE r = 1""")
def panel_judgments(spark, sf_dir):
    """Judgments of each node's panel with their badges."""
    rows = judgments(spark, sf_dir).withColumn("concept", F.col("object")).withColumn("condition_id", F.when(F.col("judgment_id") % 5 == 2, F.col("judgment_id")))
    shown = maps.panel_judgments(rows)
    return shown.select("concept", "judgment_id", "kind", F.coalesce("anomaly_percent", F.lit(-1)).alias("anomaly_percent"), F.coalesce("layer", F.lit(0)).alias("layer"), F.coalesce("confirmation", F.lit("")).alias("confirmation"))


@query(f"WITH {JUDGMENTS_SQL} SELECT judgment_id, 0.9::DOUBLE AS priority FROM j WHERE anomaly > 0.7 AND status = 'unreviewed' AND NOT archived")
def anomaly_questions(spark, sf_dir):
    return feedback.anomaly_questions(judgments(spark, sf_dir), CFG).select(F.element_at("judgments", 1).alias("judgment_id"), "priority")


CONTRA_SQL = "f AS (SELECT subject, object, min(seq) FILTER (WHERE quality = 'AFFIRMATIVE') AS yes, min(seq) FILTER (WHERE quality = 'NEGATIVE') AS no FROM j WHERE NOT archived GROUP BY subject, object)"


@query(f"WITH {JUDGMENTS_SQL}, {CONTRA_SQL} SELECT subject, object, yes, no FROM f WHERE yes IS NOT NULL AND no IS NOT NULL")
def contradiction_pairs(spark, sf_dir):
    q = feedback.contradiction_questions(judgments(spark, sf_dir))
    return q.select(F.element_at("concepts", 1).alias("subject"), F.element_at("concepts", 2).alias("object"), F.element_at("judgments", 1).alias("yes"), F.element_at("judgments", 2).alias("no"))


@query(f"WITH {JUDGMENTS_SQL} SELECT subject, verb, object, count(*) AS n FROM j WHERE NOT archived GROUP BY ALL HAVING count(DISTINCT quality) = 2")
def conflict_flag(spark, sf_dir):
    q = feedback.contradiction_questions(judgments(spark, sf_dir), same_verb=True).select(F.explode("judgments").alias("judgment_id"))
    rows = judgments(spark, sf_dir).where("not archived")
    hit = rows.join(q, "judgment_id", "left_semi").select("subject", "verb", "object").distinct()
    return rows.join(hit, ["subject", "verb", "object"]).groupBy("subject", "verb", "object").agg(F.count("*").alias("n"))


@query(f"WITH {JUDGMENTS_SQL} SELECT judgment_id FROM j WHERE archived AND weight * activation >= 0.5")
def archive_questions(spark, sf_dir):
    return feedback.archive_questions(judgments(spark, sf_dir), CFG).select(F.element_at("judgments", 1).alias("judgment_id"))


@query(f"WITH {JUDGMENTS_SQL} SELECT judgment_id FROM j WHERE defeasible AND status = 'unreviewed' AND NOT archived")
def defeasible_questions(spark, sf_dir):
    return feedback.defeasible_questions(judgments(spark, sf_dir)).select(F.element_at("judgments", 1).alias("judgment_id"))


@query(f"WITH {JUDGMENTS_SQL} SELECT object AS concept FROM j WHERE NOT archived GROUP BY object HAVING count(*) % 50 = 42")
def milestone(spark, sf_dir):
    rows = judgments(spark, sf_dir).withColumn("concept", F.col("object"))
    return feedback.milestone_questions(rows, Config(milestone=42), 50).select(F.element_at("concepts", 1).alias("concept"))


@query(f"""WITH {JUDGMENTS_SQL}, {CONTRA_SQL},
    q AS (SELECT 'anomaly' AS question_type, 0.9::DOUBLE AS priority, list_sort([subject, object]) AS c, source_text FROM j WHERE anomaly > 0.97 AND status = 'unreviewed' AND NOT archived
    UNION ALL SELECT 'contradiction', 0.85, list_sort([f.subject, f.object]), j.source_text FROM f JOIN j ON j.seq = f.yes WHERE no IS NOT NULL
    UNION ALL SELECT 'archive', 0.5, list_sort([subject, object]), source_text FROM j WHERE archived AND weight * activation >= 0.5
    UNION ALL SELECT 'defeasible', 0.6, list_sort([subject, object]), source_text FROM j WHERE defeasible AND status = 'unreviewed' AND NOT archived),
    k AS (SELECT DISTINCT question_type || '|' || array_to_string(c, ',') || '|' || substr(source_text, 1, 40) AS key, question_type, priority FROM q),
    a AS (SELECT * FROM k WHERE key NOT IN (SELECT 'anomaly|' || array_to_string(list_sort([subject, object]), ',') || '|' || source_text FROM j WHERE seq % 2 = 0))
    SELECT key, question_type, priority, CAST(row_number() OVER (ORDER BY priority DESC, key) AS INTEGER) AS rank FROM a ORDER BY priority DESC, key LIMIT 60""")
def question_union_topn(spark, sf_dir):
    j = dealt(judgments(spark, sf_dir), "judgment_id")  # first judgments and keys are sorted in each task
    asked = j.where("seq % 2 = 0").select(F.concat(F.lit("anomaly|"), F.array_join(F.array_sort(F.array("subject", "object")), ","), F.lit("|"), "source_text").alias("key"))
    cfg = Config(anomaly_question=0.97)
    out = feedback.ask([feedback.anomaly_questions(j, cfg), feedback.contradiction_questions(j), feedback.archive_questions(j, cfg), feedback.defeasible_questions(j)], asked, 60)
    return out.select("key", "question_type", "priority", "rank")


@query(f"""WITH {JUDGMENTS_SQL}, {CONTRA_SQL}, {E_SQL},
    q AS (SELECT 'anomaly' AS question_type, 0.9::DOUBLE AS priority, list_sort([subject, object]) AS c, source_text FROM j WHERE anomaly > 0.97 AND status = 'unreviewed' AND NOT archived
    UNION ALL SELECT 'contradiction', 0.85, list_sort([f.subject, f.object]), j.source_text FROM f JOIN j ON j.seq = f.yes WHERE no IS NOT NULL
    UNION ALL SELECT 'archive', 0.5, list_sort([subject, object]), source_text FROM j WHERE archived AND weight * activation >= 0.5
    UNION ALL SELECT 'defeasible', 0.6, list_sort([subject, object]), source_text FROM j WHERE defeasible AND status = 'unreviewed' AND NOT archived
    UNION ALL SELECT 'milestone', 0.2, [object], '' FROM j WHERE NOT archived GROUP BY object HAVING count(*) % 50 = 42
    UNION ALL SELECT 'contrast', 0.3, [CAST(a AS VARCHAR), CAST(b AS VARCHAR)], '' FROM tr JOIN m x ON x.label = tr.a JOIN m y ON y.label = tr.b WHERE a < b AND t / (x.mass * y.mass) > 0.015 AND t / (x.mass * y.mass) < 0.0165),
    k AS (SELECT DISTINCT question_type || '|' || array_to_string(c, ',') || '|' || substr(source_text, 1, 40) AS key, question_type, priority FROM q)
    SELECT question_type, count(*) AS n, min(key) AS first, max(priority) AS priority FROM k GROUP BY question_type""")
def question_union(spark, sf_dir):
    """All six types of questions, one of each key, counted by type."""
    j, cfg = dealt(judgments(spark, sf_dir), "judgment_id"), Config(anomaly_question=0.97)
    every = feedback.unique([
        feedback.anomaly_questions(j, cfg), feedback.contradiction_questions(j), feedback.archive_questions(j, cfg), feedback.defeasible_questions(j),
        feedback.milestone_questions(j.withColumn("concept", F.col("object")), Config(milestone=42), 50), feedback.contrast_questions(rhos(spark, sf_dir), VECTORS)])
    return every.groupBy("question_type").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("priority").alias("priority"))


@query(f"WITH {JUDGMENTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'unreviewed') AS reviewed, round(avg(CASE WHEN status <> 'unreviewed' THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, 0::BIGINT AS rejected, 0::BIGINT AS contextualized FROM j")
def feedback_stats(spark, sf_dir):
    return feedback.stats(judgments(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"""WITH {JUDGMENTS_SQL}, a AS (SELECT judgment_id, CASE WHEN judgment_id % 6 = 0 THEN 'confirm' WHEN judgment_id % 6 = 1 THEN 'reject' WHEN judgment_id % 6 = 2 THEN 'contextualize' END AS action FROM j WHERE judgment_id % 6 < 3)
    SELECT status, archived, count(*) AS n, CAST(sum(activation) AS BIGINT) AS activation FROM (SELECT CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' WHEN 'contextualize' THEN 'contextualized' ELSE status END AS status, coalesce(action = 'reject', false) OR archived AS archived, activation + CASE WHEN action = 'confirm' THEN 1 ELSE 0 END AS activation FROM j LEFT JOIN a USING (judgment_id)) GROUP BY ALL""")
def answer_transitions(spark, sf_dir):
    j = judgments(spark, sf_dir)
    answers = j.select(F.lit("anomaly").alias("question_type"), (F.col("judgment_id") % 6).alias("answer_index"), F.array("judgment_id").alias("judgments"), F.lit(AS_OF).alias("ts"))
    out = feedback.apply(j.withColumn("role", F.lit("subject")), feedback.transitions(answers))
    return out.groupBy("status", "archived").agg(F.count("*").alias("n"), F.sum("activation").alias("activation"))


@query(f"WITH {JUDGMENTS_SQL}, t AS (SELECT 'k' || i AS term FROM range(1, 30) r(i)) SELECT archived AND object NOT IN (SELECT term FROM t) AS archived, count(*) AS n FROM j GROUP BY 1")
def reactivate(spark, sf_dir):
    terms = spark.range(1, 30).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("term"))
    return materialize.reactivated(judgments(spark, sf_dir), terms).groupBy("archived").agg(F.count("*").alias("n"))


@query(f"WITH {JUDGMENTS_SQL} SELECT string_agg(subject || ' ' || verb || ' ' || object, '; ' ORDER BY seq) AS context FROM (SELECT * FROM j WHERE object = 'k7' ORDER BY seq LIMIT 5)")
def focused_context(spark, sf_dir):
    return feedback.focused_context(judgments(spark, sf_dir).withColumn("concept", F.col("object")), "k7")


def parts(spark, sf_dir):
    return materialize.components(judgments(spark, sf_dir), CFG)


@query()
def consolidate(spark, sf_dir):
    return materialize.consolidate(parts(spark, sf_dir), CFG)


@query()
def anomaly_fold(spark, sf_dir):
    return materialize.judgment_anomaly(materialize.consolidate(parts(spark, sf_dir), CFG))
