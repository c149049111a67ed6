"""Sources and sinks as queries: rows of the driver's tables are written in a source's format and read back by it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..sources import chat, thesaurus
from .registry import query, table

RELATIONS = ("IsA", "PartOf", "Nope", "HasA")


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH d AS (SELECT {list(RELATIONS)}[p_partkey % {len(RELATIONS)} + 1] AS rel, 'part ' || p_partkey AS start, replace(lower(p_type), '_', ' ') AS "end", CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE (p_partkey % 30) / 10.0 END::DOUBLE AS weight FROM part WHERE p_partkey % 5 <> 0)
    SELECT * FROM d WHERE rel <> 'Nope' AND weight >= 1""")
def conceptnet_dump(spark, sf_dir):
    """A tab-separated dump, of two languages and with unknown relations and weights, read, stored as a cache and read again."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rel = F.element_at(F.array(*map(F.lit, RELATIONS)), (k % len(RELATIONS) + 1).cast("int"))
    lang = F.when(k % 5 == 0, "en").otherwise("ru")
    weight = F.when(k % 7 == 0, "{}").otherwise(F.concat(F.lit('{"weight": '), (k % 30 / 10.0).cast("string"), F.lit("}")))
    end = F.concat(F.lit("/c/"), lang, F.lit("/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("/n"))
    line = F.concat_ws("\t", F.lit("/a"), F.concat(F.lit("/r/"), rel), F.concat(F.lit("/c/"), lang, F.lit("/part_"), k.cast("string")), end, weight)
    path = place(spark, "dump")
    p.select(line.alias("value")).write.option("compression", "gzip").text(path)
    thesaurus.write_cache(thesaurus.conceptnet_dump(spark, path), f"{path}-cache")
    return thesaurus.conceptnet_cache(spark, f"{path}-cache", lines=True)


@query("""SELECT 'hypernym' AS rel, 'p' || a.p_partkey AS start, 'p' || b.p_partkey AS "end" FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def ruwordnet_files(spark, sf_dir):
    """Senses and relations as XML files: names of several words and senses of long types don't count."""
    p, path = table(spark, sf_dir, "part"), place(spark, "xml")
    k = F.col("p_partkey").cast("string")
    names = (("P", F.lit("N")), ("two words ", F.lit("N")), ("X", F.lit("NOUN")))
    senses = p.select(F.explode(F.array(*[F.struct(F.concat(F.lit(n), k).alias("_name"), k.alias("_synset_id"), t.alias("_synt_type")) for n, t in names])).alias("s")).select("s.*")
    senses.write.format("xml").option("rootTag", "senses").option("rowTag", "sense").save(f"{path}/senses")
    links = p.select(k.alias("_parent_id"), (F.col("p_partkey") + 1).cast("string").alias("_child_id"), F.lit("hypernym").alias("_name"))
    links.write.format("xml").option("rootTag", "relations").option("rowTag", "relation").save(f"{path}/relations")
    return thesaurus.ruwordnet(spark, [f"{path}/senses"], [f"{path}/relations"])


@query("""SELECT conv_id::DOUBLE AS ts, role, text AS content, CASE WHEN turn % 2 = 0 THEN 'turn ' || turn END AS focused_concept FROM conversations""")
def session_log(spark, sf_dir):
    """Turns appended in two goes to a log of JSON lines and read back."""
    c, path = table(spark, sf_dir, "conversations"), place(spark, "session")
    rows = c.select(F.col("conv_id").cast("double").alias("ts"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("focused_concept"), "conv_id")
    chat.append_session(rows.where("conv_id % 2 = 0"), path)
    chat.append_session(rows.where("conv_id % 2 <> 0 OR conv_id IS NULL"), path)
    return chat.session(spark, path)
