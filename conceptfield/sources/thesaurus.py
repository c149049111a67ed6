"""Thesaurus sources: ConceptNet dumps and caches, RuWordNet XML."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons
from ..operators import thesaurus as T


def conceptnet_dump(spark: SparkSession, path: str, lang: str = "ru", min_weight: float = 1.0) -> DataFrame:
    """(rel, start, end, weight) of a tab-separated assertion dump: known relations within one language.

    A gzip file is read by one task and spread afterwards.
    """
    raw = spark.read.option("sep", "\t").option("quote", "").schema("uri string, rel string, start string, end string, meta string").csv(path)
    prefix = f"/c/{lang}/"
    rows = raw.where(F.col("start").startswith(prefix) & F.col("end").startswith(prefix) & T.relation(F.col("rel")).isin(*lexicons.CONCEPTNET_RELATIONS)).repartition(F.col("start"))
    rows = rows.select(T.relation(F.col("rel")).alias("rel"), T.term(F.col("start")).alias("start"), T.term(F.col("end")).alias("end"), F.coalesce(F.get_json_object("meta", "$.weight").cast("double"), F.lit(1.0)).alias("weight"))
    return rows.where((F.col("weight") >= min_weight) & (F.length("start") >= 2) & (F.length("end") >= 2) & (F.col("start") != F.col("end")))


def write_cache(edges: DataFrame, path: str) -> DataFrame:
    """Writes edges, heaviest first, and returns the number of each relation."""
    edges.orderBy(F.desc("weight"), "rel", "start", "end").write.mode("overwrite").json(path)
    return T.relation_counts(edges)


def conceptnet_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Edges of a JSON cache: a list in one file, or lines as `write_cache` leaves them. A missing file has no edges."""
    schema = "rel string, start string, end string, weight double"
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ruwordnet(spark: SparkSession, senses: list[str], relations: list[str]) -> DataFrame:
    """(rel, start, end): relations between the first one-word senses of synsets, of types of at most two letters, in the order of the files given."""
    read = None
    for i, path in enumerate(senses):
        part = spark.read.format("xml").option("rowTag", "sense").schema("_name string, _synset_id string, _synt_type string").load(path)
        part = part.select(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("pos"), F.lower(F.trim("_name")).alias("name"), F.col("_synset_id").alias("synset"), F.length(F.coalesce("_synt_type", F.lit(""))).alias("kind"))
        part = part.where((F.col("kind") <= 2) & (F.col("name") != "")).drop("kind")
        read = part if read is None else read.unionByName(part)
    lemma = T.first_lemma(read, "synset", "name", "file", "pos")
    links = None
    for path in relations:
        part = spark.read.format("xml").option("rowTag", "relation").schema("_parent_id string, _child_id string, _name string").load(path)
        links = part if links is None else links.unionByName(part)
    return T.relations_of(links.select(F.col("_name").alias("rel"), F.col("_parent_id").alias("parent"), F.col("_child_id").alias("child")), lemma)


def base_layer(edges: DataFrame, synset_edges: DataFrame | None = None, min_weight: float = 1.0) -> DataFrame:
    """Judgments of all thesauri."""
    out = T.edge_judgments(edges, min_weight=min_weight)
    if synset_edges is not None:
        out = out.unionByName(T.edge_judgments(synset_edges.withColumn("weight", F.lit(2.0)), lexicons.RUWORDNET_RELATIONS, 0.0, 0.4, "ruwordnet"))
    return out
