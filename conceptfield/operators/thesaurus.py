"""From thesaurus edges to judgments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.shared import stage
from .density import matrices


def term(uri: Column) -> Column:
    """/c/ru/x_y/n -> "x y"."""
    return F.lower(F.replace(F.try_element_at(F.split(uri, "/"), F.lit(4)), F.lit("_"), F.lit(" ")))


def relation(uri: Column) -> Column:
    """/r/IsA -> IsA."""
    return F.element_at(F.split(uri, "/"), -1)


def edge_judgments(edges: DataFrame, relations: Mapping[str, tuple[str, float, bool]] = lexicons.CONCEPTNET_RELATIONS, min_weight: float = 1.0, modality: float = 0.3, source: str = "conceptnet") -> DataFrame:
    """Judgments of edges(rel, start, end, weight) whose relation is known and weight enough.

    Intensity is the relation's base times half the weight, 1 at most. The relation table is a short fixed one.
    """
    spark = edges.sparkSession
    known = spark.createDataFrame([(r, v, float(b), n) for r, (v, b, n) in relations.items()], "r string, verb string, base double, negative boolean")
    rows = edges.where(F.col("weight") >= min_weight).join(F.broadcast(known), F.col("rel") == F.col("r"))
    quality = F.when(F.col("negative"), F.lit("NEGATIVE")).otherwise(F.lit("AFFIRMATIVE"))
    return rows.select(F.col("start").alias("subject"), "verb", F.col("end").alias("object"), quality.alias("quality"), F.lit(modality).alias("modality"), F.least(F.lit(1.0), F.col("base") * F.col("weight") / 2).alias("intensity"), F.concat(F.lit("[thesaurus:"), F.lit(source), F.lit("]")).alias("source_text"), F.lit("thesaurus").alias("source"))


def of_terms(judgments: DataFrame, terms: DataFrame) -> DataFrame:
    """Judgments whose subject or object is among terms(term)."""
    t = terms.select("term").distinct()
    by_subject = judgments.join(t, F.col("subject") == F.col("term"), "left_semi")
    others = judgments.join(t, F.col("subject") == F.col("term"), "left_anti")
    return by_subject.unionByName(others.join(t, F.col("object") == F.col("term"), "left_semi"))


def first_lemma(senses: DataFrame, synset: str, name: str, *order: str) -> DataFrame:
    """(synset, lemma): the first sense without a space of each synset."""
    rank = F.row_number().over(W.partitionBy(synset).orderBy(*order))
    return senses.where(~F.col(name).contains(" ")).withColumn("_rn", rank).where("_rn = 1").select(F.col(synset).alias("synset"), F.col(name).alias("lemma"))


def relations_of(links: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(rel, start, end) of links(rel, parent, child) between lemmas that differ and have two letters or more."""
    a, b = lemmas.select(F.col("synset").alias("parent"), F.col("lemma").alias("start")), lemmas.select(F.col("synset").alias("child"), F.col("lemma").alias("end"))
    rows = links.join(a, "parent").join(b, "child").select("rel", "start", "end")
    return rows.where((F.col("start") != F.col("end")) & (F.length("start") >= 2) & (F.length("end") >= 2))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


#: Folders of a stored map, each with the concepts of one hash.
BUCKETS = 64


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("concept"), F.lit(buckets)).cast("int").alias("bucket")


def changed_terms(before: DataFrame, after: DataFrame) -> DataFrame:
    """(concept): the terms of judgments(subject, verb, object, ...) that were taken away or came; a changed one is both."""
    gone, come = before.exceptAll(after), after.exceptAll(before)
    return gone.unionByName(come).select(F.explode(F.array("subject", "verb", "object")).alias("concept")).where("concept is not null").distinct()


def store_map(rhos: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes matrices (concept, n, rho) as a table in which a concept's folder is known from its name."""
    rhos.select("concept", "n", "rho", bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("concept string, n long, rho array<double>, bucket int").parquet(path).select("concept", "n", "rho")


def maintain(spark: SparkSession, path: str, parts: DataFrame, terms: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Brings a stored map up to date: only terms(concept) are summed again, from parts(concept, vector, w), the components that
    hold now; only folders with such a term are read and written. Returns these folders.

    The result is what a full rebuild gives. A term without components is taken out.
    """
    some = stage(terms.select("concept").distinct().select("concept", bucket(buckets)), "changed")
    touched = sorted(r.bucket for r in some.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return []
    old = spark.read.schema("concept string, n long, rho array<double>, bucket int").parquet(path).where(F.col("bucket").isin(touched))
    new = matrices(parts.join(some.select("concept"), "concept", "left_semi")).select("concept", "n", "rho", bucket(buckets))
    now = stage(old.join(some.select("concept"), "concept", "left_anti").select("concept", "n", "rho", "bucket").unionByName(new), "map")
    now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r.bucket for r in now.select("bucket").distinct().collect()}
    for b in touched:
        if b not in left:  # nothing is written to a folder that has become empty
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
