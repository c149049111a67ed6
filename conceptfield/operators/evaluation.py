"""Evaluation of extracted judgments and of the normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_match

FIELDS = ("subject", "verb", "object", "quality")


def matched(extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """(sent_id, gold, extracted, tp): per sentence the numbers of both and of matches, made greedily in the gold's order.

    Both: sent_id, pos, subject, verb, object, quality. A sentence has a handful of each, which meet in one row.
    """
    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), *FIELDS))).alias(name))

    both = lists(gold, "g").join(lists(extracted, "e"), "sent_id", "full")
    none = F.array().cast("array<long>")

    def step(used, g):
        fits = F.filter("e", lambda x: ~F.array_contains(used, x["pos"]) & (x["quality"] == g["quality"]) & fuzzy_match(x["subject"], g["subject"]) & fuzzy_match(x["object"], g["object"]) & fuzzy_match(x["verb"], g["verb"]))
        return F.when(F.size(fits) > 0, F.concat(used, F.array(F.element_at(fits, 1)["pos"]))).otherwise(used)

    tp = F.coalesce(F.size(F.aggregate(F.col("g"), none, step)), F.lit(0))
    return both.select("sent_id", F.when(F.col("g").isNull(), 0).otherwise(F.size("g")).alias("gold"), F.when(F.col("e").isNull(), 0).otherwise(F.size("e")).alias("extracted"), F.when(F.col("g").isNull() | F.col("e").isNull(), 0).otherwise(tp).alias("tp"))


def scores(per_sentence: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1."""
    s = per_sentence.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gold", "extracted", "tp")])
    p, r = F.col("tp") / F.greatest(F.col("extracted"), F.lit(1)), F.col("tp") / F.greatest(F.col("gold"), F.lit(1))
    return s.select("gold", "extracted", "tp", (F.col("extracted") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"))


def calibration(cases: DataFrame, normalised) -> DataFrame:
    """One row: cases(original, expected) that pass, fail, or are still to do: left alone where a change is expected. A null
    expectation means no change."""
    want, got = F.coalesce("expected", "original"), normalised
    verdict = F.when(got == want, "pass").when(got == F.col("original"), "todo").otherwise("fail")
    return cases.select(verdict.alias("v")).agg(*[F.count_if(F.col("v") == v).alias(v) for v in ("pass", "fail", "todo")], F.count("*").alias("total"))
