"""What sentences say of one another: pronouns resolved by a look-back over a conversation, and rankings by comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stage


def resolved(pronouns: DataFrame, mentions: DataFrame, reach: int = 3) -> DataFrame:
    """pronouns(chat, seq, i, agreement) with found, 0, 1 or 2 (several), and term, the antecedent if there is exactly one.

    Candidates are the different terms of mentions(chat, seq, i, agreement, term) that agree and stand before the pronoun, in
    its sentence or one of the `reach` sentences before; seq numbers a chat's sentences. Better no link than a wrong one.

    The look-back is a join on stretches of sentences: a mention belongs to its own and the next, so that a chat of any
    length is many keys. That all candidates are one term is seen from the least and the greatest, so none are gathered.
    Rows with a null chat, seq or agreement meet nothing.
    """
    width = max(1, reach)
    stretch = F.floor(F.col("seq") / width)
    keys = ["chat", "seq", "i", "agreement"]
    heard = mentions.select("chat", "agreement", F.col("seq").alias("_s"), F.col("i").alias("_i"), "term").groupBy("chat", "agreement", "_s", "term").agg(F.min("_i").alias("_i"))
    heard = heard.withColumn("_at", F.explode(F.array(F.floor(F.col("_s") / width), F.floor(F.col("_s") / width) + 1)))
    asked = pronouns.select(*keys).distinct().withColumn("_at", stretch)
    near = asked.join(heard, ["chat", "agreement", "_at"]).where((F.col("_s") >= F.col("seq") - reach) & ((F.col("_s") < F.col("seq")) | ((F.col("_s") == F.col("seq")) & (F.col("_i") < F.col("i")))))
    ends = near.groupBy(*keys).agg(F.min("term").alias("_low"), F.max("term").alias("_high"))
    rows = pronouns.join(ends, keys, "left")
    one = F.col("_low") == F.col("_high")
    return rows.select(*pronouns.columns, F.when(F.col("_low").isNull(), 0).when(one, 1).otherwise(2).alias("found"), F.when(one, F.col("_low")).alias("term"))


def comparisons(said: DataFrame) -> DataFrame:
    """Both directed edges (subject, object, dimension, comparison, direction) of said(a, b, dimension, comparator): what is
    compared with itself, or by another sign than > and <, gives none."""
    rows = said.where(F.col("comparator").isin(">", "<") & (F.col("a") != F.col("b")))
    other = F.when(F.col("comparator") == ">", "<").otherwise(">")
    one = rows.select(F.col("a").alias("subject"), F.col("b").alias("object"), "dimension", F.lit(True).alias("comparison"), F.col("comparator").alias("direction"))
    return one.unionByName(rows.select(F.col("b").alias("subject"), F.col("a").alias("object"), "dimension", F.lit(True).alias("comparison"), other.alias("direction")))


def above(edges: DataFrame) -> DataFrame:
    """(dimension, a, b): a is above b in more comparisons than below it. edges as `comparisons` gives them."""
    votes = edges.where("subject < object").groupBy("dimension", "subject", "object").agg(F.sum(F.when(F.col("direction") == ">", 1).otherwise(-1)).alias("n")).where("n <> 0")
    return votes.select("dimension", F.when(F.col("n") > 0, F.col("subject")).otherwise(F.col("object")).alias("a"), F.when(F.col("n") > 0, F.col("object")).otherwise(F.col("subject")).alias("b"))


def peeled(edges: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """((dimension, term, level), rest): terms without an edge that starts (end "a") or ends (end "b") at them go first, then those
    that this frees, round by round; rest are the edges that never go: they lie on cycles or lead to one."""
    other = "b" if end == "a" else "a"

    def terms(e: DataFrame, side: str) -> DataFrame:
        return e.select("dimension", F.col(side).alias("term")).distinct()

    rest, levels, level = stage(edges, "edges"), None, 0
    waiting = stage(terms(rest, "a").unionByName(terms(rest, "b")).distinct(), "terms")
    while True:
        free = stage(waiting.join(terms(rest, end), ["dimension", "term"], "left_anti"), "free")
        if free.isEmpty():
            break
        levels = free.withColumn("level", F.lit(level)) if levels is None else levels.unionByName(free.withColumn("level", F.lit(level)))
        waiting = stage(waiting.join(free, ["dimension", "term"], "left_anti"), "terms")
        rest = stage(rest.join(free.withColumnRenamed("term", other), ["dimension", other], "left_anti").select("dimension", "a", "b"), "edges")
        level += 1
    if levels is None:
        levels = waiting.limit(0).withColumn("level", F.lit(0))
    return levels, rest


def ranking(edges: DataFrame) -> DataFrame:
    """(dimension, term, level, cycle) of all compared terms: level is the longest way down, 0 for terms above none; null for
    terms on a cycle or above one. cycle holds for terms on cycles, or between two.

    A round of the peeling takes a level off all dimensions at once, by joins; there are as many as the longest way is long.
    """
    net = stage(above(edges), "above")
    levels, rest = peeled(net, "a")
    _, caught = peeled(rest, "b")
    known = net.select("dimension", F.explode(F.array("a", "b")).alias("term")).distinct()
    knots = caught.select("dimension", F.explode(F.array("a", "b")).alias("term")).distinct().withColumn("_in", F.lit(True))
    return known.join(levels, ["dimension", "term"], "left").join(knots, ["dimension", "term"], "left").select("dimension", "term", "level", F.coalesce("_in", F.lit(False)).alias("cycle"))
