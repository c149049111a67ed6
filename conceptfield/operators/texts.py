"""Text operators over tables: bursts, segments, deduplication, sampling, spelling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def same_sender_runs(messages: DataFrame) -> DataFrame:
    """Adds run, numbering consecutive messages of one sender in each chat. messages: chat, sender, ts, id."""
    order = W.partitionBy("chat").orderBy("ts", "id")
    new = F.coalesce((F.lag("sender").over(order) != F.col("sender")).cast("int"), F.lit(1))
    return messages.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def burst_merge(messages: DataFrame, window: float = 45.0, least: int = 10) -> DataFrame:
    """Bursts (chat, sender, ts, n, text): a sender's consecutive messages less than `window` seconds after the first one.

    A message at an unknown time (0) joins no burst. Blocks shorter than `least` characters are dropped. A run of one
    sender's messages is folded where it is; a run never spans chats.
    """
    runs = same_sender_runs(messages).groupBy("chat", "sender", "run").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))).alias("m"))
    block = "array<struct<ts:double,n:int,text:string>>"

    def step(done, m):
        last = F.element_at(done, F.size(done))
        joins = (F.size(done) > 0) & (m["ts"] > 0) & (last["ts"] > 0) & (m["ts"] - last["ts"] < window)
        more = F.struct(last["ts"].alias("ts"), (last["n"] + 1).alias("n"), F.concat_ws("\n", last["text"], m["text"]).alias("text"))
        one = F.struct(m["ts"].alias("ts"), F.lit(1).alias("n"), m["text"].alias("text"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(one)))

    folded = runs.select("chat", "sender", F.explode(F.aggregate("m", F.array().cast(block), step)).alias("b"))
    return folded.select("chat", "sender", "b.*").where(F.length("text") >= least)


def segment(docs: DataFrame, segments, least: int = 0) -> DataFrame:
    """One row a segment, all other columns kept: pos and segment. segments is an array Column."""
    out = docs.select("*", F.posexplode(segments).alias("pos", "segment"))
    return out.where(F.length("segment") >= least) if least else out


def keep_first(rows: DataFrame, key, order: str) -> DataFrame:
    """The first row of each key, null orders first; combined where the rows are, so that a key of very many rows isn't sorted."""
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(order).isNotNull(), F.col(order)))
    return rows.groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")


def stratified_sample(rows: DataFrame, group: str, category: str, key: str, least: int = 3, most: int = 70) -> DataFrame:
    """`most` rows a group: first `least` of each category, then others, in the order of md5(key).

    No category gives more than `most` rows; those of each task that may be among them are all that is shuffled.
    """
    shuffled = F.md5(F.col(key).cast("string"))
    ranked = rows.withColumn("_h", shuffled).withColumn("_c", F.row_number().over(W.partitionBy(group, category).orderBy("_h", key))).where(F.col("_c") <= most)
    ranked = ranked.withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy((F.col("_c") > least).cast("int"), "_h", key)))
    return ranked.where(F.col("_g") <= most).withColumnRenamed("_g", "pick").drop("_h", "_c")


def spelling(words: DataFrame, dictionary: DataFrame, least: int = 5) -> DataFrame:
    """(word, fixed): unknown words of `least` letters or more become a dictionary word one edit away, the first by alphabet.

    One edit leaves either the first or the second half of a word in place, so candidates meet on length and one half.
    """
    def halves(df: DataFrame, name: str, lengths) -> DataFrame:
        size = F.explode(lengths).alias("size")
        cut = df.select(name, size)
        half = F.floor(F.col("size") / 2).cast("int")
        return cut.select(name, "size", F.explode(F.array(F.concat(F.lit("<"), F.substring(F.col(name), F.lit(1), half)), F.concat(F.lit(">"), F.reverse(F.substring(F.reverse(F.col(name)), F.lit(1), half))))).alias("half"))

    known = dictionary.select(F.col("word").alias("candidate")).distinct()
    size = F.length("candidate")
    right = halves(known, "candidate", F.array(size - 1, size, size + 1))
    unknown = words.select("word").distinct().join(known, F.col("word") == F.col("candidate"), "left_anti").where((F.length("word") >= least) & ~F.col("word").rlike(r"(?U)[^\p{L}]"))
    left = halves(unknown, "word", F.array(F.length("word")))
    near = left.join(right, ["size", "half"]).where(F.levenshtein("word", "candidate") <= 1)
    best = near.groupBy("word").agg(F.min("candidate").alias("fixed"))
    return words.select("word").distinct().join(best, "word", "left").select("word", F.coalesce("fixed", "word").alias("fixed"))


def words_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.split(X.squash_space(F.lower(F.col(text))), " ")).alias("word"))


def model_segments(docs: DataFrame, load, least: int = 5, prefixes=X.lexicons.SUBORDINATE_PREFIXES, text: str = "text") -> DataFrame:
    """One row a segment, all other columns kept, by a segmentation model.

    load() returns a function from a text to its segments; it is called once a task. Segments are stripped, joined to the
    one before where they begin with one of the prefixes, and dropped below `least` characters; a text that loses all
    stays whole.
    """
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield texts.map(lambda t: [str(s).strip() for s in model(t or "")])

    kept = F.filter(X.remerge(F.col("_segments"), prefixes), lambda s: F.length(s) >= least)
    rows = segment(docs.withColumn("_segments", split(F.col(text))), F.when(F.size(kept) > 0, kept).otherwise(F.array(text)))
    return rows.drop("_segments")
