"""Chat exports, session logs and feedback: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.texts import burst_merge

MESSAGES = "messages array<struct<id:long,type:string,`from`:string,from_id:string,date:string,text:string>>"
SESSION = "ts double, role string, content string, focused_concept string"


def messages(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(chat, id, sender, ts, text) of chat exports: ordinary messages with text. text may be a string or a list of parts."""
    raw = spark.read.schema(MESSAGES).option("multiLine", True).json(path).select(F.input_file_name().alias("chat"), F.posexplode("messages").alias("pos", "m"))
    rows = raw.where("m.type = 'message'").select("chat", F.col("pos").cast("long").alias("id"), F.coalesce("m.from", "m.from_id", F.lit("")).alias("sender"), X.epoch(F.col("m.date")).alias("ts"), X.message_text(F.col("m.text"), separator).alias("text"))
    return rows.where("text <> ''")


def blocks(spark: SparkSession, path: str, window: float = 45.0, most: int = 0) -> DataFrame:
    """Burst-merged messages (chat, sender, ts, n, text); with `most`, the first so many of each chat."""
    out = burst_merge(messages(spark, path), window)
    if not most:
        return out
    from pyspark.sql import Window as W

    return out.withColumn("_rn", F.row_number().over(W.partitionBy("chat").orderBy("ts"))).where(F.col("_rn") <= most).drop("_rn")


def session(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION).json(path)


def append_session(rows: DataFrame, path: str) -> None:
    """Appends (ts, role, content, focused_concept) rows to a JSON-lines log."""
    rows.select("ts", "role", "content", "focused_concept").write.mode("append").json(path)


def triples(raw: DataFrame, column: str = "reply", text: str | None = None, least: int = 20) -> DataFrame:
    """(subject, verb, object, quality) from replies holding a JSON list, in code fences or not; quality is AFFIRMATIVE where
    it isn't given. With text, the column of what was replied to, only for texts of `least` characters or more."""
    if text is not None:
        raw = raw.where(F.length(F.trim(text)) >= least)
    bare = F.trim(F.regexp_replace(F.col(column), r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", ""))
    rows = raw.select("*", F.explode(F.from_json(bare, "array<struct<subject:string,verb:string,object:string,quality:string>>")).alias("t"))
    rows = rows.select(*raw.columns, "t.*").where("subject is not null and verb is not null and object is not null")
    return rows.withColumn("quality", F.coalesce("quality", F.lit("AFFIRMATIVE")))


def write_evaluation(selected: DataFrame, judgments: DataFrame, path: str) -> None:
    """Sentences to be reviewed: their texts as lines in `path`/sentences, and in `path`/gold one JSON line each with the
    judgments found in it and the status AUTO, or EMPTY where none was found.

    selected: sent_id, text, label, category; judgments: sent_id, subject, verb, object, quality.
    """
    selected.orderBy("label", "sent_id").select(F.col("text").alias("value")).write.mode("overwrite").text(f"{path}/sentences")
    found = judgments.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("subject", "verb", "object", "quality"))).alias("judgments"))
    gold = selected.join(found, "sent_id", "left").withColumn("status", F.when(F.col("judgments").isNull(), "EMPTY").otherwise("AUTO"))
    gold.orderBy("label", "sent_id").select("sent_id", "label", "category", "text", F.coalesce("judgments", F.array()).alias("judgments"), "status").write.mode("overwrite").json(f"{path}/gold")
