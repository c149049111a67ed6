"""Review questions and what their answers change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import PRIORITIES, Config
from . import density as D

#: Columns of a question: its type, priority, concepts, judgments and their texts.
COLUMNS = ("question_type", "priority", "concepts", "judgments", "source")


def question(kind: str, concepts: Column, judgments: Column, source: Column) -> list[Column]:
    return [F.lit(kind).alias("question_type"), F.lit(PRIORITIES[kind]).alias("priority"), concepts.alias("concepts"), judgments.alias("judgments"), source.alias("source")]


def both() -> Column:
    return F.array("subject", "object")


def anomaly_questions(judgments: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = judgments.where((F.col("anomaly") > cfg.anomaly_question) & (F.col("status") == "unreviewed") & ~F.col("archived"))
    return rows.select(*question("anomaly", both(), F.array("judgment_id"), F.col("source_text")))


def contradiction_questions(judgments: DataFrame, same_verb: bool = False) -> DataFrame:
    """Pairs of terms judged both ways, with the first judgment of each kind; with same_verb, by the same verb only."""
    first = {q: F.min(F.when(F.col("quality") == q, F.struct("seq", "judgment_id", "source_text"))).alias(q) for q in ("AFFIRMATIVE", "NEGATIVE")}
    rows = judgments.where(~F.col("archived")).groupBy("subject", "object", *(["verb"] if same_verb else [])).agg(*first.values()).where("AFFIRMATIVE is not null and NEGATIVE is not null")
    return rows.select(*question("contradiction", both(), F.array("AFFIRMATIVE.judgment_id", "NEGATIVE.judgment_id"), F.col("AFFIRMATIVE.source_text")))


def archive_questions(judgments: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = judgments.where(F.col("archived") & (F.col("weight") * F.col("activation") >= cfg.archive_question))
    return rows.select(*question("archive", both(), F.array("judgment_id"), F.col("source_text")))


def defeasible_questions(judgments: DataFrame) -> DataFrame:
    rows = judgments.where(F.col("defeasible") & (F.col("status") == "unreviewed") & ~F.col("archived"))
    return rows.select(*question("defeasible", both(), F.array("judgment_id"), F.col("source_text")))


def contrast_pairs(rhos: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(a, b, similarity) of pairs a < b alike but not too much."""
    rows = D.pairs(rhos).where("a < b").select("a", "b", D.similarity().alias("similarity"))
    return rows.where((F.col("similarity") > cfg.contrast_low) & (F.col("similarity") < cfg.contrast_high))


def contrast_questions(rhos: DataFrame, cfg: Config = Config()) -> DataFrame:
    none = F.array().cast("array<long>")
    return contrast_pairs(rhos, cfg).select(*question("contrast", F.array(F.col("a").cast("string"), F.col("b").cast("string")), none, F.lit("")))


def milestone_questions(parts: DataFrame, cfg: Config = Config(), step: int | None = None) -> DataFrame:
    """Concepts with exactly so many active components, or, with a step, so many and any number of steps more."""
    due = F.col("n") == cfg.milestone if step is None else (F.col("n") >= cfg.milestone) & ((F.col("n") - cfg.milestone) % step == 0)
    rows = parts.where(~F.col("archived")).groupBy("concept").agg(F.count("*").alias("n")).where(due)
    return rows.select(*question("milestone", F.array(F.col("concept").cast("string")), F.array().cast("array<long>"), F.lit("")))


def unique(questions: list[DataFrame], asked: DataFrame | None = None) -> DataFrame:
    """One question of each key, without those asked before. asked: key."""
    rows = questions[0]
    for q in questions[1:]:
        rows = rows.unionByName(q)
    key = F.concat_ws("|", "question_type", F.array_join(F.array_sort("concepts"), ","), F.substring("source", 1, 40))
    rows = rows.withColumn("key", key)
    if asked is not None:
        rows = rows.join(asked.select("key").distinct(), "key", "left_anti")
    once = rows.groupBy("key").agg(F.min(F.struct("judgments", "question_type", "priority", "concepts", "source")).alias("q"))
    return once.select("key", "q.*")


def ask(questions: list[DataFrame], asked: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The k questions of highest priority, one of each key, without those asked before."""
    out = unique(questions, asked).orderBy(F.desc("priority"), "key").limit(k)
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("priority"), "key")))


#: What an answer does to the question's first and second judgment, by question type and index. Answers that
#: aren't listed (skips, indexes out of range, contrasts, milestones) change nothing.
TRANSITIONS = {
    ("anomaly", 0): ("confirm",), ("anomaly", 1): ("reject",), ("anomaly", 2): ("contextualize",),
    ("contradiction", 0): ("confirm", "reject"), ("contradiction", 1): ("reject", "confirm"), ("contradiction", 2): ("contextualize", "contextualize"),
    ("archive", 0): ("reactivate",), ("archive", 1): ("disown",), ("archive", 2): ("reactivate_partly",),
    ("defeasible", 0): ("promote",), ("defeasible", 1): ("reject",),
}
STATUS = {"confirm": "confirmed", "promote": "confirmed", "reactivate": "confirmed", "reject": "rejected", "disown": "rejected", "contextualize": "contextualized", "reactivate_partly": "contextualized"}


def transitions(answers: DataFrame) -> DataFrame:
    """answers(question_type, answer_index, judgments, ts) -> events (judgment_id, action, ts)."""
    rows = answers.select("question_type", "answer_index", F.posexplode("judgments").alias("pos", "judgment_id"), "ts")
    action = F.lit(None).cast("string")
    for (kind, index), actions in TRANSITIONS.items():
        for pos, name in enumerate(actions):
            action = F.when((F.col("question_type") == kind) & (F.col("answer_index") == index) & (F.col("pos") == pos), name).otherwise(action)
    return rows.withColumn("action", action).where("action is not null").select("judgment_id", "action", "ts")


def apply(parts: DataFrame, events: DataFrame) -> DataFrame:
    """Components after events: subject and object sides of a judgment follow its last event, and are reinforced by each
    confirmation; verbs and [self] stay as they are.

    parts: judgment_id, role, status, archived, activation, ts, interpretation_layer, defeasible.
    """
    last = events.groupBy(F.col("judgment_id").alias("_j")).agg(F.max(F.struct("ts", "action")).alias("e"), F.count_if(F.col("action").isin("confirm", "promote")).alias("n"))
    rows = parts.join(last, F.col("judgment_id") == F.col("_j"), "left")
    act = F.when(F.col("role").isin("subject", "object"), F.col("e.action"))
    status = F.col("status")
    for a, s in STATUS.items():
        status = F.when(act == a, s).otherwise(status)
    woken = act.isin("reactivate", "reactivate_partly") & F.col("archived")
    more = F.when(act.isNotNull(), F.col("n")).otherwise(0) + F.when(woken, 1).otherwise(0)
    changed = {
        "status": status,
        "archived": F.when(act == "reject", True).when(woken, False).otherwise(F.col("archived")),
        "interpretation_layer": F.when(act == "promote", 0).otherwise(F.col("interpretation_layer")),
        "defeasible": F.when(act == "promote", False).otherwise(F.col("defeasible")),
        "activation": (F.col("activation") + more).cast("long"),
        "ts": F.when(act.isin("confirm", "promote") | woken, F.col("e.ts")).otherwise(F.col("ts")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in parts.columns])


def stats(parts: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row: component rows, reviewed ones and their share, by status."""
    return parts.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "unreviewed").alias("reviewed"), F.avg((F.col("status") != "unreviewed").cast("double")).alias("share"), *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "rejected", "contextualized")])


def focused_context(parts: DataFrame, concept, k: int = 5) -> DataFrame:
    """One row: the first k judgments of a concept as a text for a conversation."""
    rows = parts.where(F.col("concept") == F.lit(concept)).orderBy("seq").limit(k)
    line = F.concat_ws(" ", "subject", "verb", "object")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda s: s["line"]), "; ").alias("context"))


def trimmed_history(messages: DataFrame, most: int = 20, keep: int = 16) -> DataFrame:
    """Per conversation: all turns up to `most`, beyond that the first and the last `keep`. messages: conv_id, turn, ..."""
    w = W.partitionBy("conv_id")
    rows = messages.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("turn")))
    return rows.where((F.col("_n") <= most) | (F.col("_r") == 1) | (F.col("_r") > F.col("_n") - keep)).drop("_n", "_r")


def history(events: DataFrame) -> DataFrame:
    """One JSON line an event: type, judgment key, time, response and prompt, in order of time; (value)."""
    fields = ("event_type", "judgment_key", "ts", "user_response", "prompt")
    return events.orderBy("ts", "judgment_key").select(F.to_json(F.struct(*fields)).alias("value"))
