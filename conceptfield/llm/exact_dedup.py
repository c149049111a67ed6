"""Exact dedup as a log-structured merge index, in DataFrame operations only.

* Memtable flush: every input task writes its digests as one run, sorted by digest, with Parquet's min/max statistics
  and Bloom filters on the digest column.
* Compaction, level by level: FAN runs of a level become one run of the next. A filter of the level, a bitmap of
  bounded size over the digests that the merged runs hold more than once, is probed first: digests that it rules out
  pass to the next level where they are, only the others are merged, and the smallest identifier and the number of
  rows stay. Rows are combined before the shuffle, so a text that fills a third of the corpus costs one row a task.
* Hits (digests of more than one row in the last run) receive byte verification: the texts behind them are compared by
  their bytes. Digests that turn out to hold different texts are resolved by text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bitmap_of, bits_for, keep_rows, lookup, maybe, pick, plain, shared_dir, stage, without

#: Runs of a level that are merged into one of the next.
FAN = 256


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, bits: int) -> DataFrame:
    """Adds norm (the normalised text), text_sha256 and digest (its first `bits` bits)."""
    rows = docs.withColumn("norm", normalised(F.col("text"))).withColumn("text_sha256", F.sha2("norm", 256))
    return rows.withColumn("digest", F.col("text_sha256") if bits >= 256 else F.substring("text_sha256", 1, max(1, bits // 4)))


def flush(docs: DataFrame, bits: int = 256) -> DataFrame:
    """Level-0 runs (run, doc_id, digest, text_sha256): each input task writes one sorted run with a Bloom filter; no shuffle."""
    rows = digests(docs, bits).select(F.spark_partition_id().alias("run"), "doc_id", "digest", "text_sha256").sortWithinPartitions("digest", "doc_id")
    path = f"{shared_dir(rows.sparkSession)}/run-{uuid.uuid4().hex}"
    rows.write.option("parquet.bloom.filter.enabled#digest", "true").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def merge_level(level: DataFrame, fan: int) -> DataFrame:
    """The next level of level(run, digest, keep_id, group_size): runs of `fan` merged into one, sorted."""
    level = level.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
    again = stage(level.groupBy(F.xxhash64("run", "digest").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"), "filter")
    exponent = bits_for(again.count())
    probed = maybe(level.withColumn("h", F.xxhash64("run", "digest")), ["h"], bitmap_of(again, exponent), exponent)
    alone, rest = probed.where("not _may").select(*level.columns), probed.where("_may")
    merged = rest.groupBy("run", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return stage(alone.unionByName(merged).sortWithinPartitions("run", "digest"), "level")


def compact(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """The last run (digest, keep_id, group_size) of runs(run, doc_id, digest), one row a digest."""
    level = runs.select("run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        level, left = merge_level(level, fan), -(-left // fan)
        if left == 1:
            return level.select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, digest_bits: int = 256, fan: int = FAN) -> DataFrame:
    """Marks every document of docs(doc_id, text) with the row that stays for its text.

    Texts are equal when identical after normalisation. Returns one row for each input row: doc_id, keep_id
    (the group's smallest doc_id), group_size, kept (keep_id = doc_id), text_sha256. A null text counts as empty. A
    null doc_id counts as larger than any other. Rows that repeat doc_id and text get equal answers. An empty table
    gives an empty result; columns other than doc_id and text are ignored.

    digest_bits below 256 shortens the digest, so that tests can force collisions; verification by bytes resolves them.
    """
    docs = pick(docs, "doc_id", "text")
    runs = flush(docs, digest_bits)
    hits = compact(runs, fan).where("group_size > 1")
    n, total = hits.agg(F.count("*"), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    exponent = bits_for(n)
    probed = maybe(runs.drop("run"), ["digest"], bitmap_of(hits.select("digest"), exponent), exponent)
    unmet = probed.where("not _may").drop("_may").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    met = lookup(probed.where("_may").drop("_may"), hits, ["digest"], "group_size", total, F.xxhash64("doc_id"))
    met = met.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    marks = stage(unmet.unionByName(met), "marks")
    # Byte verification: only texts whose row was hit are read again; equal ones of a task are one before the shuffle.
    ids = marks.where("group_size > 1").select("doc_id")
    exponent = bits_for(total)
    hit = maybe(docs, ["doc_id"], bitmap_of(ids, exponent), exponent).where("_may").select("doc_id", "text")
    texts = digests(hit, digest_bits).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clash = stage(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "clash")
    if not clash.isEmpty():
        wrong = digests(docs, digest_bits).join(clash, "digest", "left_semi")
        by_text = wrong.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        solved = wrong.join(by_text, ["digest", "norm"]).select("doc_id", "digest", "text_sha256", "keep_id", "group_size")
        marks = marks.join(clash, "digest", "left_anti").unionByName(solved)
    return marks.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row for each text, all columns: the row of the smallest doc_id.

    Null text is empty; a null doc_id is larger than any other; of rows equal in doc_id and text the first by their
    other columns stays. An empty table gives an empty one; columns may have any names.
    """
    every = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    every = stage(every, "marks")
    if every.groupBy("doc_id").agg(F.count("*").alias("of"), F.max("n").alias("n")).where("of > 1 or n > 1 or doc_id is null").isEmpty():
        return without(docs, every.where("not kept").select("doc_id"))
    _, at = plain(docs)
    key = F.struct(F.col(at["doc_id"]).alias("doc_id"), F.sha2(normalised(F.col(at["text"])), 256).alias("text_sha256"))
    mark = F.struct("doc_id", "text_sha256")
    return keep_rows(docs, key, every.where("not kept").select(mark), every.where("kept and n > 1").select(mark))
