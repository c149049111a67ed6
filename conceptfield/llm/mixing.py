"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, document after document, are cut into blocks of a fixed length. Every output shard draws a
multinomial sample of source counts, one draw for each of its slots; what the draws of all shards give a source above
its quota of slots passes to sources below theirs. A source's slots, numbered through all shards, are mapped to its
blocks by a pseudorandom permutation of block indexes (another one for each pass over the source), and blocks are
joined to slots by index. A source's short last block closes each pass, so words taken are known in closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, pick, plain, stage, text_or_empty

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A cycle of the permutation's walk leaves the block range with probability under 1/32 a step once this many steps could be needed.
WALKS = 32
ROUNDS = 4
#: Equal parts of the unit interval by which draws find their source.
BINS = 4096
#: Elements of an array that is made to be exploded, at most.
RUN = 10_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds weight and target to sizes(source, source_size), one row a source.

    Sources by code point, null last, weigh 5, 2, 1, repeating. All share `share` times the sum of sizes; a target
    stops at `cap` times its source's size and the excess is shared anew by weight. With the caps sorted by cap over
    weight, the stopped sources are the first ones, so the common rate of the others follows from running sums.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    rate = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("rate", rate).withColumn("stopped", F.col("rate") >= F.col("ratio"))
    free = F.min(F.when(~F.col("stopped"), F.struct("ratio", F.col("rate").alias("r")))).over(everything)
    return rows.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(free["r"] * F.col("weight"))).select("source", "source_size", "weight", "target")


def permuted(index: Column, size: Column, key: Column) -> Column:
    """Image of index under a pseudorandom permutation of 0 .. size-1 chosen by key.

    A Feistel network over a grid of a x b >= size cells, walked on until it lands below size. At most a - 1 cells
    are outside, so WALKS steps suffice for sizes to 1,024, and beyond that fail with probability under 2**-160.
    """
    def step(x: Column, a: Column, b: Column) -> Column:
        left, right = F.floor(x / b), F.pmod(x, b)
        for i in range(ROUNDS):
            if i % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(i)), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(i)), a), a)
        return left * b + right

    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), step(index, a, b), lambda x, _: F.when(x < size, x).otherwise(step(x, a, b)))
    return F.when(size <= 1, F.lit(0).cast("long")).otherwise(walked.cast("long"))


def counted(n: Column, *keep: str):
    """Columns that explode to 0 .. n-1 as `at`, for any n: two steps, so that no array is longer than RUN."""
    def apply(rows: DataFrame) -> DataFrame:
        steps = rows.withColumn("of", n).where("of > 0").select(*keep, "of", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("of") - 1) / RUN))).alias("step"))
        return steps.select(*keep, F.explode(F.sequence(F.col("step") * RUN, F.least(F.col("of"), (F.col("step") + 1) * RUN) - 1)).alias("at"))

    return apply


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, hash, nth, size) of docs(doc_id, text, source), staged; hash is the text's.

    The first four tell rows apart by content, nth numbering equal ones, so however the table is split, the same rows
    have the same keys. Equal rows are combined before the shuffle.
    """
    rows = pick(docs, "doc_id", "text", "source").withColumn("text", text_or_empty())
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("hash"), n_words(F.col("text")).alias("size"))
    alike = rows.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n"))
    return stage(alike.transform(counted(F.col("n"), "doc_id", "source", "hash", "size")).withColumnRenamed("at", "nth"), "sized")


def placed(rows: DataFrame, per_part: int = 1 << 16) -> DataFrame:
    """Adds start, the words of the same source before the document, in an order that content alone decides; a source of
    any size is summed in parts of about per_part documents."""
    parts = max(1, rows.count() // per_part)
    part = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "hash", "nth"), F.lit(parts)))
    key = F.struct("source").alias("source")  # a struct is never null
    sums = part.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.select(key.alias("k"), F.col("part").alias("p"), "ahead")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "part").orderBy("doc_id", "hash", "nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = part.withColumn("inside", inside).join(ahead, (F.struct("source") == F.col("k")) & (F.col("part") == F.col("p")))
    return both.select("doc_id", "source", "hash", "nth", "size", (F.col("ahead") + F.col("inside")).alias("start"))


def slots(shares: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """The mixture: (shard, slot, sid, pass, at, block, words) for every slot of every output shard; at is the block's turn in its pass.

    shares has sid, source_size and quota (words to take) of each source.
    """
    spark = shares.sparkSession
    full, last = F.floor(F.col("source_size") / block), F.pmod(F.col("source_size"), F.lit(block))
    per_pass = full + F.when(last > 0, 1).otherwise(0)
    passes, over = F.floor(F.col("quota") / F.col("source_size")), F.pmod(F.col("quota"), F.col("source_size"))
    need = passes * per_pass + F.least(F.ceil(over / block), per_pass)
    shares = stage(shares.where("quota > 0").select("sid", "source_size", "quota", full.cast("long").alias("full"), per_pass.cast("long").alias("per_pass"), need.cast("long").alias("need")), "shares")
    n = shares.agg(F.sum("need")).first()[0] or 0
    # Multinomial draws: each slot of each shard draws its source with probability in proportion to the slots needed.
    run = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    low = F.coalesce(F.sum("need").over(run), F.lit(0)) / F.lit(float(max(n, 1)))
    spans = shares.select("sid", low.alias("low"), (low + F.col("need") / F.lit(float(max(n, 1)))).alias("high"))
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * BINS), F.floor(F.least(F.col("high"), F.lit(1 - 1e-12)) * BINS))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "g"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = spark.range(n).withColumnRenamed("id", "g").withColumn("u", draw).withColumn("b", F.floor(F.col("u") * BINS))
    drawn = drawn.join(spans, (F.col("b") == F.col("bin")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")), "left")
    first = shares.agg(F.max("sid")).first()[0] if n else 0  # rounding can leave a draw above the last span
    drawn = stage(drawn.select("g", F.floor(F.col("g") / shard_slots).alias("shard"), F.coalesce("sid", F.lit(first)).alias("sid")), "drawn")
    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    ahead = counts.select(F.col("sid").alias("s"), F.col("shard").alias("h"), F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(W.partitionBy("sid", "shard").orderBy("g")) - 1
    numbered = drawn.withColumn("nth", nth).join(ahead, (F.col("sid") == F.col("s")) & (F.col("shard") == F.col("h"))).withColumn("k", F.col("ahead") + F.col("nth"))
    # Reconcile: draws beyond a source's need pass, in order, to the sources that lack as many.
    got = shares.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("need"), F.lit(0))).withColumn("lack", F.greatest(F.col("need") - F.col("got"), F.lit(0)))
    got = stage(got.withColumn("over_at", F.coalesce(F.sum("over").over(run), F.lit(0))).withColumn("lack_at", F.coalesce(F.sum("lack").over(run), F.lit(0))), "drawn-counts")
    lacking = got.transform(counted(F.col("lack"), "sid", "got", "lack_at")).select(F.col("sid").alias("to_sid"), (F.col("got") + F.col("at")).alias("to_k"), (F.col("lack_at") + F.col("at")).alias("i"))
    mine = numbered.join(got.select(F.col("sid").alias("s2"), "need", "over_at"), F.col("sid") == F.col("s2"))
    kept = mine.where("k < need").select("shard", "g", "sid", "k")
    moved = mine.where("k >= need").withColumn("j", F.col("over_at") + F.col("k") - F.col("need")).join(lacking, F.col("j") == F.col("i")).select("shard", "g", F.col("to_sid").alias("sid"), F.col("to_k").alias("k"))
    mixed = kept.unionByName(moved).join(shares.withColumnRenamed("sid", "s3"), F.col("sid") == F.col("s3"))
    turn, at = F.floor(F.col("k") / F.col("per_pass")), F.pmod(F.col("k"), F.col("per_pass"))
    image = F.when(at < F.col("full"), permuted(at, F.col("full"), F.xxhash64(F.lit(seed), "sid", turn))).otherwise(F.col("full"))
    before = turn * F.col("source_size") + at * block
    words = F.least(F.least(F.lit(block), F.col("source_size") - at * block), F.col("quota") - before)
    return mixed.select("shard", F.pmod(F.col("g"), F.lit(shard_slots)).alias("slot"), "sid", turn.alias("pass"), at.alias("at"), image.alias("block"), words.alias("words"))


def drawn_wholes(known: DataFrame, picked: DataFrame, block: int, per_part: int = 1 << 12) -> DataFrame:
    """(sid, start, goes): whether a document goes whole in the last, partial pass over its source, as the drawn blocks decide.

    known: sid, start, size, source_size, turn (the number of that pass) and over (its words). A document belongs to the
    block that its middle is in. Documents go in the order in which their blocks were drawn until the pass has its words;
    if those of drawn blocks don't suffice, blocks that weren't drawn follow. A document goes if its middle comes before
    the pass's end, so a source's words differ from it by half its longest document at most. Blocks are added up in parts
    of per_part, so a source of any size isn't one task's.
    """
    rows = known.where("size > 0 and over > 0").select("sid", "start", "size", "source_size", "turn", "over", F.floor((2 * F.col("start") + F.col("size")) / (2 * block)).alias("home"))
    turns = picked.select(F.col("sid").alias("s"), F.col("pass").alias("p"), F.col("block").alias("b"), "at")
    met = rows.join(turns, (F.col("sid") == F.col("s")) & (F.col("turn") == F.col("p")) & (F.col("home") == F.col("b")), "left")
    place = F.coalesce("at", F.ceil(F.col("source_size") / block) + F.col("home"))
    met = met.select("sid", "start", "size", "over", place.alias("place"), F.floor(place / per_part).alias("part"))
    before = W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = met.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    ahead = sums.select("sid", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("sid", "part").orderBy("place", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = met.withColumn("inside", inside).join(ahead, ["sid", "part"])
    return both.select("sid", "start", (2 * (F.col("ahead") + F.col("inside")) + F.col("size") < 2 * F.col("over")).alias("goes"))


def mix(docs: DataFrame, block: int = 256, shard_slots: int = 4096, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> dict[str, DataFrame]:
    """Mixes docs(doc_id, text, source) to the targets of `targets`.

    Returns three tables: "sources" (sid, source, source_size, weight, target), "slots" (shard, slot, sid, pass, at,
    block, words: what each slot of the mixture takes) and "documents" (doc_id, source, hash, nth, size, source_size, target,
    taken, passes: for each pass over the source, the document's size if whole documents go by it, else 0). The words
    taken of a source are its target rounded down to a whole word; a document is taken at most twice when cap is 2.

    Null text has size 0, a null source is a source of its own, repeated rows are documents of their own, documents
    without words are taken 0 times, an empty table gives empty tables; other columns are ignored. Content alone decides:
    the same rows give the same mixture, however the table is split or ordered. Sources are names, few enough for one
    task to order; their documents, blocks and slots are not.
    """
    rows = stage(placed(sized(docs)), "placed")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, share, cap).withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")).cast("long"))
    sources = stage(sources, "sources")
    picked = stage(slots(sources.select("sid", "source_size", F.floor("target").cast("long").alias("quota")), block, shard_slots, seed), "slots")
    known = rows.join(sources.select(F.struct("source").alias("k"), "sid", "source_size", "target"), F.struct("source") == F.col("k")).drop("k")
    # A document's words lie in blocks start/block .. (start+size-1)/block of its source; a source's starts differ.
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = known.where("size > 0").withColumn("first", first).transform(counted(last - first + 1, "sid", "start", "size", "first")).withColumn("block", F.col("first") + F.col("at"))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    spans = spread.select("sid", "start", "block", begin.alias("begin"), end.alias("end"))
    hits = spans.join(picked.select(F.col("sid").alias("s"), F.col("block").alias("b"), "pass", "words"), (F.col("sid") == F.col("s")) & (F.col("block") == F.col("b")))
    part = F.greatest(F.least("end", "words") - F.col("begin"), F.lit(0))
    quota, around = F.floor("target").cast("long"), F.greatest("source_size", F.lit(1))
    turned = known.withColumn("turn", F.floor(quota / around)).withColumn("over", F.pmod(quota, around))
    wholes = drawn_wholes(turned, picked, block).withColumn("part", F.lit(0).cast("long"))
    both = hits.select("sid", "start", part.alias("part"), F.lit(False).alias("goes")).unionByName(wholes)
    taken = both.groupBy("sid", "start").agg(F.sum("part").alias("taken"), F.max("goes").alias("goes")).select(F.col("sid").alias("s"), F.col("start").alias("r"), "taken", "goes")
    out = turned.join(taken, (F.col("sid") == F.col("s")) & (F.col("start") == F.col("r")) & (F.col("size") > 0), "left")
    none = F.lit(0).cast("long")
    passes = F.array(*[F.when((F.col("turn") > i) | (F.col("turn") == i) & F.coalesce("goes", F.lit(False)), F.col("size")).otherwise(none) for i in range(math.ceil(cap))])
    documents = out.select("doc_id", "source", "hash", "nth", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), passes.alias("passes"))
    return {"sources": sources, "slots": picked, "documents": documents}


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with a row for each pass over a source by which a document goes.

    Documents go whole, none is torn: those of the blocks that the mixture draws, in the order in which they are drawn; a
    source's words differ from its target by half its longest document at most. Documents without words (null and empty texts) are no part of a mixture of words and don't appear. A null
    source is a source of its own. Rows are told apart by doc_id, which may be null or repeat, source and text; of rows
    equal in all three each goes as often as the next, or once more. An empty table gives an empty one; columns may have
    any names, and the result has docs' columns.
    """
    taken = mix(docs, **options)["documents"].where("size > 0")
    goes = F.size(F.filter("passes", lambda p: p > 0))
    times = stage(taken.groupBy("doc_id", "source", "hash").agg(F.sum(goes).alias("times"), F.count("*").alias("alike")).where("times > 0"), "times")
    rows, at = plain(docs)
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    rows = rows.withColumn("key", F.struct(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.xxhash64(text).alias("hash")))
    met = rows.join(times.select(F.struct("doc_id", "source", "hash").alias("k"), "times", "alike").hint("merge"), F.col("key") == F.col("k"))
    both = met.where("alike = 1").withColumn("mine", F.col("times"))
    if not times.where("alike > 1").isEmpty():  # rows of equal doc_id, source and text
        nth = F.row_number().over(W.partitionBy("key").orderBy(*[c for c, t in rows.drop("key").dtypes if "map<" not in t]))
        several = met.where("alike > 1").withColumn("nth", nth)
        mine = F.floor(F.col("times") / F.col("alike")) + F.when(F.col("nth") <= F.col("times") % F.col("alike"), 1).otherwise(0)
        both = both.unionByName(several.withColumn("mine", mine).drop("nth"))
    return both.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("mine").cast("int")))).select(*[c for c in rows.columns if c != "key"]).toDF(*docs.columns)
