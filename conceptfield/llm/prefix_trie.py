"""Prefix trie of conversations: chained SHA-256 digests name prefixes, nodes are groups of (depth, digest).

Turns shrink to a digest of role and text and a number of words before anything is shuffled. They are put in order by
range, so that a conversation of very many turns is many partitions; its turns are chained in blocks of BLOCK, each from
a start that the digests of the blocks before it decide. Every prefix of every conversation is one row; rows of equal
(depth, digest) are a node, combined before the shuffle, so that the root and popular first turns are no hot groups.

Sums over subtrees go from nodes to all their ancestors. Nodes that share their smallest member lie on one path, the end
of that member's own; their values are added up along it first, so each ancestor gets one row of them, and the rows are
as many as prefixes, not as many as pairs of nodes and ancestors.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, pick, stage
from .mixing import n_words

#: Turns of a conversation that are chained at once; ids joined at once for a node's digest.
BLOCK, IDS = 1024, 4096
#: Digest of the empty prefix.
ROOT = bytes(32)
NODE = ["depth", "digest"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, td, words, at): turns as digests, numbered by `at` in the order of conversation, turn, role and digest."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    td = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").try_cast("long").alias("conv"), "turn", role.alias("role"), td.alias("td"), n_words(text).alias("words"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "td", "tie"]  # the tie parts equal rows, of which there may be many
    rows = rows.where("conv is not null").withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(rows.select("conv", "td", "words", F.monotonically_increasing_id().alias("at")), "turns")


def rebuilt(conversations: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % group, h = crc32(c) % most.

    Returns rows(conv, depth, td, words, len) and lengths(conv, len), the latter with a row for each conversation.
    """
    turns = ordered_turns(conversations).withColumn("part", F.shiftright("at", 33))
    pieces = stage(turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "pieces")
    sizes = pieces.groupBy("conv").agg(F.sum("n").alias("n"))
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    lengths = sizes.withColumn("h", h).join(heads, F.col("conv") - F.col("conv") % group == F.col("base"), "left")
    lengths = lengths.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    lengths = stage(lengths.select("conv", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "lengths")
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("before", before).join(lengths, "conv").drop("n")
    numbered = turns.join(placed, ["conv", "part"]).withColumn("k", F.col("at") - F.col("first") + 1 + F.col("before"))
    own = numbered.where("k > h").select("conv", (F.col("taken") + F.col("k") - F.col("h")).alias("depth"), "td", "words", "len")
    firsts = numbered.where((F.col("conv") % group == 0) & (F.col("k") < most)).select(F.col("conv").alias("base"), "k", "td", "words")
    borrowed = lengths.where("taken > 0").join(firsts, (F.col("conv") - F.col("conv") % group == F.col("base")) & (F.col("k") <= F.col("h")))
    return own.unionByName(borrowed.select("conv", F.col("k").alias("depth"), "td", "words", "len")), lengths.select("conv", "len")


def block_starts(blocks: DataFrame, block: int) -> DataFrame:
    """(conv, block, start) of all blocks but the first of each conversation: a chain over digests of whole blocks.

    A block's start is the digest of the prefix before it, so that parents are known within a block."""
    whole = blocks.where(F.size("turns") == block).select("conv", "block", F.unhex(F.sha2(F.aggregate(F.transform("turns", lambda t: t["td"]), F.lit(b""), lambda a, b: F.concat(a, b)), 256)).alias("bd"))
    lists = whole.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "bd"))).alias("bds"))  # one in `block` turns

    def run(batches):
        for batch in batches:
            out = []
            for conv, bds in zip(batch.column("conv").to_pylist(), batch.column("bds").to_pylist(), strict=True):
                start = ROOT
                for b in bds:
                    start = hashlib.sha256(start + b["bd"]).digest()
                    out.append((conv, b["block"] + 1, start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "block", "start"])

    return lists.mapInArrow(run, "conv long, block long, start binary")


def prefixes(rows: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """(conv, depth, digest, parent, words, last): every prefix of every conversation, the empty one included."""
    def blocks_of(r: DataFrame) -> DataFrame:
        r = r.withColumn("block", F.floor((F.col("depth") - 1) / block).cast("long"))
        return r.groupBy("conv", "block").agg(F.max("len").alias("len"), F.array_sort(F.collect_list(F.struct("depth", "td", "words"))).alias("turns"))

    blocks = blocks_of(rows).withColumn("start", F.lit(None).cast("binary"))
    if (lengths.agg(F.max("len")).first()[0] or 0) > block:
        starts = block_starts(blocks_of(rows.where(F.col("len") > block)), block)
        blocks = blocks.drop("start").join(starts, ["conv", "block"], "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start = digest = r["start"] or ROOT
                for t in r["turns"]:
                    whole = t["depth"] % block == 0
                    step = start + hashlib.sha256(b"".join(u["td"] for u in r["turns"])).digest() if whole else digest + t["td"]
                    parent, digest = digest, hashlib.sha256(step).digest()
                    out.append((r["conv"], t["depth"], digest, parent, t["words"], t["depth"] == r["len"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "depth", "digest", "parent", "words", "last"])

    chained = blocks.select("conv", "len", "turns", "start").mapInArrow(run, "conv long, depth long, digest binary, parent binary, words long, last boolean")
    empty = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), (F.col("len") == 0).alias("last"))
    return stage(chained.unionByName(empty), "prefixes")


def joined_ids(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of ends(depth, digest, conv): ids sorted by range and joined in chunks, which one task a node only hashes."""
    order = [*NODE, "conv"]
    names = ["depth", "digest", "first", "ids"]

    def chunks(batches):
        node, held = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([held[0]]), pa.array([",".join(map(str, held))])], names)

        for batch in batches:
            out = []
            for depth, digest, conv in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if held and (node != (depth, digest) or len(held) >= IDS):
                    out.append(row())
                    held = []
                node = (depth, digest)
                held.append(conv)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield row()

    def hashes(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for depth, digest, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
                if node == (depth, digest):
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, digest), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, digest binary, first long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashes, "depth long, digest binary, ends_sha256 string")


def subtree_sums(paths: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(depth, digest, n_leaves, saved_tokens): what each node's subtree adds up to."""
    values = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    zero = F.lit(0).cast("long")
    own = paths.select("conv", "depth", "digest", F.floor(F.col("depth") / block).alias("block")).join(values, ["conv", "depth"], "left")
    own = own.withColumn("saved", F.coalesce("saved", zero)).withColumn("leaf", F.coalesce("leaf", zero))
    down = W.partitionBy("conv", "block").orderBy(F.desc("depth"))
    out = own.withColumn("saved", F.sum("saved").over(down)).withColumn("leaf", F.sum("leaf").over(down))
    if (paths.agg(F.max("depth")).first()[0] or 0) >= block:
        later = W.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
        after = own.groupBy("conv", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l")).select("conv", "block", F.sum("s").over(later).alias("s"), F.sum("l").over(later).alias("l"))
        out = out.join(after, ["conv", "block"], "left").withColumn("saved", F.col("saved") + F.coalesce("s", zero)).withColumn("leaf", F.col("leaf") + F.coalesce("l", zero))
    return out.where("saved > 0 or leaf > 0").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def conversation_trie(conversations: DataFrame, group: int = 20, most: int = 4, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations(conv_id, turn, role, text): one row for each distinct prefix.

    Conversation c is rebuilt as the first h turns of conversation c - c % group (all if it has fewer, none if there is
    none) and its own turns after its first h, h = crc32 of c's decimals % `most`; most=1 leaves all as they are. Returns
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that sharing
    prefixes saves in the subtree), ends_sha256 (of the ids of the members that end at the node) and digest.

    Odd cases: turns go by number, null first, then by role and by the digest of role and text; rows that are equal in
    all of these are turns each. Null roles and texts are empty. Rows whose conv_id is null or no whole number belong to
    no conversation; an empty table gives no node. Remainders have the sign of c. Other columns are ignored.
    """
    rows, lengths = rebuilt(conversations, group, most)
    paths = prefixes(rows, lengths, block)
    ends_here = F.when(F.col("last"), F.col("conv"))
    found = paths.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("parent").alias("parent"), F.count(ends_here).alias("n_ends"), F.min(ends_here).alias("end"))
    found = stage(found, "nodes")
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = stage(found.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie")
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    out = lookup(nodes, above, ["depth", "parent"], "siblings", nodes.count(), F.xxhash64("digest"))
    out = out.join(subtree_sums(paths, nodes, block), NODE).join(joined_ids(paths.where("last")), NODE, "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"))
