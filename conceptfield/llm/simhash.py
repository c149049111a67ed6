"""SimHash near-dedup: 64-bit fingerprints joined with themselves by walking binary tries pair by pair.

Distinct fingerprints are the leaves of a binary trie. The self-join walks pairs of its nodes together, adds up the
bits in which their paths differ, and drops a pair as soon as the error budget is exceeded. Four differing bits leave
one of the four 16-bit quarters with at most one of them, so four tries are walked, each with another quarter rotated
to the front, where the budget is one bit (and so up to seven differing bits). The upper levels are walked by the
shuffle: each trie is cut into subtrees, and a subtree gets its own fingerprints and those of the subtrees one bit
away. Each task returns a spanning forest of the links it finds, of the closest pairs, not the links, so that a large
group of near copies stays linear.

`simhash_dedup` groups by fingerprints alone. `keep_first` keeps one document of each group of near copies: several
fingerprints of a document each bring candidates, which are verified by the similarity of their shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_of, bits_for, components, keep_rows, lookup, maybe, pick, plain, stage

BITS, LEAD, LEAD_BUDGET = 64, 16, 1
#: Near copies: words of a shingle, least Jaccard similarity; fingerprints of a document and the bits by which candidates may differ.
SHINGLE, SIMILARITY, PRINTS, NEAR_BITS = 5, 0.8, 14, 7
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def near_prints(text: str | None, shingle: int, prints: int) -> list[int]:
    """Independent SimHashes of a text's distinct word shingles: their hashes, mixed anew for each."""
    h = np.unique(shingle_hashes(text, shingle))
    out = []
    for k in range(prints):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text); fp is the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    docs = pick(docs, "doc_id", "text")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def joined_pairs(own: np.ndarray, guests: np.ndarray, top: int, budget: int):
    """Yields (i, j) index arrays into own and into own or guests: pairs within the budget, found by walking the trie.

    own and guests are sorted by their lower BITS - top bits, `top` being the levels walked already; guests differ
    from own in one of these. Yields (is_guest, i, j).
    """
    mask = np.uint64((1 << (BITS - top)) - 1) if top else np.uint64(0xFFFFFFFFFFFFFFFF)
    a = own & mask
    for other, err in ((own, 0), (guests, 1)):
        if not len(own) or not len(other):
            continue
        b = a if err == 0 else other & mask
        # A frontier of node pairs: ranges [alo, ahi) of a and [blo, bhi) of b, and the bits by which they differ.
        todo = [(top, np.array([[0, len(a), 0, len(b), err]], np.int64))]
        while todo:
            level, f = todo.pop()
            same = (f[:, 0] == f[:, 2]) & (f[:, 1] == f[:, 3]) if err == 0 else np.zeros(len(f), bool)
            work = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
            leaf = (work <= 64) | (level >= BITS)
            if leaf.any():
                g, s, n = f[leaf], same[leaf], work[leaf]
                for c in range(0, len(g), 20000):
                    gg, nn = g[c : c + 20000], n[c : c + 20000]
                    k = np.repeat(np.arange(len(gg)), nn)
                    at = np.arange(nn.sum()) - np.repeat(np.cumsum(nn) - nn, nn)
                    width = (gg[:, 3] - gg[:, 2])[k]
                    i, j = gg[k, 0] + at // width, gg[k, 2] + at % width
                    x = a[i] ^ b[j]
                    good = np.bitwise_count(x) + err <= budget
                    good &= ~s[c : c + 20000][k] | (i < j)
                    if level < LEAD and top < LEAD:
                        lead = x >> np.uint64(BITS - LEAD)
                        good &= np.bitwise_count(lead) + err <= LEAD_BUDGET
                    if good.any():
                        yield err == 1, i[good], j[good]
            f, same = f[~leaf], same[~leaf]
            if not len(f):
                continue
            bit, below = np.uint64(1 << (BITS - 1 - level)), np.uint64((1 << (BITS - level)) - 1)

            def middle(values, lo, hi, bit=bit, below=below):
                return np.clip(np.searchsorted(values, (values[lo] & ~below) | bit), lo, hi)

            am, bm = middle(a, f[:, 0], f[:, 1]), middle(b, f[:, 2], f[:, 3])
            kids = [np.stack(x, 1) for x in (
                (f[:, 0], am, f[:, 2], bm, f[:, 4]), (am, f[:, 1], bm, f[:, 3], f[:, 4]),
                (f[:, 0], am, bm, f[:, 3], f[:, 4] + 1))]
            cross = np.stack((am, f[:, 1], f[:, 2], bm, f[:, 4] + 1), 1)[~same]  # of equal nodes, one cross pair is enough
            f = np.concatenate([*kids, cross])
            most = LEAD_BUDGET if level < LEAD else budget
            f = f[(f[:, 0] < f[:, 1]) & (f[:, 2] < f[:, 3]) & (f[:, 4] <= most)]
            for c in range(0, len(f), 200_000):
                todo.append((level + 1, f[c : c + 200_000]))


class Forest:
    """Union-find over 0 .. n-1 by arrays: merges many pairs at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up[x]
        while True:
            nxt = self.up[up]
            if (nxt == up).all():
                return up
            up = nxt

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.roots(i), self.roots(j)
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def spanning(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Indexes of the pairs (i, j) of a spanning forest over 0 .. n-1 with the least distances `far`: all components take
    their nearest pair at a time."""
    order = np.argsort(far, kind="stable")
    i, j, out, forest = i[order], j[order], [], Forest(n)
    while True:
        a, b = forest.roots(i), forest.roots(j)
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        i, j, a, b, order = i[open_], j[open_], a[open_], b[open_], order[open_]
        best = np.full(n, len(a))
        np.minimum.at(best, a, np.arange(len(a)))
        np.minimum.at(best, b, np.arange(len(a)))
        taken = np.unique(best[best < len(a)])
        out.append(order[taken])
        forest.merge(a[taken], b[taken])


def links(distinct: DataFrame, budget: int = 4, per_subtree: int = 8192, prints: int = 1) -> DataFrame:
    """Edges (k, a, b) that connect the same fingerprints as all links of distinct(k, fp) at `budget` (at most 7) or fewer bits;
    each edge is a link. Fingerprints of different k, below `prints`, don't link."""
    n = distinct.count()
    top = min(LEAD, max(0, math.ceil(math.log2(max(1, n / prints / per_subtree)))))

    def spread(frames):
        for pdf in frames:
            fp, which = pdf["fp"].to_numpy().view(np.uint64), pdf["k"].to_numpy().astype(np.int64)
            for turn in range(BITS // LEAD):
                r = np.uint64(turn * LEAD)
                rot = (fp << r) | (fp >> (np.uint64(BITS) - r)) if turn else fp
                tree = (rot >> np.uint64(BITS - top)).astype(np.int64) if top else np.zeros(len(fp), np.int64)
                parts = [(tree, rot, which, False)]
                for bit in range(top):
                    zero = (tree >> bit) & 1 == 0
                    parts.append((tree[zero] | (1 << bit), rot[zero], which[zero], True))
                for t, v, k, guest in parts:
                    yield pd.DataFrame({"tree": (t * 4 + turn) * prints + k, "v": v.view(np.int64), "guest": guest})

    def walk(pdf):
        turn, k = (int(pdf["tree"].iloc[0]) // prints) % 4, int(pdf["tree"].iloc[0]) % prints
        mask = np.uint64((1 << (BITS - top)) - 1) if top else np.uint64(0xFFFFFFFFFFFFFFFF)
        v, guest = pdf["v"].to_numpy().view(np.uint64), pdf["guest"].to_numpy()
        own, guests = (x[np.argsort(x & mask, kind="stable")] for x in (v[~guest], v[guest]))
        both = np.concatenate([own, guests])
        held = [np.zeros((3, 0), np.int64)]  # pairs and their distances

        def forest():
            pairs = np.concatenate(held, axis=1)
            return [pairs[:, spanning(len(both), *pairs)]]

        for is_guest, i, j in joined_pairs(own, guests, top, budget):
            j = j + len(own) * is_guest
            held.append(np.stack([i, j, np.bitwise_count(both[i] ^ both[j]).astype(np.int64)]))
            if sum(x.shape[1] for x in held) > 1_000_000:
                held = forest()
        a, b, _ = forest()[0]
        r = np.uint64(turn * LEAD)
        back = (both >> r) | (both << (np.uint64(BITS) - r)) if turn else both
        return pd.DataFrame({"k": k, "a": back[a].view(np.int64), "b": back[b].view(np.int64)})

    placed = distinct.select("k", "fp").mapInPandas(spread, "tree long, v long, guest boolean")
    return placed.groupBy("tree").applyInPandas(walk, "k int, a long, b long").distinct()


def simhash_dedup(docs: DataFrame, shingle: int = 4, budget: int = 4, per_subtree: int = 8192) -> DataFrame:
    """Groups docs(doc_id, text) whose SimHash fingerprints link at `budget` or fewer differing bits.

    Returns one row for each input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable by links, itself included). Texts without words, null ones too, have fingerprint zero and link as any
    other. Documents of the same fingerprint are one node, so copies cost nothing. A null doc_id is larger than any
    other. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    roots = components(links(nodes.withColumn("k", F.lit(0)), budget, per_subtree).select("a", "b"))
    known = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    known = stage(known, "rooted")
    least = known.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = known.join(least, F.col("root") == F.col("r")).select("fp", "n", "component_id")
    out = lookup(fps, named, ["fp"], "n", total, F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, prints: int = PRINTS, budget: int = NEAR_BITS, per_subtree: int = 8192) -> tuple[DataFrame, DataFrame]:
    """((node, root) of the near copies in docs(doc_id, text), every row's id).

    A row's id is a struct of whether doc_id is null, doc_id and a hash of the text; root is the smallest id that verified
    links reach. Each of `prints` fingerprints links its values within `budget` bits; the links of a spanning forest of
    the closest pairs, and those of rows to the first one of their value, are candidates, verified by the Jaccard
    similarity of the distinct shingles.
    """
    rows = pick(docs, "doc_id", "text").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("id"), "text")

    def prints_of(batches):
        for batch in batches:
            found = np.array([near_prints(t.as_py(), shingle, prints) for t in batch.column("text")], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(found[:, k]) for k in range(prints)]], names=["id", *[f"f{k}" for k in range(prints)]])

    id_field = rows.schema["id"]
    seen = stage(rows.mapInArrow(prints_of, T.StructType([id_field, *[T.StructField(f"f{k}", T.LongType()) for k in range(prints)]])), "prints")
    each = seen.select("id", F.posexplode(F.array(*[f"f{k}" for k in range(prints)])).alias("k", "fp"))
    values = stage(each.groupBy("k", "fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "values")
    edges = links(values, budget, per_subtree, prints)
    a, b = values.select("k", F.col("fp").alias("a"), F.col("first").alias("x")), values.select("k", F.col("fp").alias("b"), F.col("first").alias("y"))
    across = edges.join(a, ["k", "a"]).join(b, ["k", "b"]).select("x", "y")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = lookup(each, values.where("n > 1"), ["k", "fp"], "n", total, F.xxhash64("id"))
    same = same.where("first is not null and first != id").select(F.col("id").alias("x"), F.col("first").alias("y"))
    found = across.unionByName(same)
    found = stage(found.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "candidates")

    def sets_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    ends = stage(found.select(F.col("x").alias("end")).unionByName(found.select(F.col("y").alias("end"))).distinct(), "ends")
    exponent = bits_for(ends.count())
    some = maybe(rows, ["id"], bitmap_of(ends, exponent), exponent).where("_may").select("id", "text")
    sets = stage(some.mapInArrow(sets_of, T.StructType([id_field, T.StructField("set", T.ArrayType(T.LongType()))])).dropDuplicates(["id"]), "sets")
    left, right = sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), sets.select(F.col("id").alias("y"), F.col("set").alias("sy"))
    both = found.join(left.hint("merge"), "x").join(right.hint("merge"), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    alike = F.when((F.size("sx") == 0) & (F.size("sy") == 0), F.lit(True)).otherwise(shared >= similarity * (F.size("sx") + F.size("sy") - shared))
    return components(both.where(alike).select(F.col("x").alias("a"), F.col("y").alias("b"))), seen.select("id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near copies, all columns: the one of the smallest doc_id, a null one last.

    Near copies have shingles of SHINGLE words with a Jaccard similarity of SIMILARITY or more, directly or through
    others; every link is verified, and retrieval is approximate (the README gives its recall). Null text is empty; texts
    without words are near copies of one another; of different texts with equal ids the one with the least hash comes
    first; of rows equal in doc_id and text the first by its other columns stays. An empty table gives an empty one;
    columns may have any names.
    """
    roots, ids = near_copies(docs, **options)
    several = stage(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    gone = stage(roots.where("node != root").select("node"), "near-copies")
    _, at = plain(docs)
    none, text = F.col(at["doc_id"]).isNull().alias("none"), F.coalesce(F.col(at["text"]), F.lit(""))
    key = F.struct(none, F.col(at["doc_id"]).alias("doc_id"), F.xxhash64(text).alias("hash"))
    return keep_rows(docs, key, gone, several.join(gone, F.col("id") == F.col("node"), "left_anti"))
