"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors, each as far as possible from those before it and none within
twice the threshold's angle of another, so that a dense group owns one pivot and not a share of all. Each vector is
described by its nearest pivots in order, the prefix of its pivot permutation, and entered in the inverted list of each
of them. A list's members are candidates, verified by their cosine in double precision. A pair is judged in the list of
its lowest shared pivot only. Lists return link counts and a spanning forest, never their pairs; a list of any
length is split into blocks, each pair of blocks a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, pick, stage
from .simhash import Forest

#: Pivots: one for each so many vectors, within bounds. They are a sample that fits the index; every vector is indexed.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 100, 16, 4096
#: Vectors from which one pivot is chosen.
DRAWN = 2
#: Nearest pivots that describe a vector at most, and how many candidates share, the nearest of either counting twice.
PREFIX, SHARED = 12, 2
#: Members of an inverted list that one task compares with as many others.
BLOCK = 2048


def unit(column) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def far_apart(drawn: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """Up to `most` of the unit vectors drawn, each the farthest from those before it, until all lie within twice the threshold's angle of one."""
    x = drawn.astype(np.float32)
    near, closest, chosen = max(0.5, 2 * threshold * threshold - 1), x @ x[0], [0]
    while len(chosen) < min(most, len(x)) and closest[far := int(closest.argmin())] < near:
        chosen.append(far)
        np.maximum(closest, x @ x[far], out=closest)
    return drawn[chosen]


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int, threshold: float) -> list[np.ndarray]:
    """The nearest pivots of each unit vector, nearest first, ties by number.

    A pivot p is left out where no vector linked to x can have it as its nearest: with q nearest to x, such vectors lie
    beyond the plane between p and q, at (x.q - x.p) / |q - p| from x, and linked ones at sqrt(2 - 2 threshold) at most.
    """
    sims = np.round(x @ pivots.T, 12)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :prefix]
    best = np.take_along_axis(sims, order, 1)
    apart = np.linalg.norm(pivots[order] - pivots[order[:, :1]], axis=2)
    near = best[:, :1] - best <= np.sqrt(max(0.0, 2 - 2 * threshold)) * apart + 1e-9
    return [o[n] for o, n in zip(order, near, strict=True)]


def describe(vectors: DataFrame, pivots: np.ndarray, prefix: int, threshold: float) -> DataFrame:
    """(id, mult, embedding, prefix) of vectors(id, mult, embedding)."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                yield part.assign(prefix=prefixes(unit(part["embedding"]), held.value, prefix, threshold))

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInPandas(run, f"id long, mult long, embedding {kind}, prefix array<int>")


def judged(described: DataFrame, threshold: float, block: int, shared: int = SHARED) -> DataFrame:
    """(id, links, root) of what each pair of blocks of each inverted list finds."""
    entries = described.select(F.explode("prefix").alias("pivot"), "id", "mult", "embedding", "prefix")
    sizes = described.select(F.explode("prefix").alias("pivot")).groupBy("pivot").count()  # a row for each pivot: bounded
    sizes = sizes.select(F.col("pivot").alias("p"), F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    placed = entries.join(F.broadcast(sizes), F.col("pivot") == F.col("p")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "mult", "embedding", "prefix")

    def run(pdf):
        pdf = pdf.sort_values(["mine", "id"], ignore_index=True)
        pivot, x, ids, mult = int(pdf["pivot"].iloc[0]), unit(pdf["embedding"]), pdf["id"].to_numpy(), pdf["mult"].to_numpy()
        names, places = np.unique(np.concatenate(pdf["prefix"].to_list()), return_inverse=True)
        many = pdf["prefix"].map(len).to_numpy()
        member = np.zeros((len(x), len(names)), np.float32)
        member[np.repeat(np.arange(len(x)), many), places] = 1
        nearest = np.zeros_like(member)
        nearest[np.arange(len(x)), places[np.cumsum(many) - many]] = 1
        low = member[:, names < pivot]
        forest, links = Forest(len(x)), np.zeros(len(x), np.int64)
        cut = int((pdf["mine"] == pdf["i"].iloc[0]).sum())
        one = slice(0, cut)
        two = one if pdf["i"].iloc[0] == pdf["j"].iloc[0] else slice(cut, len(x))
        counts = (member[one] + nearest[one]) @ member[two].T + member[one] @ nearest[two].T
        candidate = (counts >= shared) & (low[one] @ low[two].T == 0)
        if two is one:
            candidate = np.triu(candidate, 1)
        left, right = x[one], x[two]
        ends = []
        for i in np.flatnonzero(candidate.any(axis=1)):
            j = np.flatnonzero(candidate[i])
            ends.append((i, j[right[j] @ left[i] >= threshold] + two.start))
        if ends:
            a = np.repeat([i for i, _ in ends], [len(j) for _, j in ends]).astype(np.int64)
            b = np.concatenate([j for _, j in ends])
            links += np.bincount(a, mult[b], len(x)).astype(np.int64) + np.bincount(b, mult[a], len(x)).astype(np.int64)
            forest.merge(a, b)
        found = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[found], "links": links[found], "root": ids[forest.roots(found)]})

    return placed.groupBy("pivot", "i", "j").applyInPandas(run, "id long, links long, root long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, prefix: int = PREFIX, block: int = BLOCK, per_pivot: int = PER_PIVOT) -> DataFrame:
    """Links vectors(vec_id, embedding) found with cosine >= threshold.

    Returns one row for each input row: vec_id, n_links (other vectors linked directly), component_id (the smallest
    vec_id reachable), kept (vec_id = component_id). Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing; vectors of different length don't link. Equal vectors are one entry of the index and
    link with one another. A null vec_id is larger than any other and its row is a vector like any; an empty table
    gives an empty result; other columns are ignored. Retrieval is approximate: pairs that share fewer than SHARED of
    their `prefix` nearest pivots (the nearest of either counts twice) are missed (tests measure recall against brute force).
    """
    rows = pick(vectors, "vec_id", "embedding")
    if rows.schema["embedding"].dataType.simpleString() != "array<float>":  # floats are exact as doubles and half as large
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("vid", F.coalesce(F.col("vec_id").cast("long"), F.lit((1 << 63) - 1)))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    reps = rows.where(good).groupBy("embedding").agg(F.min("vid").alias("first"), F.count("*").alias("mult"))
    reps = stage(reps.withColumn("id", F.monotonically_increasing_id()), "vectors")  # vec_ids may be null or repeated
    sizes = {r["n"]: r["count"] for r in reps.groupBy(F.size("embedding").alias("n")).count().collect()}
    found = None
    for length, n in sorted(sizes.items()):
        mine = reps.where(F.size("embedding") == length)
        k = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // per_pivot), max(LEAST_PIVOTS, (1 << 22) // length))
        drawn = unit(mine.orderBy(F.xxhash64("embedding"), "first").limit(DRAWN * k).select("embedding").toPandas()["embedding"])
        pivots = far_apart(drawn, k, threshold)
        part = judged(describe(mine.select("id", "mult", "embedding"), pivots, prefix, threshold), threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "i")
    known = reps.join(links, F.col("id") == F.col("i"), "left").join(roots, F.col("id") == F.col("node"), "left")
    known = known.select("embedding", "mult", "first", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    known = stage(known.where("n_links > 0"), "rooted")
    least = known.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    known = stage(known.join(least, F.col("root") == F.col("r")).select("embedding", "mult", "n_links", "component_id"), "linked")
    out = lookup(rows, known, ["embedding"], "mult", rows.count(), F.xxhash64("vid"))
    component = F.coalesce("component_id", "vid")
    last = F.lit((1 << 63) - 1)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(component < last, component).alias("component_id"), (component == F.col("vid")).alias("kept"))
