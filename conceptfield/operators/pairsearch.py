"""Pairs of concepts above a threshold, found by bounds before any matrix moves.

Each concept is summed up by its mass, its K leading eigenvalues and eigenvectors and the next eigenvalue. Concepts with
leading directions alike form blocks of bounded size, and blocks are summed up by their extremes. Three levels, each an upper bound
of the one below: pairs of blocks by their extremes, pairs of concepts by their summaries, pairs by their matrices.
Only pairs that pass the first two meet their matrices, so nothing is shuffled for the others; what is lost is nothing,
as the bounds are never too low.

With P the leading eigenvectors of A and Q those of B, c the squared cosines between them and r the next eigenvalues:
tr(AB) is at most the sum of a b c, plus r_B times what of A's part lies outside Q, the same the other way, and the
least of r_A and r_B times the other's remaining trace. How far A sticks out of B is at least the sum over P's first j of
a - (b c + r_B (1 - c)), for any j, and at least the difference of the masses.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stage
from . import density as D

#: Eigenvectors of a summary; concepts of a block; blocks, whose summaries are broadcast (a direction and eight numbers each).
K, SIZE, MOST_BLOCKS = 4, 256, 8192
SLACK = 1e-9
EXTREMES = "block long, direction array<double>, cosine double, n long, mass_low double, mass_high double, lead_low double, lead_high double, next_high double, share_low double, share_high double, rest_high double"


def summaries(rhos: DataFrame, k: int = K) -> DataFrame:
    """(concept, mass, lam, vec): the k + 1 largest eigenvalues, zeros if there are fewer, and k eigenvectors one after another."""
    kind = dict(rhos.dtypes)["concept"]

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                x = np.array(part["rho"].tolist(), float)
                d = int(round(x.shape[1] ** 0.5))
                lam, vec = np.linalg.eigh(x.reshape(-1, d, d))
                m = min(k, d)
                values, vectors = np.zeros((len(x), k + 1)), np.zeros((len(x), k, d))
                values[:, : min(k + 1, d)] = np.maximum(lam[:, ::-1][:, : k + 1], 0)
                vectors[:, :m] = vec.transpose(0, 2, 1)[:, ::-1][:, :m]
                yield pd.DataFrame({"concept": part["concept"], "mass": x[:, :: d + 1].sum(axis=1), "lam": list(values), "vec": list(vectors.reshape(len(x), -1))})

    return rhos.select("concept", "rho").mapInPandas(run, f"concept {kind}, mass double, lam array<double>, vec array<double>")


def blocked(found: DataFrame, size: int) -> DataFrame:
    """found with block: its nearest of some leading directions, drawn by a hash, and a part of `size` of those that share it."""
    n = found.count()
    size = max(size, math.ceil(n / MOST_BLOCKS))
    drawn = found.orderBy(F.xxhash64("concept"), "concept").limit(max(1, n // size)).select("vec", F.size("lam").alias("k")).collect()  # at most MOST_BLOCKS
    held = found.sparkSession.sparkContext.broadcast(np.array([r.vec[: len(r.vec) // (r.k - 1)] for r in drawn], float))
    kinds = dict(found.dtypes)

    def run(frames):
        for pdf in frames:
            if len(pdf):
                lead = np.array(pdf["vec"].tolist(), float)[:, : held.value.shape[1]]
                yield pdf.assign(center=np.abs(lead @ held.value.T).argmax(axis=1))

    near = stage(found.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in found.columns) + ", center long"), "near")
    sizes = near.groupBy("center").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))  # one row a center
    split = near.join(F.broadcast(sizes), "center").withColumn("block", F.col("center") * (1 << 32) + F.pmod(F.xxhash64("concept"), F.col("parts")))
    return stage(split.drop("center", "parts"), "blocked")


def extremes(blocks: DataFrame) -> DataFrame:
    def run(pdf):
        d = len(pdf["vec"].iloc[0]) // (len(pdf["lam"].iloc[0]) - 1)
        lam, mass = np.array(pdf["lam"].tolist(), float), pdf["mass"].to_numpy(float)
        lead = np.array(pdf["vec"].tolist(), float)[:, :d]
        lead = lead * np.where(lead @ lead[0] < 0, -1, 1)[:, None]
        middle = lead.sum(axis=0)
        middle = middle / max(np.linalg.norm(middle), 1e-300)
        share, rest = lam[:, 0] / np.maximum(mass, 1e-300), lam[:, 1] / np.maximum(mass, 1e-300)
        row = (pdf["block"].iloc[0], middle, min(1.0, np.abs(lead @ middle).min()), len(pdf), mass.min(), mass.max(), lam[:, 0].min(), lam[:, 0].max(), lam[:, 1].max(), share.min(), share.max(), rest.max())
        return pd.DataFrame([row], columns=[f.split()[0] for f in EXTREMES.split(", ")])

    return blocks.groupBy("block").applyInPandas(run, EXTREMES)


def block_bounds(x: pd.DataFrame, y: pd.DataFrame, measure: str) -> np.ndarray:
    """What no pair of a concept of block x and one of block y exceeds."""
    def column(f, name, up):
        v = f[name].to_numpy(float)
        return v[:, None] if up else v[None, :]

    cosine = np.clip(np.abs(np.array(x["direction"].tolist()) @ np.array(y["direction"].tolist()).T), 0, 1)
    reach = np.arccos(column(x, "cosine", True)) + np.arccos(column(y, "cosine", False))
    angle = np.arccos(cosine)
    most, least = np.cos(np.maximum(angle - reach, 0)) ** 2, np.cos(np.minimum(angle + reach, np.pi / 2)) ** 2
    if measure == "similarity":
        a, b, ra, rb = column(x, "share_high", True), column(y, "share_high", False), column(x, "rest_high", True), column(y, "rest_high", False)
        rest = np.minimum(ra * (1 - column(y, "share_low", False)), rb * (1 - column(x, "share_low", True)))
        return a * b * most + (a * rb + b * ra) * (1 - least) + rest

    def one_way(p, q, up):
        heavier = column(q, "mass_high", not up) / np.maximum(column(p, "mass_low", up), 1e-300)
        out = column(p, "lead_low", up) - column(q, "lead_high", not up) * most - column(q, "next_high", not up) * (1 - least)
        return np.minimum(np.minimum(heavier, 1), 1 - np.maximum(out, 0) / column(p, "mass_high", up))

    return np.maximum(one_way(x, y, True), one_way(y, x, False))


def pair_bounds(a: pd.DataFrame, b: pd.DataFrame, measure: str) -> np.ndarray:
    """Upper bounds of each pair [i, j]: of their similarity, or of how far a lies in b."""
    la, lb = np.array(a["lam"].tolist(), float), np.array(b["lam"].tolist(), float)
    ma, mb = a["mass"].to_numpy(float), b["mass"].to_numpy(float)
    k = la.shape[1] - 1
    va, vb = (np.array(f["vec"].tolist(), float).reshape(len(f), k, -1) for f in (a, b))
    c = np.einsum("iax,jbx->iajb", va, vb, optimize=True) ** 2
    if measure == "similarity":
        la, lb = la / np.maximum(ma, 1e-300)[:, None], lb / np.maximum(mb, 1e-300)[:, None]
        ra, rb = la[:, k][:, None], lb[:, k][None, :]
        both = np.einsum("ia,iajb,jb->ij", la[:, :k], c, lb[:, :k], optimize=True)
        outside_b = la[:, :k].sum(axis=1)[:, None] - np.einsum("ia,iajb->ij", la[:, :k], c, optimize=True)
        outside_a = lb[:, :k].sum(axis=1)[None, :] - np.einsum("iajb,jb->ij", c, lb[:, :k], optimize=True)
        rest = np.minimum(ra * (1 - lb[:, :k].sum(axis=1))[None, :], rb * (1 - la[:, :k].sum(axis=1))[:, None])
        return both + rb * np.maximum(outside_b, 0) + ra * np.maximum(outside_a, 0) + np.maximum(rest, 0)
    inside = np.einsum("iajb,jb->iaj", c, lb[:, :k], optimize=True) + lb[:, k][None, None, :] * np.maximum(1 - c.sum(axis=3), 0)
    out = np.cumsum(la[:, :k, None] - inside, axis=1).max(axis=1)
    out = np.maximum(out, ma[:, None] - mb[None, :])
    return np.where(ma[:, None] < 1e-12, 0.0, 1 - np.maximum(out, 0) / np.maximum(ma, 1e-12)[:, None])


def candidates(rhos: DataFrame, measure: str, threshold: float, k: int = K, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """((a, b), counts): pairs whose bound exceeds the threshold, a < b for similarity, ordered ones else; and one row with
    concepts, blocks, block_pairs (those whose members met) and candidates."""
    kind = dict(rhos.dtypes)["concept"]
    members = blocked(summaries(rhos, k), size)
    tops = stage(extremes(members), "extremes")
    known = tops.toPandas().sort_values("block", ignore_index=True)  # at most about 2 x MOST_BLOCKS rows
    held = rhos.sparkSession.sparkContext.broadcast(known)

    def meet(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                good = block_bounds(part, held.value, measure) + SLACK > threshold
                i, j = np.nonzero(good)
                x, y = part["block"].to_numpy()[i], held.value["block"].to_numpy()[j]
                yield pd.DataFrame({"x": x, "y": y})[x <= y]

    kept = stage(tops.mapInPandas(meet, "x long, y long"), "block-pairs")
    left = members.join(kept, members["block"] == kept["x"])
    right = members.join(kept.where("x <> y"), members["block"] == F.col("y"))
    both = left.unionByName(right).select("x", "y", "block", "concept", "mass", "lam", "vec")

    def compare(pdf):
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        one, other = pdf[pdf["block"] == x], pdf[pdf["block"] == y]
        out = []
        for p, q in [(one, other)] if x == y or measure == "similarity" else [(one, other), (other, one)]:
            step = int(min(64, max(1, 4_000_000 // (len(q) * k * k))))  # a bound takes k x k numbers
            for at in range(0, len(p), step):
                part = p.iloc[at : at + step]
                i, j = np.nonzero(pair_bounds(part, q, measure) + SLACK > threshold)
                a, b = part["concept"].to_numpy()[i], q["concept"].to_numpy()[j]
                if measure == "similarity":
                    swap = a > b
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    keep = (a < b) & ((x != y) | ~swap)
                else:
                    keep = a != b
                out.append(pd.DataFrame({"a": a[keep], "b": b[keep]}))
        return pd.concat(out)

    found = stage(both.groupBy("x", "y").applyInPandas(compare, f"a {kind}, b {kind}"), "candidates")
    counts = known.agg({"n": ["sum", "count"]})["n"] if len(known) else {"sum": 0, "count": 0}
    row = (int(counts["sum"]), int(counts["count"]), kept.count(), found.count())
    return found, rhos.sparkSession.createDataFrame([row], "concepts long, blocks long, block_pairs long, candidates long")


def similar_pairs(rhos: DataFrame, low: float, high: float = math.inf, **options) -> DataFrame:
    """(a, b, similarity) of pairs a < b with a similarity above low and below high: those of all pairs."""
    rhos = stage(rhos.select("concept", "rho"), "rhos")
    found, _ = candidates(rhos, "similarity", low, **options)
    rows = D.pairs(rhos, candidates=found).select("a", "b", D.similarity().alias("similarity"))
    return rows.where((F.col("similarity") > low) & (F.col("similarity") < high))


def edges(rhos: DataFrame, threshold: float, **options) -> DataFrame:
    """(a, b, weight): ordered pairs with b in a above the threshold by hyponymy, of all concepts, not of a view's alone."""
    rhos = stage(rhos.select("concept", "rho"), "rhos")
    found, _ = candidates(rhos, "hyponymy", threshold - 0.0005, **options)
    rows = D.hyponymy(D.pairs(rhos, candidates=found).select("a", "b", "rho_a", "rho_b"), "weight")
    return rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.round("weight", 3).alias("weight")).where(F.col("weight") > threshold)


def furthest_in(rhos: DataFrame, term, k: int = 10, contains: bool = True, tries: int = 4) -> DataFrame:
    """The k concepts that lie furthest in term, or in which it lies furthest: (concept, score), as all scores would give.

    The tries x k of the largest bounds are scored; what is left is scored only where its bound reaches the kth score.
    """
    rhos = stage(rhos.select("concept", "rho"), "rhos")
    own = summaries(rhos)
    one = own.where(F.col("concept") == F.lit(term)).toPandas()  # one row
    kind = dict(rhos.dtypes)["concept"]
    if one.empty:
        return rhos.limit(0).select("concept", F.lit(0.0).alias("score"))

    def run(frames):
        for pdf in frames:
            pdf = pdf[pdf["concept"] != term]
            if len(pdf):
                bound = pair_bounds(pdf, one, "hyponymy")[:, 0] if contains else pair_bounds(one, pdf, "hyponymy")[0]
                yield pd.DataFrame({"concept": pdf["concept"], "bound": bound})

    bounds = stage(own.mapInPandas(run, f"concept {kind}, bound double"), "bounds")

    def scored(some: DataFrame) -> DataFrame:
        ends = some.select(F.col("concept").alias("a"), F.lit(term).cast(kind).alias("b")) if contains else some.select(F.lit(term).cast(kind).alias("a"), F.col("concept").alias("b"))
        rows = D.hyponymy(D.pairs(rhos, candidates=ends).select("a", "b", "rho_a", "rho_b"), "score")
        return rows.select(F.col("a" if contains else "b").alias("concept"), "score")

    first = stage(scored(bounds.orderBy(F.desc("bound"), "concept").limit(tries * k)), "scores")
    best = [r.score for r in first.orderBy(F.desc("score")).limit(k).collect()]
    rest = bounds.join(F.broadcast(first.select("concept")), "concept", "left_anti")
    if len(best) == k:
        rest = rest.where(F.col("bound") + SLACK >= best[-1])
    return first.unionByName(scored(rest)).orderBy(F.desc("score"), "concept").limit(k)
