"""Senses of a concept: components that hardly overlap with one another, as groups found by the gap in a spectrum.

Eigenvectors of a concept's matrix are orthogonal whatever it means, so they can't tell homonyms apart. Here components
are nodes of a graph, linked by their squared cosine; a concept with k senses that don't touch has the eigenvalue 1 of
the graph's normalised links k times, while one sense, spread evenly over d dimensions, has no second one above
2 / (d + 2). The squared cosine is a product of the vectors' own products, so the graph is never formed: with vectors
seen on the concept's facets (eigenvectors with at least `facet` of its mass, at most 1 / facet of them), a component's
degree and the normalised matrix are sums over components, made where they are.

Components: concept, vector, w (not negative). Rows with a null concept, vector or weight are left out; equal rows count
as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import lookup, stage
from ..functions.vectors import dot, let
from . import density

#: A facet's least share of the mass; least eigenvalue of a sense of its own; a sense's least share of the mass and of rows.
FACET, APART, SHARE, LEAST = 0.05, 0.75, 0.1, 2


def spectrum(rhos: DataFrame, least: float) -> DataFrame:
    """(concept, n, size, axes): facets, the largest first, and their eigenvalues as shares of the mass."""
    kind = dict(rhos.dtypes)["concept"]

    def run(frames):
        for pdf in frames:
            out = []
            for c, n, flat in pdf[["concept", "n", "rho"]].itertuples(index=False):
                side = int(round(len(flat) ** 0.5))
                lam, vec = np.linalg.eigh(np.reshape(flat, (side, side)))
                mass = lam.sum()
                if mass > 1e-12:
                    some = [i for i in range(side - 1, -1, -1) if lam[i] >= least * mass]
                    out.append((c, n, [float(lam[i] / mass) for i in some], [vec[:, i].tolist() for i in some]))
            yield pd.DataFrame(out, columns=["concept", "n", "size", "axes"], dtype=object)

    return rhos.mapInPandas(run, f"concept {kind}, n long, size array<double>, axes array<array<double>>")


def half(z: Column) -> Column:
    """Upper half of z's product with itself, so that the product of two halves is the squared product of the vectors."""
    row = F.transform(z, lambda x, i: F.transform(F.slice(z, i + 1, F.size(z) - i), lambda y, j: x * y * F.when(j == 0, 1.0).otherwise(2.0**0.5)))
    return F.flatten(row)


def on_facets(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """rows with degree and y, the half product of the vector on its concept's facets over the root of the degree; both null
    for vectors that miss all facets."""
    met = lookup(rows, found, ["concept"], "n", total, F.xxhash64("vector"))
    met = met.withColumn("_z", F.transform("axes", lambda u: dot(u, F.col("vector"))))
    met = met.withColumn("degree", F.aggregate(F.zip_with("_z", "size", lambda x, s: x * x * s), F.lit(0.0), lambda a, x: a + x))
    y = let(F.col("_z"), half)
    y = let(y, lambda h: F.transform(h, lambda x: x / F.sqrt(F.col("degree"))))
    return met.withColumn("y", F.when(F.col("degree") > 1e-9, y)).select(*rows.columns, F.when(F.col("degree") > 1e-9, F.col("degree")).alias("degree"), "y")


def groups_in(lam: np.ndarray, apart: float) -> int:
    """Number of senses by falling eigenvalues: where the largest gap follows those of at least `apart`."""
    most = max(1, int((lam >= apart).sum()))
    gaps = lam[:most] - np.append(lam[1 : most + 1], 0.0)[:most]
    return int(np.argmax(gaps)) + 1


def counted(sums: DataFrame, apart: float) -> DataFrame:
    """(concept, n, k, gap, basis) of the sums of y: number of senses, the gap below them, the k leading eigenvectors."""
    kind = dict(sums.dtypes)["concept"]

    def run(frames):
        for pdf in frames:
            out = []
            for c, n, flat in pdf[["concept", "n", "rho"]].itertuples(index=False):
                side = int(round(len(flat) ** 0.5))
                lam, vec = np.linalg.eigh(np.reshape(flat, (side, side)))
                lam, vec = lam[::-1] / max(lam[-1], 1e-12), vec.T[::-1]
                k = groups_in(lam, apart)
                out.append((c, n, k, float(lam[k - 1] - (lam[k] if k < side else 0.0)), vec[:k].tolist()))
            yield pd.DataFrame(out, columns=["concept", "n", "k", "gap", "basis"], dtype=object)

    return sums.mapInPandas(run, f"concept {kind}, n long, k int, gap double, basis array<array<double>>")


def pivots(rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows that a factorisation with pivots takes first: each the longest across those before."""
    left, taken = rows.copy(), []
    for _ in range(min(k, len(rows))):
        size = (left * left).sum(axis=1)
        size[taken] = -1.0
        i = int(np.argmax(np.round(size, 9)))
        taken.append(i)
        q = left[i] / max(np.sqrt(max(size[i], 0.0)), 1e-12)
        left = left - np.outer(left @ q, q)
    return rows[taken]


def corners(placed: DataFrame) -> DataFrame:
    """(concept, turn) of rows (concept, place): the rotation that takes a place to its sense's coordinate. Tasks name their
    own k pivots, among which the final ones are chosen: k rows a task and concept are shuffled, whatever its size."""
    kind = dict(placed.dtypes)["concept"]

    def partial(frames):
        held: dict = {}

        def flush():
            return pd.DataFrame([(c, v) for c, x in held.items() for v in x], columns=["concept", "place"])

        for pdf in frames:
            for c, part in pdf.groupby("concept", sort=False):
                x = np.array(part["place"].tolist(), float)
                held[c] = pivots(np.concatenate([held[c], x]) if c in held else x, x.shape[1])
            if len(held) > 10_000:
                yield flush()
                held.clear()
        yield flush()

    def final(pdf):
        x = np.array(pdf["place"].tolist(), float)
        x = pivots(x[np.lexsort(x.T)], x.shape[1])
        u, _, vt = np.linalg.svd(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), full_matrices=False)
        return pd.DataFrame({"concept": pdf["concept"].iloc[:1], "turn": [(u @ vt).tolist()]})

    return placed.mapInPandas(partial, f"concept {kind}, place array<double>").groupBy("concept").applyInPandas(final, f"concept {kind}, turn array<array<double>>")


def members(parts: DataFrame, facet: float = FACET, apart: float = APART) -> tuple[DataFrame, DataFrame]:
    """(components with sense, spectra(concept, n, k, gap)). Senses are numbered from 1 by falling mass; a vector that misses all
    facets has none (null). Other columns of parts pass through, whatever their names but sense."""
    rows = parts.dropna(subset=["concept", "vector", "w"]).select("concept", "vector", F.col("w").cast("double").alias("w"), F.struct(*[F.col(c) for c in parts.columns]).alias("_row"))
    rows = stage(rows, "senses")
    total, spread = rows.count(), F.xxhash64("vector")
    found = stage(spectrum(density.matrices(rows), facet), "facets")
    seen = stage(on_facets(rows, found, total), "on-facets")
    attached = F.col("y").isNotNull()
    spectra = stage(counted(density.matrices(seen.where(attached), vector="y"), apart), "spectra")
    many = spectra.where("k > 1").select("concept", "n", "basis")
    place = F.when(attached, F.transform("basis", lambda b: dot(b, F.col("y"))))
    placed = lookup(seen, many, ["concept"], "n", total, spread).select(*rows.columns, attached.alias("attached"), place.alias("place"))
    placed = stage(placed, "placed")
    turns = corners(placed.where("place IS NOT NULL").select("concept", "place")).join(many.select("concept", "n"), "concept")
    size = F.transform("turn", lambda t: F.round(F.abs(dot(t, F.col("place"))), 9))
    group = F.when(F.col("attached"), F.when(F.col("turn").isNull(), 1).otherwise(let(size, lambda s: F.array_position(s, F.array_max(s)).cast("int"))))
    drafted = stage(lookup(placed, turns, ["concept"], "n", total, spread).select(*rows.columns, group.alias("group")), "drafted")
    masses = drafted.where("group IS NOT NULL").groupBy("concept", "group").agg(F.sum(F.col("w") * dot(F.col("vector"), F.col("vector"))).alias("m"))
    order = masses.groupBy("concept").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.round("m", 9)).alias("m"), "group"))), lambda x: x["group"]).alias("order"))  # no longer than basis
    ranked = lookup(drafted, order.join(found.select("concept", "n"), "concept"), ["concept"], "n", total, spread)
    return ranked.select("_row.*", F.array_position("order", F.col("group")).cast("int").alias("sense")), spectra.select("concept", "n", "k", "gap")


def sense_masses(grouped: DataFrame) -> DataFrame:
    """(concept, sense, n, mass, share): mass and its share in what all senses of the concept hold."""
    rows = grouped.where("sense IS NOT NULL").groupBy("concept", "sense").agg(F.count("*").alias("n"), F.sum(F.col("w") * dot(F.col("vector"), F.col("vector"))).alias("mass"))
    total = rows.groupBy("concept").agg(F.sum("mass").alias("_total"))
    return rows.join(total, "concept").withColumn("share", F.when(F.col("_total") > 0, F.col("mass") / F.col("_total")).otherwise(0.0)).drop("_total")


def potential_homonyms(parts: DataFrame, facet: float = FACET, apart: float = APART, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(concept, n, senses, gap, potential_homonym): senses with enough of the mass and enough components; two or more make a
    potential homonym."""
    grouped, spectra = members(parts, facet, apart)
    some = sense_masses(grouped).groupBy("concept").agg(F.count(F.when((F.col("share") >= share) & (F.col("n") >= least), 1)).alias("senses"))
    return spectra.join(some, "concept").select("concept", "n", F.greatest("senses", F.lit(1)).cast("int").alias("senses"), "gap", (F.col("senses") > 1).alias("potential_homonym"))
