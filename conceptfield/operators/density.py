"""Density matrices of concepts and what is computed from them.

Components: concept (and space_id where maps are compared), vector array<double>, weight, and for decay ts and
activation. A concept's matrix is the sum of weight times vector times vector transposed. Partial sums are made where
the components are, one matrix or fewer vectors for each task and concept, so that what is shuffled doesn't depend on
their number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import Config


def decayed_weight(cfg: Config) -> Column:
    """weight x activation x (1 + age / tau) ** -exponent; what comes after as_of has age 0."""
    age = F.greatest(F.lit(0.0), F.lit(float(cfg.as_of)) - F.col("ts"))
    return F.col("weight") * F.col("activation") * F.pow(1 + age / F.lit(cfg.decay_tau), F.lit(-cfg.decay_exponent))


def with_archive(parts: DataFrame, cfg: Config, key: Sequence[str] = ("concept",)) -> DataFrame:
    """Adds w (decayed weight) and archived: below a hundredth of the concept's largest."""
    rows = parts.withColumn("w", decayed_weight(cfg))
    largest = rows.groupBy(*key).agg(F.max("w").alias("_max"))
    return rows.join(largest, list(key)).withColumn("archived", F.col("w") < cfg.archive_epsilon * F.col("_max")).drop("_max")


#: Numbers that a task makes at a time, and holds at most; what a key takes beside its rows, counted in numbers.
CELLS, MOST, KEY = 1_000_000, 8_000_000, 200


def cut(column: pa.ListArray) -> list[np.ndarray]:
    """The vectors of a column; a null one is empty."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def in_batches(rows, types: dict):
    """rows as Arrow batches of about CELLS numbers; types by name, which may be known with the first row only."""
    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))

    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, np.ndarray))
        if size > CELLS or len(out) >= 10_000:
            yield batch(out)
            out, size = [], 0
    if out:
        yield batch(out)


def matrices(parts: DataFrame, key: Sequence[str] = ("concept",), weight: str = "w", vector: str = "vector") -> DataFrame:
    """(key..., n, rho): the dense d x d matrix of each key, row by row, and its number of components.

    Tasks hold a bounded amount of numbers, keys included, however many keys there are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    fields = [f"{k} {kinds[k]}" for k in key]
    names, numbers = list(key), pa.list_(pa.float64())

    def gram(x, w):
        return (x * w[:, None]).T @ x

    def types_of(batch, *lists):
        return {k: batch.schema.field(k).type for k in names} | {"n": pa.int64()} | dict.fromkeys(lists, numbers)

    def partial(batches):
        """Sums where the components are. A key's vectors stay as they are until a task holds as many as they have
        coordinates, as fewer are smaller than their matrix."""
        held: dict = {}
        size, types = 0, None

        def rows():
            for k, (n, m, xs, ws) in held.items():
                x, w = (np.concatenate(xs), np.concatenate(ws)) if xs else (np.empty(0), np.empty(0))
                yield (*k, n, None if m is None else m.ravel(), x.ravel(), w)

        for batch in batches:
            types = types_of(batch, "rho", "x", "w")
            groups: dict = {}
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                groups.setdefault(k, []).append(i)
            vectors_, weights = cut(batch.column("_x")), batch.column("_w").to_numpy(zero_copy_only=False)
            for k, at in groups.items():
                x, w = np.array([vectors_[i] for i in at]), weights[at]
                found = held.get(k)
                size += x.size + (0 if found else KEY)
                n, m, xs, ws = found or (0, None, [], [])
                xs, ws = [*xs, x], [*ws, w]
                if sum(map(len, ws)) >= x.shape[1]:
                    size += 0 if m is not None else x.shape[1] ** 2
                    size -= sum(y.size for y in xs)
                    m, xs, ws = gram(np.concatenate(xs), np.concatenate(ws)) + (0 if m is None else m), [], []
                held[k] = (n + len(x), m, xs, ws)
            if size > MOST:
                yield from in_batches(rows(), types)
                held, size = {}, 0
        if held:
            yield from in_batches(rows(), types)

    def total(batches):
        def rows():
            now, n, m = None, 0, 0.0
            for batch in batches:
                types.update(types_of(batch, "rho"))
                columns = [batch.column("n").to_pylist(), *map(cut, (batch.column("rho"), batch.column("x"), batch.column("w")))]
                for k, more, rho, x, w in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), *columns, strict=True):
                    if k != now:
                        if now is not None:
                            yield (*now, n, m)
                        now, n, m = k, 0, 0.0
                    n += more
                    if len(rho):
                        m = m + rho
                    if len(w):
                        m = m + gram(x.reshape(len(w), -1), w).ravel()
            if now is not None:
                yield (*now, n, m)

        types: dict = {}
        yield from in_batches(rows(), types)

    cells = parts.select(*names, F.col(vector).cast("array<double>").alias("_x"), F.col(weight).cast("double").alias("_w"))
    sums = cells.mapInArrow(partial, ", ".join([*fields, "n long", "rho array<double>", "x array<double>", "w array<double>"]))
    return sums.repartition(*names).sortWithinPartitions(*names).mapInArrow(total, ", ".join([*fields, "n long", "rho array<double>"]))


def layer(parts: DataFrame, most: int) -> DataFrame:
    """Components of judgments up to an interpretation layer."""
    return parts.where(F.col("interpretation_layer") <= most)


def semantic(parts: DataFrame) -> DataFrame:
    """Components of judgments that don't tell of single events."""
    return parts.where(F.col("clause_type").isin("GENERIC", "HABITUAL", "UNKNOWN"))


def trace(rho: Column, dim: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), dim - 1), F.lit(0.0), lambda s, i: s + F.element_at(rho, (i * dim + i + 1).cast("int")))


def inner(a: Column, b: Column) -> Column:
    """Trace of the product of two symmetric matrices."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def side(rho: Column) -> Column:
    return F.sqrt(F.size(rho).cast("double")).cast("int")


def with_mass(rhos: DataFrame) -> DataFrame:
    return rhos.withColumn("mass", trace(F.col("rho"), side(F.col("rho"))))


def entries(rhos: DataFrame, key: Sequence[str] = ("concept",)) -> DataFrame:
    """(key..., i, j, val), zeros too."""
    d = side(F.col("rho"))
    cells = rhos.select(*key, d.alias("_d"), F.posexplode("rho").alias("_p", "val"))
    return cells.select(*key, F.floor(F.col("_p") / F.col("_d")).cast("int").alias("i"), F.pmod(F.col("_p"), F.col("_d")).cast("int").alias("j"), "val")


def pairs(rhos: DataFrame, same: Sequence[str] = (), candidates: DataFrame | None = None, blocks: int = 8) -> DataFrame:
    """Ordered pairs of different concepts with both matrices and masses: (a, b, rho_a, rho_b, mass_a, mass_b).

    candidates(a, b) restricts them, and should, where there are many concepts: all pairs are for the few nodes of a view.
    These meet in blocks x blocks tasks, each matrix in 2 x blocks of them.
    """
    m = with_mass(rhos)
    left = m.select(*same, F.col("concept").alias("a"), F.col("rho").alias("rho_a"), F.col("mass").alias("mass_a"))
    right = m.select(*same, F.col("concept").alias("b"), F.col("rho").alias("rho_b"), F.col("mass").alias("mass_b"))
    if candidates is not None:
        return candidates.select(*same, "a", "b").join(left, [*same, "a"]).join(right, [*same, "b"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = left.withColumn("_x", F.pmod(F.xxhash64("a"), F.lit(blocks))).withColumn("_y", every)
    others = right.withColumn("_y", F.pmod(F.xxhash64("b"), F.lit(blocks))).withColumn("_x", every)
    return rows.join(others, [*same, "_x", "_y"]).where("a <> b").drop("_x", "_y")


def containment() -> Column:
    """How much of a lies in b: trace(AB) / trace(A), 0 for an empty a."""
    return F.when(F.col("mass_a") < 1e-12, 0.0).otherwise(inner(F.col("rho_a"), F.col("rho_b")) / F.col("mass_a"))


def similarity() -> Column:
    """Trace of the product of both matrices at trace 1."""
    return inner(F.col("rho_a"), F.col("rho_b")) / (F.col("mass_a") * F.col("mass_b"))


def purity() -> Column:
    return inner(F.col("rho"), F.col("rho")) / (F.col("mass") * F.col("mass"))


def per_matrix(rhos: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str, columns: Sequence[str] = ("rho",)) -> DataFrame:
    """Adds kernel(stack of matrices, one argument for each column) to every row, batch by batch."""
    keep = [c for c in rhos.columns if c not in columns]
    kinds = {f.name: f.dataType.simpleString() for f in rhos.schema}

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                stacks = []
                for c in columns:
                    x = np.array(part[c].tolist(), float)
                    d = int(round(x.shape[1] ** 0.5))
                    stacks.append(x.reshape(-1, d, d))
                yield part[keep].assign(**{name: kernel(*stacks)})

    return rhos.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"{name} double"]))


def hyponymy_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - (sum of |negative eigenvalues of B - A|) / trace(A)."""
    mass = np.trace(a, axis1=1, axis2=2)
    low = np.minimum(np.linalg.eigvalsh(b - a), 0).sum(axis=1)
    return np.where(mass < 1e-12, 0.0, 1 + low / np.maximum(mass, 1e-12))


def entropy_kernel(rho: np.ndarray) -> np.ndarray:
    """Von Neumann entropy at trace 1."""
    mass = np.trace(rho, axis1=1, axis2=2)
    lam = np.linalg.eigvalsh(rho / np.maximum(mass, 1e-12)[:, None, None])
    return -np.where(lam > 1e-12, lam * np.log(np.maximum(lam, 1e-12)), 0).sum(axis=1)


def hyponymy(pairs_: DataFrame, name: str = "hyponymy") -> DataFrame:
    return per_matrix(pairs_, hyponymy_kernel, name, ("rho_a", "rho_b"))


def entropy(rhos: DataFrame) -> DataFrame:
    return per_matrix(rhos, entropy_kernel, "entropy")


def facets(rhos: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(concept, rank, weight, vector): eigenvectors of the matrix at trace 1 whose eigenvalue exceeds threshold, largest first.
    A vector's sign makes its largest coordinate positive."""
    kind = rhos.schema["concept"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for concept, flat in zip(pdf["concept"], pdf["rho"], strict=True):
                x = np.asarray(flat, float)
                d = int(round(len(x) ** 0.5))
                lam, vec = np.linalg.eigh(x.reshape(d, d) / max(np.trace(x.reshape(d, d)), 1e-12))
                for rank, k in enumerate(k for k in np.argsort(-lam, kind="stable") if lam[k] > threshold):
                    v = vec[:, k]
                    out.append((concept, rank, float(lam[k]), (v * np.sign(v[np.argmax(np.abs(v))])).tolist()))
            yield pd.DataFrame(out, columns=["concept", "rank", "weight", "vector"])

    return rhos.select("concept", "rho").mapInPandas(run, f"concept {kind}, rank int, weight double, vector array<double>")


def personal_basis(parts: DataFrame, least: int = 50) -> DataFrame:
    """(term, vector): first principal direction of the components of concepts that have `least` or more.

    The covariance follows from the matrix with weight 1 and the mean, so no concept's components meet in one task.
    """
    rows = parts.withColumn("one", F.lit(1.0))
    second = matrices(rows, weight="one")
    mean = rows.select("concept", F.posexplode("vector").alias("i", "x")).groupBy("concept", "i").agg(F.avg("x").alias("m")).groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    kind = parts.schema["concept"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for c, n, flat, m in zip(pdf["concept"], pdf["n"], pdf["rho"], pdf["mean"], strict=True):
                d = len(m)
                v = np.linalg.eigh(np.asarray(flat, float).reshape(d, d) / n - np.outer(m, m))[1][:, -1]
                out.append((c, (v * np.sign(v[np.argmax(np.abs(v))])).tolist()))
            yield pd.DataFrame(out, columns=["term", "vector"])

    return second.where(F.col("n") >= least).join(mean, "concept").mapInPandas(run, f"term {kind}, vector array<double>")


def anomaly(parts: DataFrame, rhos: DataFrame, least: int = 3) -> DataFrame:
    """Adds anomaly: 1 - v.rho.v over the trace, within 0 and 1, of each vector against its concept's matrix; 0 for
    concepts with fewer than `least` components."""
    r = with_mass(rhos).select(F.col("concept").alias("_c"), F.col("n").alias("_n"), "rho", "mass")
    d = F.size("vector")
    rows = parts.join(r, F.col("concept") == F.col("_c"))
    aligned = F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda s, i: s + F.element_at("vector", i + 1) * inner(F.slice("rho", i * d + 1, d), F.col("vector")))
    return rows.withColumn("anomaly", F.when(F.col("_n") < least, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - aligned / F.col("mass"))))).drop("_c", "_n", "rho", "mass")


def queryable(parts: DataFrame, least: int = 2, verbs: bool = True) -> DataFrame:
    """(concept, n): concepts with enough active components."""
    rows = parts.where(~F.col("archived")) if "archived" in parts.columns else parts
    out = rows.groupBy("concept").agg(F.count("*").alias("n"), F.max(F.col("is_verb").cast("int") if "is_verb" in parts.columns else F.lit(0)).alias("v")).where(F.col("n") >= least)
    return (out if verbs else out.where("v = 0")).select("concept", "n")


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
