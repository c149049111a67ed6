"""Concepts over a product of spaces: meaning, relation and context, kept as factors.

A component is a vector in each space and a weight; the concept's matrix is the sum of weight times the projector on the
product of the vectors. That matrix, whose side is the product of all dimensions, is never formed: tracing out a space
leaves the vectors of the others and multiplies the weight by the squared length of what is traced out, so every partial
trace is an ordinary sum of components (`density.matrices`), or of sketches (`factors.sketches`) where what is kept is
wide. A stored sketch can be traced too (`traced`), as its rows are vectors of the product space.

Components: concept, one array<double> for each space, w. Rows with a null concept, weight or vector are left out of
`reduced`; empty tables give empty results; other columns are ignored unless named in `key`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.config import Config
from ..functions.shared import stage
from . import density, factors, materialize

SPACES = ("semantic", "relational", "contextual")


def kron(a: Column, b: Column) -> Column:
    """The product of two vectors: a's coordinates are the slower ones."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def context(quality: Column, modality: Column, freshness: Column) -> Column:
    """Unit vector of 8 coordinates: quality, times certainty, times freshness. Modality and freshness within 0 and 1 are
    squared coordinates, so that a component's context is spread over both answers as far as it is undecided."""
    def two(p: Column) -> Column:
        p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        return F.array(F.sqrt(p), F.sqrt(1 - p))

    said = F.when(quality == "NEGATIVE", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    return kron(kron(said, two(modality)), two(freshness))


def components(judgments: DataFrame, cfg: Config = Config(), relation_dim: int = 8) -> DataFrame:
    """(space_id, concept, seq, semantic, relational, contextual, w) of judgments, for subjects and objects: the other noun's
    vector, the verb's in `relation_dim` coordinates, the context. Freshness is what time has left of the weight."""
    terms = judgments.select(F.explode(F.array("subject", "object")).alias("term"))
    nouns = vectors.term_vectors(terms, cfg.dim)
    verbs = vectors.term_vectors(judgments.select(F.col("verb").alias("term")), relation_dim)
    parts = materialize.fan_out(judgments, cfg).where("role <> 'verb'")
    other = F.when(F.col("role") == "object", F.col("subject")).otherwise(F.col("object"))
    rows = parts.withColumn("_other", other).join(nouns.select(F.col("term").alias("_other"), F.col("vector").alias("semantic")), "_other").join(verbs.select(F.col("term").alias("verb"), F.col("vector").alias("relational")), "verb")
    fresh = F.pow(1 + F.greatest(F.lit(0.0), F.lit(float(cfg.as_of)) - F.col("ts")) / F.lit(cfg.decay_tau), F.lit(-cfg.decay_exponent))
    return rows.select("space_id", "concept", "seq", "semantic", "relational", context(F.col("quality"), F.col("modality"), fresh).alias("contextual"), F.col("weight").alias("w"))


def reduced(parts: DataFrame, keep: Sequence[str], spaces: Sequence[str] = SPACES, key: Sequence[str] = ("concept",)) -> DataFrame:
    """(key..., vector, w): components of the partial trace over the spaces that aren't kept, in the order of `spaces`."""
    held = [s for s in spaces if s in keep]
    if not held or set(keep) - set(spaces):
        raise ValueError(f"keep some of {tuple(spaces)}")
    vector, weight = F.col(held[0]), F.col("w")
    for s in held[1:]:
        vector = kron(vector, F.col(s))
    for s in spaces:
        if s not in held:
            weight = weight * vectors.dot(F.col(s), F.col(s))
    rows = parts.dropna(subset=[*key, *spaces, "w"])
    return rows.select(*key, vector.alias("vector"), weight.alias("w"))


def partial_trace(parts: DataFrame, keep: Sequence[str], spaces: Sequence[str] = SPACES, key: Sequence[str] = ("concept",)) -> DataFrame:
    """(key..., n, rho) over the kept spaces: what is left of a concept when one doesn't look at the others."""
    return density.matrices(reduced(parts, keep, spaces, key), key)


def given(parts: DataFrame, space: str, direction: Sequence[float]) -> DataFrame:
    """Components as seen when `space` is found in a direction, of which the length doesn't matter: weights times the squared
    coordinate along it; what lies across it goes. Tracing out `space` afterwards gives the conditional matrix."""
    d = np.asarray(direction, float)
    d = d / np.linalg.norm(d)
    along = vectors.dot(F.col(space), F.array(*[F.lit(float(x)) for x in d]))
    own = vectors.dot(F.col(space), F.col(space))
    return parts.withColumn("w", F.when(own > 0, F.col("w") * along * along / own).otherwise(0.0)).where("w > 0")


def sketches(parts: DataFrame, rank: int = factors.RANK, spaces: Sequence[str] = SPACES, key: Sequence[str] = ("concept",)) -> DataFrame:
    """Sketches over the product of all spaces: rank x (product of dimensions) numbers a concept. `factors.inner` encloses
    traces of products of the whole matrices."""
    rows = parts.dropna(subset=[*key, *spaces, "w"]).select(*key, F.array(*spaces).alias("vector"), "w")
    return factors.sketches(rows, rank, key)


#: Vectors of a group that meet at once, and a concept's vectors on average from which a group is summed; vectors that one sum takes;
#: rows that are multiplied at a time; rows of a sum that are moved together.
CHUNK, SUMMED, DEALT, STEP, ROWS = 16384, 1000, 65536, 256, 8


def squares(x: np.ndarray) -> np.ndarray:
    """Rows whose products are the squared products of x's rows: each pair of coordinates once."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def products(parts: DataFrame, within: str, spaces: Sequence[str] = SPACES) -> DataFrame:
    """(a, b, inner, mass_a, mass_b) of all pairs a < b of a group's concepts, `within` naming the group: the exact traces of the products
    of their whole matrices, whatever the number of vectors. A concept is in one group.

    The trace is the sum, over the vectors of both, of weights times the squared products in each space. Groups of few vectors a concept
    are compared vector by vector, in cells of two chunks. In others each concept's sum of squared vectors is made, which is linear in
    the number of vectors: the matrix but for what all its rows have in common, moved in slices. Both are bounded in memory.
    """
    kinds = dict(parts.dtypes)
    rows = parts.dropna(subset=[within, "concept", *spaces, "w"])
    deal = F.xxhash64(*parts.columns)  # all columns, so that copies are dealt too if something tells them apart
    rows = rows.select(F.col(within).alias("g"), "concept", *[F.col(s).cast("array<double>").alias(f"x{i}") for i, s in enumerate(spaces)], F.col("w").cast("double").alias("w"), deal.alias("deal"))
    xs = [f"x{i}" for i in range(len(spaces))]
    own = F.col("w")
    for x in xs:
        own = own * vectors.dot(F.col(x), F.col(x))
    sizes = stage(rows.groupBy("g", "concept").agg(F.count("*").alias("n"), F.sum(own).alias("mass")), "sizes")
    groups = sizes.groupBy("g").agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.max("n").alias("most")).where(F.col("all") > CHUNK)
    # at most a group for CHUNK vectors, so it may be broadcast
    plan = groups.select("g", (F.col("all") >= SUMMED * F.col("k")).alias("summed"), F.ceil(F.col("all") / CHUNK).alias("chunks"), F.ceil(F.col("most") / DEALT).alias("deals"))
    rows = rows.join(F.broadcast(plan), "g", "left")
    fields = f"g {kinds[within]}, a {kinds['concept']}, b {kinds['concept']}, t double"

    def listed(g, names, t):
        i, j = np.triu_indices(len(names), 1)
        names = np.array(names, object)
        return pd.DataFrame({"g": [g] * len(i), "a": names[i], "b": names[j], "t": t[i, j]})

    def stacked(pdf):
        return [np.array(pdf[x].tolist(), float) for x in xs]

    def cell(pdf):
        """Pairs of a chunk's vectors with another chunk's, or its own."""
        pdf = pdf.sort_values("concept")
        names, code = np.unique(pdf["concept"].to_numpy(), return_inverse=True)
        left, right = ((pdf["chunk"] == pdf[c]).to_numpy() for c in ("low", "high"))
        t = np.zeros((len(names), len(names)))
        if left.any() and right.any():
            x, w, ys = stacked(pdf[left]), pdf["w"].to_numpy()[left], [y.T for y in stacked(pdf[right])]
            v, (there, starts) = pdf["w"].to_numpy()[right], np.unique(code[right], return_index=True)
            for at in range(0, len(w), STEP):
                k = np.multiply.outer(w[at : at + STEP], v)
                for one, other in zip(x, ys, strict=True):
                    k *= (one[at : at + STEP] @ other) ** 2
                np.add.at(t, np.ix_(code[left][at : at + STEP], there), np.add.reduceat(k, starts, axis=1))
        same = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        return listed(pdf["g"].iloc[0], names, t if same else t + t.T)

    def sums(frames):
        """Slices of each key's sum, which arrives sorted, one key after another."""
        now, total = None, None

        def slices():
            for at in range(0, len(total), ROWS):
                yield (now[0], now[1], at, total[at : at + ROWS].ravel())

        for pdf in frames:
            keys = list(zip(pdf["g"], pdf["concept"], pdf["deal"], strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[lo] != now:
                    if now is not None:
                        yield pd.DataFrame(list(slices()), columns=["g", "concept", "at", "m"])
                    now, total = keys[lo], 0.0
                for at in range(lo, hi, STEP):
                    part = pdf.iloc[at : min(at + STEP, hi)]
                    first, *others = map(squares, stacked(part))
                    rest = np.ones((len(part), 1))
                    for other in others:
                        rest = (rest[:, :, None] * other[:, None, :]).reshape(len(part), -1)
                    total = total + (first * part["w"].to_numpy()[:, None]).T @ rest
        if now is not None:
            yield pd.DataFrame(list(slices()), columns=["g", "concept", "at", "m"])

    def sliced(pdf):
        """A slice of all sums of a group."""
        names, code = np.unique(pdf["concept"].to_numpy(), return_inverse=True)
        m = np.zeros((len(names), len(pdf["m"].iloc[0])))
        for c, one in zip(code, pdf["m"], strict=True):
            m[c] += one
        return listed(pdf["g"].iloc[0], names, m @ m.T)

    few = rows.where("summed IS NULL OR NOT summed").withColumn("chunk", F.pmod("deal", F.coalesce("chunks", F.lit(1))))
    few = few.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)))
    few = few.select("g", "concept", *xs, "w", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    met = few.groupBy("g", "low", "high").applyInPandas(cell, fields)
    keyed = rows.where("summed").select("g", "concept", *xs, "w", F.pmod("deal", "deals").alias("deal"))
    keyed = keyed.repartition("g", "concept", "deal").sortWithinPartitions("g", "concept", "deal")
    summed = keyed.mapInPandas(sums, f"g {kinds[within]}, concept {kinds['concept']}, at int, m array<double>").groupBy("g", "at").applyInPandas(sliced, fields)
    out = met.unionByName(summed).groupBy("a", "b").agg(F.sum("t").alias("inner"))
    for side in ("a", "b"):
        out = out.join(sizes.select(F.col("concept").alias(side), F.col("mass").alias(f"mass_{side}")), side)
    return out.select("a", "b", "inner", "mass_a", "mass_b")


def traced(found: DataFrame, dims: Sequence[int], keep: Sequence[int], rank: int = factors.RANK) -> DataFrame:
    """(concept, n, rho): partial traces of sketches over spaces of `dims`, keeping those at the positions `keep`, in order.

    What the sketch left out is missing: the trace of what is missing is mass less the trace of rho.
    """
    kind, held = dict(found.dtypes)["concept"], sorted(keep)
    order = [0, *[1 + i for i in held], *[1 + i for i in range(len(dims)) if i not in held]]
    side = int(np.prod([dims[i] for i in held]))

    def run(frames):
        for pdf in frames:
            rhos = []
            for flat in pdf["factor"]:
                x = np.reshape(flat, (rank, *dims)).transpose(order).reshape(rank, side, -1)
                rhos.append(np.einsum("kar,kbr->ab", x, x).ravel())
            yield pd.DataFrame({"concept": pdf["concept"], "n": pdf["n"], "rho": rhos})

    return found.select("concept", "n", "factor").mapInPandas(run, f"concept {kind}, n long, rho array<double>")


def dependence(parts: DataFrame, first: str, second: str, spaces: Sequence[str] = SPACES) -> DataFrame:
    """(concept, n, entropy_first, entropy_second, entropy_both, dependence): the mutual information of two spaces. It is 0
    where a concept means the same in each context, and grows as meaning and context tell of one another."""
    def entropy(keep, name):
        return density.entropy(partial_trace(parts, keep, spaces)).select("concept", "n", F.col("entropy").alias(name))

    one, two, both = entropy([first], "entropy_first"), entropy([second], "entropy_second").drop("n"), entropy([first, second], "entropy_both").drop("n")
    return one.join(two, "concept").join(both, "concept").withColumn("dependence", F.col("entropy_first") + F.col("entropy_second") - F.col("entropy_both"))
