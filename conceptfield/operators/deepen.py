"""Recursive deepening: a concept's matrix blended with those of the concepts that it contains.

Every round reads the round before (all concepts move together) and is staged in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import Config
from ..functions.shared import stage
from ..functions.vectors import role_table
from . import density as D


def staged(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, among those that `clear_staged` deletes."""
    return stage(df, "round")


def links(judgments: DataFrame) -> DataFrame:
    """(a, b): terms that occur in a judgment together with a, a itself excepted. judgments: subject, verb, object."""
    terms = F.array("subject", "verb", "object")
    return judgments.select(F.explode(terms).alias("a"), terms.alias("t")).select("a", F.explode("t").alias("b")).where("a <> b").distinct()


def personal(parts: DataFrame) -> DataFrame:
    """(concept): those with an active component that doesn't come from a thesaurus. parts: concept, archived, source_text."""
    own = ~F.col("archived") & ~F.coalesce("source_text", F.lit("")).startswith("[thesaurus:")
    return parts.where(own).select("concept").distinct()


def heaviest(rhos: DataFrame, least: float = 0.01, k: int = 200) -> DataFrame:
    """(concept, mass) of the k concepts of most mass: bounded, so it may be broadcast."""
    return D.with_mass(rhos).where(F.col("mass") >= least).select("concept", "mass").orderBy(F.desc("mass"), "concept").limit(k)


def dominant_relation(judgments: DataFrame) -> DataFrame:
    """(a, b, verb): the verb of most weight between both, judgments from b to a counting half; ties by name.

    judgments: subject, verb, object, weight.
    """
    both = judgments.select(F.col("subject").alias("a"), F.col("object").alias("b"), "verb", "weight").unionByName(judgments.select(F.col("object").alias("a"), F.col("subject").alias("b"), "verb", (F.col("weight") * 0.5).alias("weight")))
    sums = both.groupBy("a", "b", "verb").agg(F.sum("weight").alias("w"))
    best = sums.groupBy("a", "b").agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "verb")).alias("m"))
    return best.select("a", "b", F.col("m.verb").alias("verb"))


def candidates(targets: DataFrame, linked: DataFrame, heavy: DataFrame) -> DataFrame:
    """(a, b): for each target its linked terms, but for the heaviest concepts, which `sources` compares with every target."""
    near = linked.where("a <> b").join(targets.select(F.col("concept").alias("a")), "a", "left_semi")
    return near.join(F.broadcast(heavy.select(F.col("concept").alias("b"))), "b", "left_anti").select("a", "b").distinct()


def contained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """trace(AB) / trace(A) of each pair, 0 for an empty A."""
    mass = np.trace(a, axis1=1, axis2=2)
    return np.where(mass < 1e-12, 0.0, (a * b).sum(axis=(1, 2)) / np.maximum(mass, 1e-12))


#: Bytes of matrices that are broadcast at most.
MOST_BROADCAST = 64 << 20


def scores_of_heavy(rhos: DataFrame, heavy: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """(a, b, weight) of every concept a in every heavy concept b: a product with the stack of their matrices, which is
    broadcast if it has at most `most` bytes (16 MB for 200 of 100 dimensions), else a join of each pair's matrices.
    heavy(concept) has at most as many rows as `heaviest` gives."""
    kind = rhos.schema["concept"].dataType.simpleString()
    one = rhos.select(F.size("rho").alias("cells")).first()
    if one and heavy.count() * one.cells * 8 > most:
        names = F.array_sort(F.collect_set("concept"))
        near = rhos.select(F.col("concept").alias("a"), F.lit(1).alias("_one")).join(F.broadcast(heavy.agg(names.alias("b")).withColumn("_one", F.lit(1))), "_one").select("a", F.explode("b").alias("b")).where("a <> b")
        return D.per_matrix(D.pairs(rhos, candidates=near).select("a", "b", "rho_a", "rho_b"), contained, "weight", ("rho_a", "rho_b"))
    rows = rhos.join(F.broadcast(heavy.select("concept")), "concept", "left_semi").select("concept", "rho").collect()
    names = [r.concept for r in rows]
    stack = rhos.sparkSession.sparkContext.broadcast(np.array([r.rho for r in rows], float))

    def run(frames):
        for pdf in frames:
            if names and len(pdf):
                x = np.array(pdf["rho"].tolist(), float)
                mass = x[:, :: int(round(x.shape[1] ** 0.5)) + 1].sum(axis=1)
                w = np.where(mass[:, None] < 1e-12, 0.0, x @ stack.value.T / np.maximum(mass, 1e-12)[:, None])
                out = pd.DataFrame({"a": np.repeat(pdf["concept"].to_numpy(), len(names)), "b": np.tile(np.array(names), len(pdf)), "weight": w.ravel()})
                yield out[out["a"] != out["b"]]

    return rhos.select("concept", "rho").mapInPandas(run, f"a {kind}, b {kind}, weight double")


def sources(rhos: DataFrame, near: DataFrame, threshold: float = 0.1, k: int = 30, heavy: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(a, b, weight, rho_b): the k candidates that contain most of each target, above the threshold.

    Candidates are the pairs of near(a, b) and, for each of targets(concept), all of heavy(concept). Ranks are made of names
    and weights alone; only the k that stay are joined to their matrices.
    """
    some = D.pairs(rhos, candidates=near).select("a", "b", "rho_a", "rho_b")
    found = D.per_matrix(some, contained, "weight", ("rho_a", "rho_b"))
    if heavy is not None:
        every = scores_of_heavy(rhos, heavy)
        found = found.unionByName(every if targets is None else every.join(targets.select(F.col("concept").alias("a")), "a", "left_semi"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("weight", 12)), "b"))
    best = found.where(F.col("weight") > threshold).withColumn("_rn", rank).where(F.col("_rn") <= k).select("a", "b", "weight")
    return best.join(rhos.select(F.col("concept").alias("b"), F.col("rho").alias("rho_b")), "b").select("a", "b", "weight", "rho_b")


def blend(rhos: DataFrame, direct: DataFrame, found: DataFrame, relations: DataFrame | None, alpha: float) -> DataFrame:
    """alpha x direct + (1 - alpha) x weighted mean of the sources' matrices, each turned by its relation.

    Concepts without sources keep their direct matrix. Sums of sources are made per task, then per target.
    """
    rows = found if relations is None else found.join(relations, ["a", "b"], "left")
    rows = rows.withColumn("relation", F.coalesce(F.col("verb"), F.lit("_default")) if relations is not None else F.lit("_default"))
    kind = rhos.schema["concept"].dataType.simpleString()

    def turned(frames):
        tables: dict = {}
        for pdf in frames:
            out = []
            for a, part in pdf.groupby("a", sort=False):
                total, w = 0.0, 0.0
                for weight, flat, rel in zip(part["weight"], part["rho_b"], part["relation"], strict=True):
                    d = int(round(len(flat) ** 0.5))
                    if (rel, d) not in tables:
                        order, sign = role_table("transform:" + rel, d)
                        tables[rel, d] = np.array(order), np.array(sign)
                    order, sign = tables[rel, d]
                    m = np.asarray(flat, float).reshape(d, d)[np.ix_(order, order)] * np.outer(sign, sign)
                    total, w = total + weight * m, w + weight
                out.append((a, w, total.ravel()))
            yield pd.DataFrame(out, columns=["a", "w", "m"])

    def joined(pdf):
        w = pdf["w"].sum()
        return pd.DataFrame({"a": pdf["a"].iloc[:1], "m": [np.sum(np.stack(pdf["m"].tolist()), axis=0) / w]})

    mean = rows.select("a", "weight", "rho_b", "relation").mapInPandas(turned, f"a {kind}, w double, m array<double>").groupBy("a").applyInPandas(joined, f"a {kind}, m array<double>")
    both = direct.join(mean, F.col("concept") == F.col("a"), "left")
    return both.select("concept", "n", F.when(F.col("m").isNull(), F.col("rho")).otherwise(F.zip_with("rho", "m", lambda x, y: alpha * x + (1 - alpha) * y)).alias("rho"))


def deepen(rhos: DataFrame, judgments: DataFrame, cfg: Config = Config(), targets: DataFrame | None = None, iterations: int | None = None) -> DataFrame:
    """Matrices after the rounds: (concept, n, rho). rhos: concept, n, rho; judgments: subject, verb, object, weight.

    targets(concept) are deepened, others keep their matrix; all by default (`personal` gives those that don't stand on
    thesaurus judgments alone).
    """
    direct = staged(rhos)
    prepared = prepare(direct, judgments, cfg, targets)
    now = direct
    for _ in range(cfg.deepen_iterations if iterations is None else iterations):
        now = one_round(now, direct, prepared, cfg, targets)
    return now


def prepare(direct: DataFrame, judgments: DataFrame, cfg: Config, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What all rounds share: candidates, heaviest concepts, relations."""
    heavy = staged(heaviest(direct, cfg.deepen_min_mass, cfg.deepen_max_candidates))
    near = staged(candidates(direct if targets is None else targets, links(judgments), heavy))
    return near, heavy, staged(dominant_relation(judgments))


def one_round(now: DataFrame, direct: DataFrame, prepared: tuple[DataFrame, DataFrame, DataFrame], cfg: Config, targets: DataFrame | None = None) -> DataFrame:
    near, heavy, relations = prepared
    found = sources(now, near, cfg.deepen_containment, cfg.deepen_top_k, heavy, targets)
    return staged(blend(now, direct, found, relations, cfg.deepen_alpha))


def containment_change(before: DataFrame, after: DataFrame, watched: DataFrame) -> DataFrame:
    """One row: mean absolute change of the containment of watched(a, b), 0 where a matrix is missing."""
    def of(rhos, name):
        some = D.pairs(rhos, candidates=watched.select("a", "b").distinct()).select("a", "b", "rho_a", "rho_b")
        return D.per_matrix(some, contained, name, ("rho_a", "rho_b"))

    rows = watched.select("a", "b").distinct().join(of(before, "x"), ["a", "b"], "left").join(of(after, "y"), ["a", "b"], "left")
    return rows.agg(F.coalesce(F.avg(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("containment_delta"))


def deepen_until(rhos: DataFrame, judgments: DataFrame, watched: DataFrame, cfg: Config = Config(), most: int = 10, eigenvalue: float = 1e-6, containment: float = 1e-5) -> tuple[DataFrame, list[dict]]:
    """Rounds one by one until both changes are below their limits, `most` at most: the matrices and a report of each round."""
    now, report = staged(rhos), []
    prepared = prepare(now, judgments, cfg)
    direct = now
    for _ in range(most):
        after = one_round(now, direct, prepared, cfg)
        row = convergence(now, after).first().asDict() | containment_change(now, after, watched).first().asDict()
        report.append(row)
        now = after
        if (row["eigenvalue_delta"] or 0.0) < eigenvalue and row["containment_delta"] < containment:
            break
    return now, report


def convergence(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean absolute change of sorted eigenvalues and of mass, and both total masses."""
    a = before.select("concept", F.col("rho").alias("rho_a"))
    both = a.join(after.select("concept", F.col("rho").alias("rho_b")), "concept")

    def change(x, y):
        return np.abs(np.linalg.eigvalsh(x) - np.linalg.eigvalsh(y)).mean(axis=1)

    rows = D.per_matrix(both.withColumn("mass_a", D.trace(F.col("rho_a"), D.side(F.col("rho_a")))).withColumn("mass_b", D.trace(F.col("rho_b"), D.side(F.col("rho_b")))), change, "delta", ("rho_a", "rho_b"))
    return rows.agg(F.avg("delta").alias("eigenvalue_delta"), F.avg(F.abs(F.col("mass_b") - F.col("mass_a"))).alias("mass_delta"), F.sum("mass_a").alias("mass_before"), F.sum("mass_b").alias("mass_after"))
