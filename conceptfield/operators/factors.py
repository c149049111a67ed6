"""Low-rank factors of density matrices, with bounds of what they leave out.

A sketch of a concept is a factor L of `rank` rows, so that its matrix is L'L and a remainder that is never negative:
what truncation dropped. `bound` is a bound of the remainder's largest eigenvalue, and the mass is exact, so the trace of
the remainder is known too. Sketches are made where the components are and merge: rows are put together and truncated
again, bounds add up. A task's sketches meet in FAN groups of a concept, then these in one, so that a concept with
components in every task merges a bounded number at a time.

Products of two matrices are products of factors, rank x rank numbers; `inner` and `inner_most` enclose the trace of the
product of the whole matrices. Weights must not be negative.

Concepts whose components are the same share a sketch: that of their head, a concept that stands for them. Members: concept,
n, head. Rounds of deepening keep it so for concepts that have the same sources and relations too (`classes`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.config import Config
from ..functions.shared import dealt, set_digest, stage, with_head
from ..functions.vectors import role_table
from . import deepen, materialize

RANK, FAN = 10, 64
FIELDS = "n long, mass double, factor array<double>, bound double"
FIELDS_OF = ("n", "mass", "factor", "bound")
#: Numbers that a task makes at a time, and holds at most; what a key takes beside its rows, counted in numbers.
CELLS, MOST, KEY = 1_000_000, 8_000_000, 200


def truncated(rows: np.ndarray, rank: int) -> tuple[np.ndarray, float]:
    """(factor of `rank` rows, filled with zeros; the largest eigenvalue left out) of rows'rows. Where the rank is the whole one, the
    factor is a triangle, half of it zeros."""
    out = np.zeros((rank, rows.shape[1]))
    rows = rows[np.any(rows != 0, axis=1)]
    if len(rows) <= rank:
        out[: len(rows)] = rows
        return out, 0.0
    if rank >= rows.shape[1]:
        out[: rows.shape[1]] = np.linalg.qr(rows, "r")
        return out, 0.0
    if len(rows) > 4 * rows.shape[1]:  # the matrix is smaller than its rows
        lam, vec = np.linalg.eigh(rows.T @ rows)
        s, vt = np.sqrt(np.maximum(lam[::-1], 0)), vec.T[::-1]
    else:
        _, s, vt = np.linalg.svd(rows, full_matrices=False)
    k = min(rank, len(s))
    out[:k] = s[:k, None] * vt[:k]
    return out, float(s[k] ** 2) if len(s) > k else 0.0


class Sketch:
    """A sum of matrices given as rows or as other sketches, truncated whenever it holds many rows."""

    def __init__(self, rank: int):
        self.rank, self.n, self.mass, self.bound, self.rows, self.held = rank, 0, 0.0, 0.0, [], 0

    def add(self, rows: np.ndarray, n: int, mass: float, bound: float = 0.0) -> None:
        self.n, self.mass, self.bound = self.n + n, self.mass + mass, self.bound + bound
        self.rows.append(rows)
        self.held += len(rows)
        if self.held > max(4 * self.rank, rows.shape[1]):
            self.rows = [self.factor()]
            self.held = self.rank

    def factor(self) -> np.ndarray:
        out, dropped = truncated(np.concatenate(self.rows), self.rank)
        self.bound += dropped
        return out

    def row(self) -> tuple:
        return self.n, self.mass, self.factor().ravel(), self.bound


def kept(factor: np.ndarray) -> np.ndarray:
    """The rows of a factor that aren't filled with zeros, one at least."""
    return factor[: max(1, int(np.any(factor != 0, axis=1).sum()))]


def merged(parts: DataFrame, names: Sequence[str], fields: str, rank: int) -> DataFrame:
    """Sketches of equal names as one; parts: names..., slot and a sketch's fields, the factor without its zeros, in `held` rows. A
    task reads them sorted, one key after another."""
    def level(df: DataFrame, keys: list[str], schema: str, last: bool) -> DataFrame:
        columns = [*keys, *FIELDS_OF, *([] if last else ["held"])]

        def run(frames):
            now, s, out, size = None, None, [], 0

            def row():
                n, mass, factor, bound = s.row()
                full = np.reshape(factor, (rank, -1))
                return (*now, n, mass, factor, bound) if last else (*now, n, mass, kept(full).ravel(), bound, len(kept(full)))

            for pdf in frames:
                for r in pdf[[*keys, *FIELDS_OF, "held"]].itertuples(index=False):
                    k = tuple(None if pd.isna(v) else v for v in r[: len(keys)])
                    if k != now:
                        if s is not None:
                            out.append(row())
                            size += len(out[-1][len(keys) + 2])
                            if size > CELLS:
                                yield pd.DataFrame(out, columns=columns, dtype=object)
                                out, size = [], 0
                        now, s = k, Sketch(rank)
                    s.add(np.reshape(r.factor, (r.held, -1)), r.n, r.mass, r.bound)
            if s is not None:
                yield pd.DataFrame([*out, row()], columns=columns, dtype=object)

        return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{schema}, {FIELDS}" + ("" if last else ", held int"))

    return level(level(parts, [*names, "slot"], f"{fields}, slot int", False), list(names), fields, True)


def product_rows(spaces: list[list]) -> np.ndarray:
    """Products of rows' vectors, one after another; rows: a vector for each space, the first one's coordinates the slowest."""
    out = None
    for i in range(len(spaces[0])):
        x = np.array([r[i] for r in spaces], float)
        out = x if out is None else (out[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    return out


def sketches(parts: DataFrame, rank: int = RANK, key: Sequence[str] = ("concept",), weight: str = "w", vector: str = "vector") -> DataFrame:
    """(key..., n, mass, factor, bound) of components: the factor row by row, rank x d.

    vector may be an array of vectors, one for each space: their product is made where it is summed, some rows at a time.
    """
    kinds, names = {f.name: f.dataType.simpleString() for f in parts.schema}, list(key)
    several = kinds[vector].startswith("array<array")

    def partial(frames):
        held: dict = {}
        size, slot = 0, TaskContext.get().partitionId() % FAN

        def flush():
            out, cells = [], 0
            for k, s in held.items():
                n, mass, factor, bound = s.row()
                x = kept(np.reshape(factor, (rank, -1)))
                out.append((*k, slot, n, mass, x.ravel(), bound, len(x)))
                cells += x.size
                if cells > CELLS:
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                    out, cells = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns, dtype=object)

        columns = [*names, "slot", *FIELDS_OF, "held"]
        for pdf in frames:
            at, step = 0, 256
            while at < len(pdf):
                part = pdf.iloc[at : at + step]
                at += len(part)
                x = product_rows(part[vector].tolist()) if several else np.array(part[vector].tolist(), float)
                step = max(1, CELLS // max(1, x.shape[1]))
                x = x * np.sqrt(part[weight].to_numpy(float))[:, None]
                mass = (x * x).sum(axis=1)
                group = part.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
                keys = [part[c].to_numpy(object) for c in names]
                for rows in np.split(order, cuts[1:]):
                    k = tuple(None if pd.isna(c[rows[0]]) else c[rows[0]] for c in keys)
                    s = held.get(k)
                    if s is None:
                        s = held[k] = Sketch(rank)
                        size += KEY
                    size -= s.held * x.shape[1]
                    s.add(x[rows], len(rows), float(mass[rows].sum()))
                    size += s.held * x.shape[1]
                if size > MOST:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    fields = ", ".join(f"{k} {kinds[k]}" for k in names)
    cells = parts.select(*names, F.col(vector).cast("array<array<double>>" if several else "array<double>").alias(vector), F.col(weight).cast("double").alias(weight))
    return merged(cells.mapInPandas(partial, f"{fields}, slot int, {FIELDS}, held int"), names, fields, rank)


def of_judgments(judgments: DataFrame, cfg: Config = Config(), rank: int = RANK) -> tuple[DataFrame, DataFrame]:
    """(members, the heads' sketches) of judgments' components before consolidation. Only heads get vectors."""
    parts = stage(materialize.distinct_components(judgments, cfg), "parts")
    members = stage(materialize.alike(parts), "members")
    firsts = parts.join(members.where("concept = head").select("concept"), "concept", "left_semi")
    return members, sketches(materialize.with_vectors(firsts, cfg), rank, weight="weight")


def spread(found: DataFrame, members: DataFrame) -> DataFrame:
    """(concept, n, mass, factor, bound) of all members, from their heads' sketches."""
    held = found.select(F.col("concept").alias("head"), "mass", "factor", "bound")
    return members.join(held, "head").select("concept", "n", "mass", "factor", "bound")


def products(la: np.ndarray, lb: np.ndarray, mass_a, mass_b, bound_a, bound_b) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) the trace of the product can be, of stacks of factors [pair, rank, d]."""
    least = ((la @ lb.transpose(0, 2, 1)) ** 2).sum(axis=(1, 2))
    return least, least + slack((la * la).sum(axis=(1, 2)), (lb * lb).sum(axis=(1, 2)), mass_a, mass_b, bound_a, bound_b)


def slack(own_a, own_b, mass_a, mass_b, bound_a, bound_b) -> np.ndarray:
    """What the remainders can add to a product: own are the traces that the factors hold."""
    rest_a, rest_b = np.maximum(mass_a - own_a, 0), np.maximum(mass_b - own_b, 0)
    bound_a, bound_b = np.minimum(bound_a, rest_a), np.minimum(bound_b, rest_b)
    return bound_a * own_b + bound_b * own_a + np.minimum(bound_a * rest_b, bound_b * rest_a)


def inner(pairs: DataFrame, rank: int = RANK) -> DataFrame:
    """Adds inner and inner_most to pairs(a, b, factor_a, factor_b, mass_a, mass_b, bound_a, bound_b), which lose their factors."""
    names = ("mass_a", "mass_b", "bound_a", "bound_b")
    keep = [c for c in pairs.columns if not c.startswith("factor_")]
    kinds = dict(pairs.dtypes)

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                la, lb = (np.array(part[c].tolist(), float).reshape(len(part), rank, -1) for c in ("factor_a", "factor_b"))
                least, most = products(la, lb, *(part[c].to_numpy(float) for c in names))
                yield part[keep].assign(inner=least, inner_most=most)

    return pairs.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "inner double", "inner_most double"]))


def joined(found: DataFrame, candidates: DataFrame, few: bool = False) -> DataFrame:
    """candidates(a, b) with the sketches of both, which are broadcast if they are few."""
    for side in ("a", "b"):
        s = found.select(F.col("concept").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("factor", "mass", "bound")])
        candidates = candidates.join(F.broadcast(s) if few else s, side)
    return candidates


def contained(inner_: str = "inner") -> Column:
    """trace(AB) / trace(A) of either end of the enclosure, 0 for an empty a."""
    return F.when(F.col("mass_a") < 1e-12, 0.0).otherwise(F.col(inner_) / F.col("mass_a"))


def alike(inner_: str = "inner") -> Column:
    return F.col(inner_) / (F.col("mass_a") * F.col("mass_b"))


def sources(found: DataFrame, near: DataFrame, heavy: DataFrame, cfg: Config, rank: int = RANK, targets: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(a, b, weight, gap): the cfg.deepen_top_k candidates that contain most of each target, by factors; gap is how much larger
    the weight may be. Heavy concepts are a broadcast stack, rank x d numbers each and at most as many as `deepen.heaviest`
    gives, with which every target and every candidate of a heavy target is compared where it is; other pairs meet by a join.

    near(a, b) may have `of`, the head whose sketch b shares: heads are compared, b is ranked, and the result has `of` too."""
    kind = dict(found.dtypes)["concept"]
    heads, top = near if "of" in near.columns else None, F.broadcast(heavy.select(F.col("concept").alias("a")))
    near = near.select("a", "b") if heads is None else heads.select("a", F.col("of").alias("b")).distinct()
    light = near.join(top, "a", "left_anti")
    some = None if few and light.isEmpty() else inner(joined(found, light, few), rank).select("a", "b", contained().alias("weight"), (contained("inner_most") - contained()).alias("gap"))
    rows = found.join(F.broadcast(heavy.select("concept")), "concept", "left_semi").select("concept", "mass", "factor", "bound").toArrow()
    names = np.array(rows["concept"].to_pylist(), object)
    held = found.sparkSession.sparkContext.broadcast([rows["factor"].combine_chunks().flatten().to_numpy(zero_copy_only=False), *[rows[c].to_numpy() for c in ("mass", "bound")]])

    def run(frames):
        for pdf in frames:
            if not len(names) or not len(pdf):
                continue
            lb, mass, bound = held.value
            lb = lb.reshape(len(names), rank, -1)
            whole = rank >= lb.shape[2]  # matrices are no larger than factors, and one product each
            flat = (lb.transpose(0, 2, 1) @ lb).reshape(len(names), -1).T if whole else lb.reshape(len(names) * rank, -1).T
            place = {n: i for i, n in enumerate(names)}
            step = max(1, CELLS // (rank * lb.shape[2] if whole else rank * rank * len(names)))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                la, ma, ea = np.array(part["factor"].tolist(), float), part["mass"].to_numpy(float)[:, None], part["bound"].to_numpy(float)[:, None]
                if whole:
                    x = la.reshape(len(part), rank, -1)
                    least = (x.transpose(0, 2, 1) @ x).reshape(len(part), -1) @ flat
                else:
                    least = ((la.reshape(len(part) * rank, -1) @ flat) ** 2).reshape(len(part), rank, len(names), rank).sum(axis=(1, 3))
                most = least + slack((la * la).sum(axis=1)[:, None], (lb * lb).sum(axis=(1, 2)), ma, mass, ea, bound)
                own, of = part["concept"].to_numpy(), np.zeros(least.shape, bool)
                for row, heavies in enumerate(part["of_heavy"]):
                    if heavies is not None:
                        of[row, [place[h] for h in heavies if h in place]] = True
                is_target = part["target"].to_numpy(bool)[:, None] & (own[:, None] != names[None, :])
                for a, b, size, pairs in ((own[:, None], names[None, :], ma, is_target), (names[None, :], own[:, None], mass[None, :], of)):
                    low, high = (np.where(size < 1e-12, 0.0, t / np.maximum(size, 1e-12)) for t in (least, most))
                    good = (low > cfg.deepen_containment) & pairs
                    yield pd.DataFrame({"a": np.broadcast_to(a, low.shape)[good], "b": np.broadcast_to(b, low.shape)[good], "weight": low[good], "gap": (high - low)[good]})

    # a candidate is that of at most as many heavy targets as there are heavy concepts
    of_heavy = near.join(top, "a", "left_semi").groupBy(F.col("b").alias("concept")).agg(F.collect_set("a").alias("of_heavy"))
    flagged = found.withColumn("target", F.lit(True)) if targets is None else found.join(targets.select("concept", F.lit(True).alias("target")).distinct(), "concept", "left")
    goal = flagged.join(F.broadcast(of_heavy) if few else of_heavy, "concept", "left").withColumn("target", F.coalesce("target", F.lit(False))).where("target OR of_heavy IS NOT NULL")
    every = goal.select("concept", "mass", "factor", "bound", "target", "of_heavy").mapInPandas(run, f"a {kind}, b {kind}, weight double, gap double")
    rank_ = F.row_number().over(W.partitionBy("a").orderBy(F.desc(F.round("weight", 12)), "b"))
    best = (every if some is None else some.unionByName(every)).where(F.col("weight") > cfg.deepen_containment)
    if heads is not None:  # heavy concepts are their own heads, and in no row of near
        best = best.withColumnRenamed("b", "of").join(heads, ["a", "of"], "left").withColumn("b", F.coalesce("b", "of"))
    best = best.withColumn("_rn", rank_)
    return best.where(F.col("_rn") <= cfg.deepen_top_k).drop("_rn")


def blend(now: DataFrame, direct: DataFrame, found: DataFrame, relations: DataFrame, alpha: float, rank: int = RANK, few: bool = False) -> DataFrame:
    """alpha x direct + (1 - alpha) x weighted mean of the sources' sketches, each turned by its relation, as sketches.

    found: a, b, weight, and `of` where b's sketch is another's. A turned factor is the factor with its coordinates permuted. mass and bound stay exact for these
    weights: the remainder is what truncation drops, in this round and those before. Concepts without sources keep their
    direct sketch. Equal lists of sources, relations and weights (to 12 digits) have one mean, which is made once. Few sketches are
    broadcast, so that lists alone are shuffled, and a list's sum is made in one task.
    """
    found = found if "of" in found.columns else found.withColumn("of", F.col("b"))
    rows = found.join(relations, ["a", "b"], "left").withColumn("relation", F.coalesce("verb", F.lit("_default"))).drop("verb")
    kind = dict(now.dtypes)["concept"]
    listed = F.array_sort(F.collect_list(F.struct("b", "of", "relation", F.round("weight", 12).alias("weight"))))  # no longer than the sources of a target
    lists = rows.groupBy(F.col("a").alias("concept")).agg(listed.alias("s")).select("concept", F.sha2(F.to_json("s"), 256).alias("a"), "s")
    lists = stage(lists, "lists")
    once = lists.groupBy("a").agg(F.first("s").alias("s")).select("a", F.inline("s"))
    held = now.select(F.col("concept").alias("of"), "mass", "factor", "bound")
    rows = dealt(once, "a").sortWithinPartitions("a").join(F.broadcast(held), "of") if few else once.join(held, "of")

    def turned(frames):
        tables: dict = {}
        for pdf in frames:
            out = []
            for a, part in pdf.groupby("a", sort=False):
                s, total = Sketch(rank), 0.0
                for weight, flat, mass, bound, rel in zip(part["weight"], part["factor"], part["mass"], part["bound"], part["relation"], strict=True):
                    x = np.reshape(flat, (rank, -1))
                    if (rel, x.shape[1]) not in tables:
                        order, sign = role_table("transform:" + rel, x.shape[1])
                        tables[rel, x.shape[1]] = np.array(order), np.array(sign)
                    order, sign = tables[rel, x.shape[1]]
                    s.add(np.sqrt(weight) * x[:, order] * sign, 1, weight * mass, weight * bound)
                    total += weight
                out.append((a, total, *s.row()[1:]))
            yield pd.DataFrame(out, columns=["a", "w", "mass", "factor", "bound"])

    def mean(pdf):
        s, w = Sketch(rank), pdf["w"].sum()
        for mass, factor, bound in zip(pdf["mass"], pdf["factor"], pdf["bound"], strict=True):
            s.add(np.reshape(factor, (rank, -1)) / np.sqrt(w), 0, mass / w, bound / w)
        _, mass, factor, bound = s.row()
        return pd.DataFrame({"a": pdf["a"].iloc[:1], "m_mass": [mass], "m_factor": [factor], "m_bound": [bound]})

    def in_order(frames):
        """Means of lists whose rows follow one another in the task."""
        held = None
        for pdf in turned(frames):
            pdf = pdf if held is None else pd.concat([held, pdf])
            if len(pdf):
                last = pdf["a"] == pdf["a"].iloc[-1]
                held = pdf[last]
                for _, part in pdf[~last].groupby("a", sort=False):
                    yield mean(part)
        if held is not None:
            yield mean(held)

    rows, fields = rows.select("a", "weight", "relation", "mass", "factor", "bound"), "a string, m_mass double, m_factor array<double>, m_bound double"
    if few:
        means = rows.mapInPandas(in_order, fields)
    else:
        means = rows.mapInPandas(turned, "a string, w double, mass double, factor array<double>, bound double").groupBy("a").applyInPandas(mean, fields)

    def blended(frames):
        for pdf in frames:
            out = []
            for c, n, mass, factor, bound, m_mass, m_factor, m_bound in pdf.itertuples(index=False):
                if m_factor is not None:
                    s = Sketch(rank)
                    s.add(np.sqrt(alpha) * np.reshape(factor, (rank, -1)), n, alpha * mass, alpha * bound)
                    s.add(np.sqrt(1 - alpha) * np.reshape(m_factor, (rank, -1)), 0, (1 - alpha) * m_mass, (1 - alpha) * m_bound)
                    n, mass, factor, bound = s.row()
                out.append((c, n, mass, factor, bound))
            yield pd.DataFrame(out, columns=["concept", "n", "mass", "factor", "bound"])

    named = lists.select("concept", "a")
    if few:
        both = direct.join(F.broadcast(named), "concept", "left").join(F.broadcast(means), "a", "left")
    else:
        both = direct.join(named.join(means, "a").drop("a"), "concept", "left")
    both = both.select("concept", "n", "mass", "factor", "bound", "m_mass", "m_factor", "m_bound")
    return both.mapInPandas(blended, f"concept {kind}, {FIELDS}")


def classes(members: DataFrame, near: DataFrame, relations: DataFrame, heavy: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(concept, n, head, was): members with the heads of those that deepen alike, and the heads that they had. Concepts of one sketch
    whose candidates and relations are the same, both targets or none, have the same sources, weights and blend in every round. Heavy
    concepts stand alone, as a concept isn't its own source."""
    flagged = members.join(F.broadcast(heavy.select("concept", F.col("concept").alias("own"))), "concept", "left")
    if targets is not None:
        relations = relations.join(targets.select(F.col("concept").alias("a")), "a", "left_semi")
        flagged = flagged.join(targets.select("concept", F.lit(True).alias("target")).distinct(), "concept", "left")
    keys = ["head", "own", *["target"] * (targets is not None)]
    for name, table in (("near", near.select("a", "b")), ("relations", relations.select("a", "b", "verb"))):
        sets = table.groupBy(F.col("a").alias("concept")).agg(*set_digest(*[F.col(c) for c in table.columns[1:]]))
        keys.append(name)
        flagged = flagged.join(sets.select("concept", F.struct("h0", "h1", "h2", "h3", "rows").alias(name)), "concept", "left")
    return with_head(flagged.withColumn("was", F.col("head")).select("concept", "n", "was", *keys), *keys).select("concept", "n", "head", "was")


def deepened(direct: DataFrame, judgments: DataFrame, cfg: Config = Config(), rank: int = RANK, targets: DataFrame | None = None, iterations: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """Sketches after the rounds of deepening. direct: sketches; judgments: subject, verb, object, weight; targets(concept) as
    in `deepen.deepen`. What is shuffled for a source is its factor, rank x d numbers.

    With members, direct are the heads' sketches, rounds are made for one concept of each class, and the result has all members.
    Of the candidates of one class the deepen_top_k first names are enough, as they weigh the same and ties go by name.

    Candidates are ranked, and weighted, by the least that their containment can be; the rounds are those of dense matrices
    with these weights, but for what truncation drops. Where gaps overlap, dense weights may rank others higher.
    """
    direct = stage(direct, "sketches")
    every = direct if members is None else members.join(direct.select(F.col("concept").alias("head"), "mass"), "head")
    heavy = stage(every.where(F.col("mass") >= cfg.deepen_min_mass).select("concept", "mass").orderBy(F.desc(F.round("mass", 9)), "concept").limit(cfg.deepen_max_candidates), "heavy")
    near = stage(deepen.candidates(every if targets is None else targets, deepen.links(judgments), heavy), "near")
    relations = stage(deepen.dominant_relation(judgments), "relations")
    if members is not None:
        members = stage(classes(members, near, relations, heavy, targets), "members")
        heads = members.where("concept = head")
        direct = stage(direct.join(heads.select("concept", F.col("was").alias("_was")), direct["concept"] == F.col("_was")).select(heads["concept"], direct["n"], "mass", "factor", "bound"), "sketches")
        first = F.row_number().over(W.partitionBy("a", "of").orderBy("b"))
        near = near.join(heads.select(F.col("concept").alias("a")), "a", "left_semi").join(members.select(F.col("concept").alias("b"), F.col("head").alias("of")), "b")
        near = stage(near.withColumn("_rn", first).where(F.col("_rn") <= cfg.deepen_top_k).select("a", "b", "of"), "near")
        relations = stage(relations.join(heads.select(F.col("concept").alias("a")), "a", "left_semi"), "relations")
    one, now = direct.select(F.size("factor").alias("cells")).first(), direct
    few = bool(one) and direct.count() * one.cells * 8 <= deepen.MOST_BROADCAST
    for _ in range(cfg.deepen_iterations if iterations is None else iterations):
        now = stage(blend(now, direct, sources(now, near, heavy, cfg, rank, targets, few), relations, cfg.deepen_alpha, rank, few), "sketches")
    return now if members is None else spread(now, members)


def dense(found: DataFrame, rank: int = RANK) -> DataFrame:
    """(concept, n, rho): the factors' matrices, row by row."""
    kind = dict(found.dtypes)["concept"]

    def run(frames):
        for pdf in frames:
            x = np.array(pdf["factor"].tolist(), float).reshape(len(pdf), rank, -1)
            yield pd.DataFrame({"concept": pdf["concept"], "n": pdf["n"], "rho": list(np.einsum("nki,nkj->nij", x, x).reshape(len(pdf), -1))})

    return found.select("concept", "n", "factor").mapInPandas(run, f"concept {kind}, n long, rho array<double>")
