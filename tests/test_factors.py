"""Low-rank factors and the search by bounds against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptfield.functions.config import Config
from conceptfield.operators import deepen, factors, materialize, pairsearch
from conceptfield.operators import density as D
from conceptfield.plans import factors as plan
from conceptfield.plans import registry

CFG = Config(dim=12, deepen_containment=0.05, deepen_top_k=4, deepen_max_candidates=3)


def components(spark, seed=1, concepts=9, dim=12, per=40):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(concepts):
        base = rng.normal(size=(3, dim))
        for _ in range(int(rng.integers(1, per))):
            v = rng.normal(size=3) @ base + 0.1 * rng.normal(size=dim)
            rows.append((f"c{c}", (v / np.linalg.norm(v)).tolist(), float(rng.random())))
    rows += [("hub", rows[int(i)][1], 1.0) for i in rng.integers(0, len(rows), 600)]
    return spark.createDataFrame(rows, "concept string, vector array<double>, w double").repartition(7), rows


def matrices(rows):
    out = {}
    for c, v, w in rows:
        out[c] = out.get(c, 0) + w * np.outer(v, v)
    return out


@pytest.mark.parametrize("rank", [2, 5, 12])
def test_sketches_and_products_enclose_dense_ones(spark, monkeypatch, rank):
    monkeypatch.setattr(factors, "FAN", 2)
    parts, rows = components(spark)
    want = matrices(rows)
    got = factors.sketches(parts, rank).collect()
    assert {r.concept for r in got} == set(want)
    for r in got:
        x = np.reshape(r.factor, (rank, -1))
        rest = np.linalg.eigvalsh(want[r.concept] - x.T @ x)
        assert r.n == sum(c == r.concept for c, _, _ in rows) and r.mass == pytest.approx(np.trace(want[r.concept]))
        assert rest.min() > -1e-8 and rest.max() <= r.bound + 1e-8
        if rank == 12:
            assert np.allclose(x.T @ x, want[r.concept])
    table = factors.sketches(parts, rank)
    names = [(a, b) for a in want for b in want if a != b]
    pairs = factors.inner(factors.joined(table, spark.createDataFrame(names, "a string, b string")), rank)
    found = pairs.withColumn("low", factors.contained()).withColumn("high", factors.contained("inner_most")).withColumn("alike", factors.alike()).collect()
    assert len(found) == len(names)
    for r in found:
        t = (want[r.a] * want[r.b]).sum()
        assert r.inner - 1e-8 <= t <= r.inner_most + 1e-8
        assert r.low - 1e-8 <= t / np.trace(want[r.a]) <= r.high + 1e-8
        if rank == 12:
            assert r.alike == pytest.approx(t / np.trace(want[r.a]) / np.trace(want[r.b]))


def judged(spark):
    rows = [(f"c{i}", f"v{i % 2}", f"c{(i * 5 + 1) % 9}", 1.0 + i) for i in range(9)] + [("hub", "v0", "c3", 2.0)]
    return spark.createDataFrame(rows, "subject string, verb string, object string, weight double")


def test_deepening_on_whole_factors_equals_dense(spark):
    parts, _ = components(spark)
    want = {r.concept: np.array(r.rho) for r in deepen.deepen(D.matrices(parts), judged(spark), CFG, iterations=2).collect()}
    got = {r.concept: np.array(r.rho) for r in factors.dense(factors.deepened(factors.sketches(parts, 12), judged(spark), CFG, 12, iterations=2), 12).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-8) for c in want)


def test_truncated_blend_is_within_its_bound(spark):
    """One round of truncated factors against the dense blend of the whole matrices with the same sources."""
    parts, rows = components(spark)
    want, rank = matrices(rows), 4
    direct = factors.sketches(parts, rank)
    heavy = direct.orderBy(F.desc("mass")).limit(2).select("concept")
    near = deepen.candidates(direct, deepen.links(judged(spark)), heavy)
    found = factors.sources(direct, near, heavy, CFG, rank)
    relations = deepen.dominant_relation(judged(spark))
    dense = D.matrices(parts).select(F.col("concept").alias("b"), F.col("rho").alias("rho_b"))
    blended = deepen.blend(D.matrices(parts), D.matrices(parts), found.select("a", "b", "weight").join(dense, "b"), relations, 0.7)
    whole = {r.concept: np.reshape(r.rho, (12, 12)) for r in blended.collect()}
    got = {r.concept: r for r in factors.blend(direct, direct, found, relations, 0.7, rank).collect()}
    assert found.count() > 5 and got.keys() == whole.keys()
    for c, r in got.items():
        x = np.reshape(r.factor, (rank, -1))
        rest = np.linalg.eigvalsh(whole[c] - x.T @ x)
        assert rest.min() > -1e-8 and rest.max() <= r.bound + 1e-8 and r.mass == pytest.approx(np.trace(whole[c]))
        assert all(abs(s.gap) >= 0 for s in found.collect())
    assert want.keys() == got.keys()


def table(spark, seed, n=90, dim=10):
    rng = np.random.default_rng(seed)
    centers, rows = rng.normal(size=(6, dim)), []
    for i in range(n):
        x = centers[i % 6] + 0.4 * rng.normal(size=(int(rng.integers(1, 12)), dim))
        x = x / np.linalg.norm(x, axis=1)[:, None]
        rows.append((f"k{i:03d}", len(x), (x.T @ x * rng.random()).ravel().tolist()))
    return spark.createDataFrame(rows, "concept string, n long, rho array<double>").repartition(5), {r[0]: np.reshape(r[2], (dim, dim)) for r in rows}


def hyponymy(a, b):
    lam = np.linalg.eigvalsh(b - a)
    return 1 + lam[lam < 0].sum() / np.trace(a)


@pytest.mark.parametrize(("seed", "size", "low"), [(1, 256, 0.5), (2, 8, 0.6), (3, 3, 0.35)])
def test_similar_pairs_are_those_of_all_pairs(spark, seed, size, low):
    df, m = table(spark, seed)
    names = sorted(m)
    every = {(a, b): (m[a] * m[b]).sum() / np.trace(m[a]) / np.trace(m[b]) for a in names for b in names if a < b}
    got = pairsearch.similar_pairs(df, low, 0.9, size=size).collect()
    want = {p: s for p, s in every.items() if low < s < 0.9}
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == pytest.approx(want)
    counts = pairsearch.candidates(df, "similarity", low, size=size)[1].first()
    assert counts.concepts == 90 and len(want) <= counts.candidates < len(every)
    if size == 3:
        assert counts.block_pairs < counts.blocks * (counts.blocks + 1) / 2


@pytest.mark.parametrize(("seed", "size"), [(4, 256), (5, 6)])
def test_edges_are_those_of_all_pairs(spark, seed, size):
    df, m = table(spark, seed)
    want = {(a, b): w for a in m for b in m if a != b and (w := round(hyponymy(m[b], m[a]), 3)) > 0.5}
    got = pairsearch.edges(df, 0.5, size=size).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.weight for r in got} == pytest.approx(want, abs=1.1e-3)
    assert pairsearch.candidates(df, "hyponymy", 0.5, size=size)[1].first().candidates < 90 * 89


@pytest.mark.parametrize("contains", [True, False])
def test_furthest_are_those_of_all_scores(spark, contains):
    df, m = table(spark, 6)
    want = sorted(((hyponymy(m[c], m["k007"]) if contains else hyponymy(m["k007"], m[c]), c) for c in m if c != "k007"), key=lambda x: (-x[0], x[1]))[:7]
    got = pairsearch.furthest_in(df, "k007", 7, contains, tries=1).collect()
    assert [r.concept for r in got] == [c for _, c in want] and [r.score for r in got] == pytest.approx([s for s, _ in want])


def test_search_in_odd_tables(spark):
    kind = "concept string, n long, rho array<double>"
    none = spark.createDataFrame([], kind)
    assert pairsearch.similar_pairs(none, 0.1).count() == 0 and pairsearch.edges(none, 0.1).count() == 0
    two = spark.createDataFrame([("a", 1, [1.0, 0.0, 0.0, 0.0]), ("b", 1, [1.0, 0.0, 0.0, 0.0]), ("c", 1, [0.0, 0.0, 0.0, 1.0])], kind)
    assert [(r.a, r.b) for r in pairsearch.similar_pairs(two, 0.5).collect()] == [("a", "b")]
    assert pairsearch.furthest_in(two, "missing").count() == 0


def test_fewer_pairs_than_all_meet_however_many_vectors_a_group_has(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    turned = F.concat(F.slice("embedding", F.col("i") * 3 + 1, 64), F.slice("embedding", F.lit(1), F.col("i") * 3))
    e.crossJoin(spark.range(20).select(F.col("id").cast("int").alias("i"))).select((F.col("vec_id") * 20 + F.col("i")).alias("vec_id"), turned.alias("embedding"), "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = registry.queries()["pair_search_counts"](spark, str(tmp_path)).first()
    assert row.concepts == 100 and row.fewer


def test_sketches_of_many_small_concepts_come_in_bounded_pieces(spark, monkeypatch):
    """Concepts of one vector take one row until the last level, and a task gives them some at a time."""
    monkeypatch.setattr(factors, "CELLS", 40)
    assert factors.kept(np.array([[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]])).tolist() == [[1.0, 2.0]]
    assert factors.kept(np.zeros((3, 2))).shape == (1, 2)
    rows = [(f"p{i}", [1.0, float(i)], 1.0) for i in range(300)] + [("zero", [0.0, 0.0], 1.0)]
    got = {r.concept: r for r in factors.sketches(spark.createDataFrame(rows, "concept string, vector array<double>, w double"), 3).collect()}
    assert len(got) == 301 and all(r.n == 1 and len(r.factor) == 6 for r in got.values())
    assert got["p7"].mass == pytest.approx(50.0) and np.reshape(got["p7"].factor, (3, 2)).tolist()[1:] == [[0.0, 0.0]] * 2


def test_products_are_made_where_they_are_summed():
    got = factors.product_rows([[[1.0, 2.0], [3.0, 4.0]], [[0.5, 1.0], [2.0, 0.0]]])
    assert got.tolist() == [[3.0, 4.0, 6.0, 8.0], [1.0, 0.0, 2.0, 0.0]]


def spoken(spark, n=40):
    """Judgments of many subjects that say the same, some twice, some negated, some of themselves or of one another."""
    kind = "judgment_id long, subject string, verb string, object string, quality string"
    rows = [(i, f"s{i:02d}", f"v{i % 2}", f"o{i % 3}", "NEGATIVE" if i % 5 == 4 else "AFFIRMATIVE") for i in range(n)]
    rows += [(100, "s00", "v0", "o0", "AFFIRMATIVE"), (101, "s06", "v0", "o0", "AFFIRMATIVE"), (102, "s12", "v1", "s13", "AFFIRMATIVE"), (103, "s18", "v0", "s18", "AFFIRMATIVE"), (104, "I", "v0", "o1", "AFFIRMATIVE")]
    fixed = {"seq": F.col("judgment_id"), "modality": F.lit(1.0), "intensity": F.lit(0.8), "ts": F.lit(0.0), "clause_type": F.lit("GENERIC"), "space_id": F.lit(0), "weight": F.lit(0.8)}
    return spark.createDataFrame(rows, kind).select("*", *[c.alias(k) for k, c in fixed.items()]).repartition(3)


@pytest.mark.parametrize("some", [False, True])
def test_concepts_of_equal_components_deepen_as_if_alone(spark, monkeypatch, some):
    monkeypatch.setattr(deepen, "MOST_BROADCAST", 0 if some else 1 << 26)
    judgments, cfg = spoken(spark), Config(dim=12, deepen_containment=0.05, deepen_top_k=4, deepen_max_candidates=5, deepen_iterations=3)
    direct = factors.sketches(materialize.components(judgments, cfg), 12, weight="weight")
    targets = direct.select("concept").where("concept NOT IN ('s01', 'o2', 's30')") if some else None
    want = {r.concept: r for r in factors.deepened(direct, judgments, cfg, 12, targets).collect()}
    members, heads = factors.of_judgments(judgments, cfg, 12)
    assert heads.count() < members.count() / 2
    for found, whole in ((factors.spread(heads, members), {r.concept: r for r in direct.collect()}), (factors.deepened(heads, judgments, cfg, 12, targets, members=members), want)):
        got = {r.concept: r for r in found.collect()}
        assert got.keys() == whole.keys() and found.count() == len(got)
        for c, r in got.items():
            x, y = (np.reshape(t.factor, (12, -1)) for t in (r, whole[c]))
            assert r.n == whole[c].n and r.mass == pytest.approx(whole[c].mass) and np.allclose(x.T @ x, y.T @ y, atol=1e-9)


def test_a_round_of_wide_deepen_holds_one_sketch_for_parts_that_are_alike(spark, tmp_path, monkeypatch):
    """600 parts of two brands and two types: the 200 heaviest concepts and a few classes are deepened."""
    parts = spark.range(600).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (F.col("id") % 2).cast("string")).alias("p_brand"), F.concat(F.lit("TYPE "), (F.floor(F.col("id") / 2) % 2).cast("string")).alias("p_type"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    held, stage = [], factors.stage

    def counted(df, name):
        out = stage(df, name)
        held.append(out.count() if name == "sketches" else 0)
        return out

    monkeypatch.setattr(factors, "stage", counted)
    assert registry.queries()["wide_deepen"](spark, str(tmp_path)).count() == 604
    assert 200 <= max(held) <= 210


def test_wide_deepen_gives_the_masses_of_whole_matrices(spark, tmp_path):
    """150 parts of two brands and two types, all of them among the heaviest: types have more vectors than a small sketch has rows."""
    parts = spark.range(150).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (F.col("id") % 2).cast("string")).alias("p_brand"), F.concat(F.lit("TYPE "), (F.floor(F.col("id") / 2) % 2).cast("string")).alias("p_type"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    known = plan.catalogue(spark, str(tmp_path)).withColumn("weight", F.lit(0.8))
    dense = deepen.deepen(D.matrices(materialize.components(known.drop("weight"), plan.WIDE), weight="weight"), known, plan.WIDE)
    want = {r.concept: r.mass for r in D.with_mass(dense).select("concept", "mass").collect()}
    got = {r.concept: r.mass for r in registry.queries()["wide_deepen"](spark, str(tmp_path)).collect()}
    assert len(want) == 154 and got == pytest.approx(want, abs=1e-5)
