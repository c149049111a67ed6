"""Senses on planted groups, product spaces against plain numpy."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conceptfield.operators import density as D
from conceptfield.operators import factors, senses, tensor
from conceptfield.plans import registry, spaces

DATA = "/root/testdata/sf0.001"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(seed=3, dim=24):
    """Concepts by the subspaces that their senses are spread over: (concept, planted sense, vector, w)."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0].T
    shapes = {"two": [(0, 1), (5, 1)], "equal lines": [(2, 1), (3, 1), (9, 1)], "wide": [(0, 3), (10, 2)], "one": [(4, 1)], "one wide": [(6, 4)], "hub": [(12, 2), (16, 1)]}
    out = []
    for c, groups in shapes.items():
        for s, (at, wide) in enumerate(groups):
            for _ in range(3000 if c == "hub" else 60 - 10 * s):
                v = rng.normal(size=wide) @ axes[at : at + wide]
                out.append((c, s, unit(unit(v) + 0.03 * rng.normal(size=dim)).tolist(), float(0.5 + rng.random())))
    return out


def test_planted_senses_are_found_and_single_ones_left_alone(spark):
    rows = planted()
    parts = spark.createDataFrame(rows, "concept string, planted int, vector array<double>, w double").repartition(6)
    got = {r.concept: r for r in senses.potential_homonyms(parts).collect()}
    assert {c: r.senses for c, r in got.items()} == {"two": 2, "equal lines": 3, "wide": 2, "one": 1, "one wide": 1, "hub": 2}
    assert {c for c, r in got.items() if r.potential_homonym} == {"two", "equal lines", "wide", "hub"}
    found = senses.members(parts)[0].where("sense IS NOT NULL").toPandas()
    for _, part in found.groupby("concept"):
        truth = part["planted"] if part["sense"].nunique() > 1 else part["planted"] * 0
        assert (pd.crosstab(truth, part["sense"]) > 0).sum().tolist() == [1] * part["sense"].nunique()
        masses = part.groupby("sense")["w"].sum()
        assert masses.is_monotonic_decreasing
    assert len(found) == len(rows)


def test_gap_in_the_spectrum_is_that_of_the_plain_graph(spark):
    rows = [r for r in planted(5) if r[0] in ("wide", "one wide", "two")]
    parts = spark.createDataFrame(rows, "concept string, planted int, vector array<double>, w double").repartition(3)
    got = {r.concept: (r.k, r.gap) for r in senses.members(parts, facet=0.0)[1].collect()}
    for c, (k, gap) in got.items():
        x, w = np.array([r[2] for r in rows if r[0] == c]), np.array([r[3] for r in rows if r[0] == c])
        links = (x @ x.T) ** 2 * np.sqrt(np.outer(w, w))
        degree = ((x @ x.T) ** 2) @ w
        lam = np.linalg.eigvalsh(links / np.sqrt(np.outer(degree, degree)))[::-1]
        assert k == senses.groups_in(lam, senses.APART)
        assert gap == pytest.approx(lam[k - 1] - lam[k], abs=1e-8)


def test_senses_of_odd_rows(spark):
    fields = "concept string, vector array<double>, w double, n int, `group` string, y string"
    assert senses.potential_homonyms(spark.createDataFrame([], fields)).count() == 0
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("x", a, 1.0), ("x", a, 1.0), ("x", b, 1.0), ("x", b, 1.0), (None, a, 1.0), ("x", None, 1.0), ("x", a, None), ("zero", [0.0] * 3, 1.0), ("same", a, 1.0), ("same", a, 1.0)]
    df = spark.createDataFrame([(*r, 7, "g", "y") for r in rows], fields)
    got = {r.concept: (r.n, r.senses, r.potential_homonym) for r in senses.potential_homonyms(df).collect()}
    assert got == {"x": (4, 2, True), "same": (2, 1, False)}
    out = senses.members(df)[0]
    assert out.columns == [*df.columns, "sense"] and out.where("concept = 'zero' AND sense IS NULL AND n = 7").count() == 1


DIMS = (4, 3, 2)


def product_rows(seed=1):
    rng = np.random.default_rng(seed)
    return [(f"c{i % 3}", *[rng.normal(size=d).tolist() for d in DIMS], float(rng.random())) for i in range(70)]


def whole(rows):
    out = {}
    for c, s, r, x, w in rows:
        v = np.kron(np.kron(s, r), x)
        out[c] = out.get(c, 0) + w * np.outer(v, v)
    return out


def traced_out(m, keep):
    m = m.reshape(*DIMS, *DIMS)
    up, low = list("abc"), list("xyz")
    for i in range(3):
        if i not in keep:
            low[i] = up[i]
    side = int(np.prod([DIMS[i] for i in keep]))
    return np.einsum(f"{''.join(up)}{''.join(low)}->{''.join(up[i] for i in keep)}{''.join(low[i] for i in keep)}", m).reshape(side, side)


@pytest.fixture(scope="module")
def products(spark):
    rows = product_rows()
    fields = "concept string, semantic array<double>, relational array<double>, contextual array<double>, w double"
    return spark.createDataFrame(rows, fields).repartition(3), whole(rows)


@pytest.mark.parametrize("keep", [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)])
def test_partial_traces_of_components_and_of_sketches(products, keep):
    parts, want = products
    for out in (tensor.partial_trace(parts, [tensor.SPACES[i] for i in keep]), tensor.traced(tensor.sketches(parts, 24), DIMS, keep, 24)):
        got = {r.concept: np.array(r.rho) for r in out.collect()}
        assert set(got) == set(want)
        for c, m in want.items():
            assert got[c] == pytest.approx(traced_out(m, keep).ravel(), abs=1e-9)


def test_conditional_matrix_and_dependence(products):
    parts, want = products
    d = np.array([0.6, -0.8])
    got = {r.concept: np.array(r.rho) for r in tensor.partial_trace(tensor.given(parts, "contextual", 3 * d), ["semantic"]).collect()}
    look = np.kron(np.eye(12), np.outer(d, d))
    for c, m in want.items():
        assert got[c] == pytest.approx(traced_out(look @ m @ look, (0,)).ravel(), abs=1e-9)

    def entropy(m):
        lam = np.linalg.eigvalsh(m / np.trace(m))
        return -(lam[lam > 1e-12] * np.log(lam[lam > 1e-12])).sum()

    for r in tensor.dependence(parts, "semantic", "contextual").collect():
        one, two, both = (entropy(traced_out(want[r.concept], k)) for k in ((0,), (2,), (0, 2)))
        assert (r.entropy_first, r.entropy_second, r.entropy_both, r.dependence) == pytest.approx((one, two, both, one + two - both))


def test_products_of_whole_matrices_are_enclosed(products):
    parts, want = products
    names = sorted(want)
    pairs = parts.sparkSession.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    for r in factors.inner(factors.joined(tensor.sketches(parts, 6), pairs), 6).collect():
        assert r.inner - 1e-9 <= np.trace(want[r.a] @ want[r.b]) <= r.inner_most + 1e-9


def test_odd_components(spark):
    fields = "concept string, semantic array<double>, relational array<double>, contextual array<double>, w double, vector string"
    rows = [("a", [1.0, 0.0], [2.0], [1.0, 1.0], 1.0, "x"), ("a", None, [2.0], [1.0, 1.0], 1.0, "x"), (None, [1.0, 0.0], [2.0], [1.0, 1.0], 1.0, "x"), ("a", [1.0, 0.0], [2.0], [1.0, 1.0], None, "x")]
    df = spark.createDataFrame(rows, fields)
    assert [(r.concept, r.n, r.rho) for r in tensor.partial_trace(df, ["semantic"]).collect()] == [("a", 1, [8.0, 0.0, 0.0, 0.0])]
    assert tensor.partial_trace(df.limit(0), ["semantic"]).count() == 0
    with pytest.raises(ValueError):
        tensor.reduced(df, ["place"])


def test_context_is_a_unit_vector(spark):
    df = spark.createDataFrame([("NEGATIVE", 0.4, 0.9), (None, 1.2, -0.1), ("AFFIRMATIVE", 0.0, 1.0)], "q string, m double, h double")
    got = [np.array(r.c) for r in df.select(tensor.context(F.col("q"), F.col("m"), F.col("h")).alias("c")).collect()]
    assert [np.linalg.norm(c) for c in got] == pytest.approx([1.0] * 3)
    assert got[0][:4].tolist() == [0.0] * 4 and got[1].tolist() == [0, 1, 0, 0, 0, 0, 0, 0]


def test_context_dependence_over_embeddings(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    got = {r.concept: r.dependence for r in registry.queries()["context_dependence"](spark, DATA).collect()}

    def entropy(x):
        lam = np.linalg.eigvalsh(x.T @ x / (x * x).sum())
        return -(lam[lam > 1e-12] * np.log(lam[lam > 1e-12])).sum()

    a, b, c = spaces.DIMS
    for label, part in e.groupby("label"):
        x = np.stack(part["embedding"]).astype(float)
        s, r, t = x[:, :a], x[:, a : a + b], x[:, a + b :]
        size = np.linalg.norm(s, axis=1)[:, None]
        both = (r[:, :, None] * t[:, None, :]).reshape(len(x), -1) * size
        want = entropy(r * size * np.linalg.norm(t, axis=1)[:, None]) + entropy(t * size * np.linalg.norm(r, axis=1)[:, None]) - entropy(both)
        assert got[label] == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize(("chunk", "summed", "dealt"), [(1000, 1000, 1000), (11, 1000, 1000), (11, 0, 1000), (11, 0, 7)])
def test_products_of_whole_matrices_by_each_route(products, monkeypatch, chunk, summed, dealt):
    parts, want = products
    for name, value in (("CHUNK", chunk), ("SUMMED", summed), ("DEALT", dealt), ("STEP", 5), ("ROWS", 3)):
        monkeypatch.setattr(tensor, name, value)
    got = {(r.a, r.b): r for r in tensor.products(parts.withColumn("all", F.lit(1)), "all").collect()}
    assert got.keys() == {(a, b) for a in want for b in want if a < b}
    for (a, b), r in got.items():
        assert (r.inner, r.mass_a, r.mass_b) == pytest.approx(((want[a] * want[b]).sum(), np.trace(want[a]), np.trace(want[b])))
    apart = tensor.products(parts.withColumn("of", F.when(F.col("concept") == "c2", 2).otherwise(1)), "of").collect()
    assert [(r.a, r.b) for r in apart] == [("c0", "c1")] and apart[0].inner == pytest.approx(got["c0", "c1"].inner)
    assert tensor.products(parts.where("w IS NULL").withColumn("all", F.lit(1)), "all").count() == 0


def test_similarity_of_parts_of_many_vectors_equals_the_sql(spark, tmp_path):
    """80 vectors in each part of a label: more than sketches of 64 rows hold."""
    x = unit(np.random.default_rng(2).normal(size=(800, 64))).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r for r in registry.queries()["tensor_similarity"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(a, b): (s, e) for a, b, s, e in con.execute(registry.oracle_sql()["tensor_similarity"]).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k].similarity - s) <= 1.5e-8 and got[k].enclosed == e for k, (s, e) in want.items())
