"""Kernels against plain numpy, and properties that hold whatever the vectors are."""

import numpy as np
import pytest

from conceptfield.functions import vectors
from conceptfield.functions.config import Config
from conceptfield.operators import deepen, maps, materialize
from conceptfield.operators import density as D


def table(spark, n=60, d=6, concepts=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        rows.append((f"c{i % concepts}", i, (v / np.linalg.norm(v)).tolist(), float(rng.uniform(0.1, 1))))
    return spark.createDataFrame(rows, "concept string, seq long, vector array<double>, w double"), rows


def dense(rows):
    out = {}
    for c, _, v, w in rows:
        out[c] = out.get(c, 0) + w * np.outer(v, v)
    return out


def test_matrices_and_eigen_operators(spark):
    df, rows = table(spark)
    want = dense(rows)
    rhos = D.matrices(df.repartition(5))
    for r in D.entropy(D.with_mass(rhos.withColumn("purity", D.inner(rhos.rho, rhos.rho)))).collect():
        m = want[r.concept]
        lam = np.linalg.eigvalsh(m / np.trace(m))
        assert r.mass == pytest.approx(np.trace(m))
        assert r.purity == pytest.approx((m * m).sum())
        assert r.entropy == pytest.approx(-(lam[lam > 1e-12] * np.log(lam[lam > 1e-12])).sum())
        assert 0 <= r.entropy <= np.log(6) + 1e-9
    for r in D.hyponymy(D.pairs(rhos).select("a", "b", "rho_a", "rho_b")).collect():
        low = np.linalg.eigvalsh(want[r.b] - want[r.a])
        assert r.hyponymy == pytest.approx(1 + low[low < 0].sum() / np.trace(want[r.a]))
        assert -1e-9 <= r.hyponymy <= 1 + 1e-9


def test_facets(spark):
    df, rows = table(spark)
    want = dense(rows)
    found = D.facets(D.matrices(df), 0.05).collect()
    for r in found:
        m = want[r.concept] / np.trace(want[r.concept])
        assert np.allclose(m @ np.array(r.vector), r.weight * np.array(r.vector))
    assert len(found) == sum((np.linalg.eigvalsh(m / np.trace(m)) > 0.05).sum() for m in want.values())


def test_personal_basis(spark):
    df, rows = table(spark)
    for r in D.personal_basis(df, 10).collect():
        x = np.array([v for c, _, v, _ in rows if c == r.term])
        pc = np.linalg.svd(x - x.mean(0))[2][0]
        assert abs(pc @ np.array(r.vector)) == pytest.approx(1)


def test_signed_permutations_keep_lengths(spark):
    order, sign = vectors.role_table("object", 50)
    assert sorted(order) == list(range(50)) and set(sign) == {1.0, -1.0}
    assert vectors.role_table("verb", 50)[0] != order


def fold(rows, cfg):
    state, out = [], []
    for v, w, ts in rows:
        odd = 0.0
        if len(state) >= cfg.anomaly_min_components:
            ws = np.array([s[1] * s[3] * (1 + max(0, cfg.as_of - s[2]) / cfg.decay_tau) ** -0.5 for s in state])
            ws = np.where(ws < 0.01 * ws.max(), 0, ws)
            rho = sum(w_ * np.outer(s[0], s[0]) for w_, s in zip(ws, state, strict=True))
            odd = float(np.clip(1 - v @ rho @ v / np.trace(rho), 0, 1))
        for k, s in enumerate(state):
            if s[0] @ v / (np.linalg.norm(s[0]) * np.linalg.norm(v)) > cfg.consolidation:
                s[2], s[3] = ts, s[3] + 1
                break
        else:
            k = len(state)
            state.append([v, w, ts, 1])
        out.append((k, odd))
    return state, out


def test_consolidation_fold(spark):
    rng, cfg = np.random.default_rng(5), Config(as_of=5e6, consolidation=0.6)
    rows = []
    for i in range(120):
        v = rng.normal(size=3)
        rows.append((0, f"c{i % 3}", i, i, "subject", (v / np.linalg.norm(v)).tolist(), float(rng.uniform(0.01, 1)), float(i * 1e4)))
    df = spark.createDataFrame(rows, "space_id int, concept string, seq long, judgment_id long, role string, vector array<double>, weight double, ts double")
    got = {r.seq: r for r in materialize.consolidate(df.repartition(7), cfg).collect()}
    for c in ("c0", "c1", "c2"):
        mine = [r for r in rows if r[1] == c]
        state, out = fold([(np.array(r[5]), r[6], r[7]) for r in mine], cfg)
        for r, (k, odd) in zip(mine, out, strict=True):
            assert got[r[2]].component == k and got[r[2]].anomaly == pytest.approx(odd)
            assert got[r[2]].activation == state[k][3] and got[r[2]].ts == state[k][2]
    again = materialize.consolidate(df.repartition(1), cfg).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_deepening(spark):
    df, _ = table(spark)
    rhos = D.matrices(df)
    links = spark.createDataFrame([("c0", "v", "c1", 1.0), ("c2", "v", "c3", 2.0)], "subject string, verb string, object string, weight double")
    same = deepen.deepen(rhos, links, Config(deepen_alpha=1.0))
    a, b = ({r.concept: r.rho for r in x.collect()} for x in (rhos, same))
    assert all(np.allclose(a[c], b[c]) for c in a)
    moved = deepen.deepen(rhos, links, Config(), iterations=2)
    delta = deepen.convergence(rhos, moved).first()
    assert delta.eigenvalue_delta > 0
    more = deepen.convergence(moved, deepen.deepen(rhos, links, Config(), iterations=3)).first()
    assert more.eigenvalue_delta < delta.eigenvalue_delta


def test_heavy_concepts_too_large_to_broadcast(spark):
    rhos = D.matrices(table(spark)[0])
    heavy = deepen.heaviest(rhos, 0.01, 2)
    got = [{(r.a, r.b): r.weight for r in deepen.scores_of_heavy(rhos, heavy, most).collect()} for most in (1 << 20, 0)]
    assert len(got[0]) == 6 and got[0] == pytest.approx(got[1])


def test_contains_is_ordered(spark):
    df, rows = table(spark)
    found = maps.contains(D.matrices(df), "c0", 3).collect()
    assert len(found) == 3 and [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert maps.contains(D.matrices(df), "nothing").collect() == []


@pytest.mark.parametrize("chunk", [20_000, 60, 7])
def test_hub_consolidation_in_chunks(spark, chunk):
    """A verb of very many equal vectors and a hub of many directions: chunks of any size give what the plain fold gives."""
    rng, cfg = np.random.default_rng(6), Config(as_of=5e6, consolidation=0.7)
    some = [(lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=3)) for _ in range(40)]
    rows = []
    for i in range(400):
        rows.append((0, "verb", i * 3, i, "verb", some[0], float(rng.uniform(0.01, 1)), float(rng.integers(0, 5_000_000))))
        rows.append((1, "hub", i * 3, i, "object", some[int(rng.integers(0, 1 + i // 10))], float(rng.uniform(0.01, 1)), float(rng.integers(0, 5_000_000))))
        rows.append((0, f"rare {i % 150}", i * 3, i, "subject", some[i % 40], 1.0, 0.0))
    df = spark.createDataFrame(rows, "space_id int, concept string, seq long, judgment_id long, role string, vector array<double>, weight double, ts double")
    got = {(r.space_id, r.concept, r.seq): r for r in materialize.consolidate(df.repartition(6), cfg, chunk).collect()}
    assert len(got) == len(rows)
    for key in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if (r[0], r[1]) == key]
        state, out = fold([(np.array(r[5]), r[6], r[7]) for r in mine], cfg)
        seen = set()
        for r, (k, odd) in zip(mine, out, strict=True):
            g = got[*key, r[2]]
            assert (g.component, g.merged, g.activation, g.ts) == (k, k in seen, state[k][3], state[k][2]) and g.anomaly == pytest.approx(odd)
            seen.add(k)
    assert len(materialize.directions(df.where("concept = 'verb'")).collect()) == 1


def test_fold_in_blocks(monkeypatch):
    """Blocks give what the plain fold gives, where many components pass the archive's bound in one block and times go back,
    and no row's anomaly walks over all components."""
    rng, cfg, n = np.random.default_rng(8), Config(as_of=5e6, consolidation=0.8), 900
    monkeypatch.setattr(materialize, "BLOCK", 32)
    monkeypatch.setattr(materialize, "TILE", 100)
    v = rng.normal(size=(n, 16))
    v[1::3] = v[rng.integers(0, n, n // 3)] + 0.2 * v[1::3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    weight, ts = 10.0 ** rng.uniform(-3, 0, n), rng.integers(0, 5_000_000, n).astype(float)
    weight[: n // 2] *= 0.001  # half of the components go out at once, in the middle
    walked, plain = [], materialize.Blocks.decayed
    monkeypatch.setattr(materialize.Blocks, "decayed", lambda self, *a: walked.append(len(a[0])) or plain(self, *a))
    state, found, merged, odd, at = materialize.Blocks(cfg), [], [], [], 0
    while at < n:
        rows = slice(at, at + int(rng.integers(1, 100)))
        k = state.place(v[rows], weight[rows])
        m, o = state.score(k, ts[rows], v[rows])
        found, merged, odd, at = found + k.tolist(), merged + m.tolist(), odd + o.tolist(), rows.stop
    want, out = fold(list(zip(v, weight, ts, strict=True)), cfg)
    assert found == [k for k, _ in out] and odd == pytest.approx([x for _, x in out]) and 300 < len(want) < n
    assert merged == [k in found[:i] for i, k in enumerate(found)]
    assert state.f[: state.n, 1].tolist() == [c[3] for c in want] and state.f[: state.n, 2].tolist() == [c[2] for c in want]
    assert sum(walked) < 5 * n


def test_map_maintenance_reads_only_what_changed(spark, tmp_path):
    """Equals a full rebuild, also where a folder loses its last concept; files of other folders are the same ones."""
    from conceptfield.operators import thesaurus

    rng, path = np.random.default_rng(9), str(tmp_path / "map")
    kind = "subject string, verb string, object string, w double"
    before = [(f"s{i % 20}", f"v{i % 3}", f"o{i % 7}", float(rng.random())) for i in range(60)]
    after = [r for r in before if r[0] != "s4"] + [("new", "v0", "o1", 0.5)]

    def parts(rows):
        return spark.createDataFrame([(t, [float(len(t)), float(ord(t[-1])), r[3]], r[3]) for r in rows for t in r[:3]], "concept string, vector array<double>, w double")

    thesaurus.store_map(D.matrices(parts(before)), path, 32)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "map").rglob("*.parquet")}
    terms = thesaurus.changed_terms(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind))
    assert {r.concept for r in terms.collect()} == {t for r in before if r[0] == "s4" for t in r[:3]} | {"new", "v0", "o1"}
    touched = thesaurus.maintain(spark, path, parts(after), terms, 32)
    got = {r.concept: (r.n, r.rho) for r in thesaurus.stored_map(spark, path).collect()}
    want = {r.concept: (r.n, r.rho) for r in D.matrices(parts(after)).collect()}
    assert got.keys() == want.keys() and all(got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1]) for c in want)
    same = [p for p in files if int(p.parent.name.split("=")[1]) not in touched]
    assert same and all(p.exists() and p.stat().st_mtime_ns == files[p] for p in same)
    assert thesaurus.maintain(spark, path, parts(after), terms.limit(0), 32) == []
