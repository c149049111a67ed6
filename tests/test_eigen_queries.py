"""Queries without SQL against plain numpy over the same tables."""

import numpy as np
import pandas as pd
import pytest

from conceptfield.operators import classify, deepen, language, maps, materialize
from conceptfield.operators import density as D
from conceptfield.plans import density, factors, judgments, registry
from conceptfield.sources import chat
from test_density import fold, table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rho():
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    return {c: (lambda x: x.T @ x)(np.stack(part["embedding"]).astype(float)) for c, part in e.groupby("label")}


def rows(spark, name):
    return registry.queries()[name](spark, DATA).toPandas()


def hyponymy(a, b):
    lam = np.linalg.eigvalsh(b - a)
    return 1 + lam[lam < 0].sum() / np.trace(a)


def entropy(m):
    lam = np.linalg.eigvalsh(m / np.trace(m))
    return -(lam[lam > 1e-12] * np.log(lam[lam > 1e-12])).sum()


def test_hyponymy_and_entropy(spark, rho):
    got = {(r.a, r.b): r.hyponymy for r in rows(spark, "hyponymy").itertuples()}
    assert got == pytest.approx({(a, b): hyponymy(rho[a], rho[b]) for a in rho for b in rho if a != b})
    want = {c: entropy(m) for c, m in rho.items()}
    assert {r.concept: r.entropy for r in rows(spark, "entropy").itertuples()} == pytest.approx(want)
    n = pd.read_parquet(f"{DATA}/embeddings.parquet").groupby("label").size()
    best = sorted((c for c in want if n[c] >= 3), key=lambda c: (-want[c], c))[:15]
    assert rows(spark, "polysemy_ranking")["concept"].tolist() == best


def test_contains(spark, rho):
    for name, score in (("contains", lambda c: hyponymy(rho[c], rho[3])), ("contained_in", lambda c: hyponymy(rho[3], rho[c]))):
        want = sorted(((c, score(c)) for c in rho if c != 3), key=lambda x: (-x[1], x[0]))[:5]
        got = rows(spark, name)
        assert got["concept"].tolist() == [c for c, _ in want] and got["score"].tolist() == pytest.approx([s for _, s in want])


def test_facets_report_and_basis(spark, rho):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    got = rows(spark, "facets")
    for c, m in rho.items():
        lam = np.sort(np.linalg.eigvalsh(m / np.trace(m)))[::-1]
        mine = got[got["concept"] == c].sort_values("rank")
        assert mine["weight"].tolist() == pytest.approx(lam[lam > density.CFG.facet_threshold].tolist())
        for r in mine.itertuples():
            assert np.allclose(m / np.trace(m) @ np.array(r.vector), r.weight * np.array(r.vector))
    report = rows(spark, "concept_report").set_index("concept")
    for c, m in rho.items():
        lam = np.linalg.eigvalsh(m / np.trace(m))
        want = [len(e[e["label"] == c]), np.trace(m), entropy(m), (m * m).sum() / np.trace(m) ** 2, (lam > 0.02).sum()]
        assert report.loc[c, ["n", "mass", "entropy", "purity", "facets"]].tolist() == pytest.approx(want)
    for r in rows(spark, "personal_basis").itertuples():
        x = np.stack(e[e["label"] == r.term]["embedding"]).astype(float)
        assert len(x) >= 40 and abs(np.linalg.svd(x - x.mean(0))[2][0] @ np.array(r.vector)) == pytest.approx(1)


def test_graph_and_asymmetry(spark, rho):
    n = pd.read_parquet(f"{DATA}/embeddings.parquet").groupby("label").size()
    ranked = sorted(rho, key=lambda c: (-n[c], c))
    view = [c for c in ranked if n[c] >= 3][:50]
    want = {(a, b): w for a in view for b in view if a != b and (w := round(hyponymy(rho[b], rho[a]), 3)) > density.CFG.edge_threshold}
    assert {(r.a, r.b): r.weight for r in rows(spark, "graph_view").itertuples()} == pytest.approx(want, abs=2e-3)
    some = ranked[:8]
    want = {(some[i], some[j]): (hyponymy(rho[some[i]], rho[some[j]]), hyponymy(rho[some[j]], rho[some[i]])) for i in range(8) for j in range(i + 1, min(8, i + 4))}
    want = {k: v for k, v in want.items() if abs(v[0] - v[1]) > 0.01}
    got = {(r.a, r.b): (r.ab, r.ba) for r in rows(spark, "asymmetry_pairs").itertuples()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_searches_and_factors(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    m = {c: (lambda x: x.T @ x)(np.stack(part["embedding"]).astype(float)) for c, part in e.groupby(e["label"] * 10 + e["vec_id"] % 10)}
    want = {(a, b): w for a in m for b in m if a != b and (w := round(hyponymy(m[b], m[a]), 3)) > factors.EDGE}
    got = {(r.a, r.b): r.weight for r in rows(spark, "hyponymy_edges").itertuples()}
    assert got == pytest.approx(want, abs=1.1e-3) and 0 < len(got) < len(m) ** 2 / 10
    want = sorted(((hyponymy(m[c], m[3]), c) for c in m if c != 3), key=lambda x: (-x[0], x[1]))[:5]
    got = rows(spark, "furthest_in_group")
    assert got["concept"].tolist() == [c for _, c in want] and got["score"].tolist() == pytest.approx([s for s, _ in want])
    dense, thin = (rows(spark, n).set_index("concept").sort_index() for n in ("deepen_k", "factor_deepen"))
    assert np.allclose(dense, thin, atol=1e-6)
    wide = rows(spark, "wide_deepen").set_index("concept")
    assert len(wide) == len(rows(spark, "wide_map")) and (wide["mass"] > 0).all()


def folded(parts, cfg):
    out = {}
    for key, part in parts.groupby(["space_id", "concept"]):
        part = part.sort_values(["seq", "judgment_id", "role"])
        state, found = fold([(np.asarray(v), w, t) for v, w, t in zip(part["vector"], part["weight"], part["ts"], strict=True)], cfg)
        for r, (k, odd) in zip(part.itertuples(), found, strict=True):
            out[(*key, r.judgment_id, r.role)] = (k, state[k][3], odd)
    return out


def test_consolidation_queries(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    parts = pd.DataFrame({"space_id": e["vec_id"] % 2, "concept": e["label"], "seq": e["vec_id"], "judgment_id": e["vec_id"], "role": "subject", "vector": [np.asarray(v, float) for v in e["embedding"]], "weight": 1.0, "ts": 0.0})
    want = folded(parts, density.CFG)
    got = {(r.space_id, r.concept, r.judgment_id, r.role): (r.component, r.activation, r.anomaly) for r in rows(spark, "consolidate_vectors").itertuples()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    want = folded(judgments.parts(spark, DATA).toPandas(), judgments.CFG)
    got = {(r.space_id, r.concept, r.judgment_id, r.role): (r.component, r.activation, r.anomaly) for r in rows(spark, "consolidate").itertuples()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-6) for k in want)
    odd = {}
    for (_, _, j, role), (_, _, x) in want.items():
        if role in ("subject", "object"):
            odd[j] = max(odd.get(j, 0.0), x)
    assert {r.judgment_id: r.anomaly for r in rows(spark, "anomaly_fold").itertuples()} == pytest.approx(odd, abs=1e-6)


def test_deepening_query(spark, rho):
    """All rounds, with relations that turn the sources' matrices."""
    from conceptfield.functions.vectors import role_table

    cfg, e = density.CFG, pd.read_parquet(f"{DATA}/embeddings.parquet")
    weight: dict = {}
    for v, label in zip(e["vec_id"], e["label"], strict=True):
        a, b, verb = str(label), str(v % 10), f"v{v % 5}"
        for x, y, w in ((a, b, 1.0), (b, a, 0.5)):
            weight[x, y, verb] = weight.get((x, y, verb), 0) + w
    best = {}
    for (x, y, verb), w in weight.items():
        best[x, y] = min(best.get((x, y), (0.0, "~")), (-round(w, 9), verb))
    direct = {str(c): m for c, m in rho.items()}
    now = dict(direct)
    for _ in range(cfg.deepen_iterations):
        after = {}
        for a in now:
            found = sorted(((-round((now[a] * now[b]).sum() / np.trace(now[a]), 12), b) for b in now if b != a))[: cfg.deepen_top_k]
            found = [(-w, b) for w, b in found if -w > cfg.deepen_containment]
            total = 0.0
            for w, b in found:
                order, sign = role_table("transform:" + best.get((a, b), (0, "_default"))[1], 64)
                total = total + w * now[b][np.ix_(order, order)] * np.outer(sign, sign)
            after[a] = direct[a] if not found else cfg.deepen_alpha * direct[a] + (1 - cfg.deepen_alpha) * total / sum(w for w, _ in found)
        now = after
    got = rows(spark, "deepen_k").set_index("concept")
    for c, m in now.items():
        assert got.loc[c, "mass"] == pytest.approx(np.trace(m), abs=1e-5) and got.loc[c, "purity"] == pytest.approx((m * m).sum() / np.trace(m) ** 2, abs=1e-7)


def test_deepening_stops(spark):
    df, _ = table(spark)
    rhos = D.matrices(df)
    links = spark.createDataFrame([("c0", "v", "c1", 1.0)], "subject string, verb string, object string, weight double")
    watched = spark.createDataFrame([("c0", "c1"), ("c0", "none")], "a string, b string")
    from conceptfield.functions.config import Config

    _, report = deepen.deepen_until(rhos, links, watched, Config(deepen_alpha=1.0), most=3)
    assert len(report) == 1 and report[0]["containment_delta"] == pytest.approx(0.0)
    _, report = deepen.deepen_until(rhos, links, watched, Config(), most=2)
    assert len(report) == 2 and report[1]["eigenvalue_delta"] < report[0]["eigenvalue_delta"] and report[0]["containment_delta"] > 0


def test_report_containers(spark):
    df, rows_ = table(spark, concepts=9, n=90)
    verbs = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "concept string")
    got = maps.containers(D.matrices(df), "c0", verbs).toPandas()
    for name, part in got.groupby("direction"):
        assert part["is_verb"].sum() == 3 and (~part["is_verb"]).sum() == 4
        assert set(part[part["is_verb"]]["concept"]) <= {"c1", "c2", "c3", "c4"} and name in ("contains", "contained_in")


def test_matrices_of_few_vectors(spark):
    """Vectors that travel as they are and sums that travel as matrices give the same; nulls are a key of their own."""
    got = {}
    for parts in (1, 40):
        df, rows_ = table(spark, n=40, d=6, concepts=3)
        df = df.unionByName(spark.createDataFrame([(None, 99, [1.0] * 6, -2.0)], df.schema)).repartition(parts, "seq")
        got[parts] = {r.concept: np.array(r.rho) for r in D.matrices(df).collect()}
    assert set(got[1]) == {"c0", "c1", "c2", None} and all(np.allclose(got[1][c], got[40][c]) for c in got[1])
    assert np.allclose(got[1][None], -2.0)
    assert D.matrices(df.where("false")).collect() == []


def test_evaluation_files(spark, tmp_path):
    chosen = spark.createDataFrame([(1, "вера даёт покой", "a", "generic"), (2, "да", "b", "other")], "sent_id long, text string, label string, category string")
    found = spark.createDataFrame([(1, "вера", "давать", "покой", "AFFIRMATIVE")], "sent_id long, subject string, verb string, object string, quality string")
    chat.write_evaluation(chosen, found, str(tmp_path / "e"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "e/sentences")).collect()) == ["вера даёт покой", "да"]
    assert {r.sent_id: r.status for r in spark.read.json(str(tmp_path / "e/gold")).collect()} == {1: "AUTO", 2: "EMPTY"}


def test_odd_sentences(spark):
    """Null and empty token lists, null features and heads that are missing."""
    null = {k: None for k in ("text", "lemma", "pos", "dep", "aspect", "tense", "mood", "has_vector")}
    data = [(1, 0.0, "s", None, None), (2, 0.0, "s", "", []), (3, 0.0, None, "x", [{"i": 0, "head": 7} | null]), (4, 0.0, "s", "x", [{"i": 0, "head": 7} | null | {"pos": "NOUN"}])]
    df = spark.createDataFrame(data, language.SENTENCES)
    got = classify.annotate(df).collect()
    assert [(r.sent_id, r.ref_status, r.clause_type) for r in got] == [(4, "CONCEPTUAL", "UNKNOWN")]
    assert language.extract(df).count() == 0
    assert materialize.from_triples(spark.createDataFrame([], "subject string, verb string, object string, quality string, ts double, text string")).count() == 0
