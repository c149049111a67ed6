"""The pipeline's stages against what their operators decide."""

import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from conceptfield.llm import exact_dedup, mixing, simhash, toxicity

DATA = "/root/testdata/sf0.01"


def near_groups(texts):
    """doc_id -> smallest doc_id linked by a Jaccard similarity of five-word shingles of 0.8 or more, by plain sets."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in texts.items()}
    up, holders = {d: d for d in texts}, {}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d in sorted(sets):
        counts = Counter(e for s in sets[d] for e in holders.get(s, []))
        for e, n in counts.items():
            if n >= 0.8 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: root(d) for d in texts}


def awkward(spark):
    """Null and repeated ids, null and long texts, repeated rows, and columns whose names clash with ours and with the documents'."""
    from pyspark.sql import types as T

    names = ["text", "doc_id", "source", "DOC_ID", "lang", "n_chars", "_at", "_bit", "_id", "_bucket", "_sha", "_nth", "_copy", "key", "k", "c0", "nth"]
    fields = [T.StructField(n, T.LongType() if n in ("doc_id", "n_chars") else T.StringType()) for n in names]
    rnd = random.Random(7)
    words = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    base = [(w, i, "x") for i, w in enumerate(words[:5])] + [(words[5], None, "y"), (words[6], None, None), (words[6], None, None), (words[7], 1, "y"), (words[0], 1, "x"), (None, 9, "x"), ("", 10, "y"), ("z " * 60_000, 11, "y")]
    return spark.createDataFrame([(t, d, s, f"D{i}", *[f"{n}{i}" if n != "n_chars" else i for n in names[4:]]) for i, (t, d, s) in enumerate(base)], T.StructType(fields)), base


def test_awkward_tables(spark):
    docs, base = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    given = Counter(tuple(r) for r in docs.collect())
    for step in (lambda d: toxicity.keep_clean(d, labels), exact_dedup.keep_first, simhash.keep_first, mixing.mixed_documents):
        out = step(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= set(given) and len({r[3] for r in rows}) == len(set(rows))  # columns stay what they were
        assert step(docs.limit(0)).collect() == []
    assert Counter(tuple(r) for r in toxicity.keep_clean(docs, labels).collect()) == given
    texts = {t or "" for t, _, _ in base}
    for step in (exact_dedup.keep_first, simhash.keep_first):
        assert Counter(r[0] or "" for r in step(docs).collect()) == Counter(texts), step
    kept = {r[0]: r[1] for r in exact_dedup.keep_first(docs).collect()}
    assert kept[base[0][0]] == 0 and kept[base[6][0]] is None


def test_near_copies_in_groups(spark):
    """Groups of texts changed little by little, many of them less alike than the threshold: what plain sets link is found, at
    each level of similarity."""
    rnd, texts = random.Random(12), {}
    words = [f"w{i}" for i in range(3000)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([60, 120, 300, 800]))]
        for _ in range(rnd.randint(2, 7)):
            one = list(base)
            for at in rnd.sample(range(len(one)), max(1, int(len(one) * rnd.uniform(0.003, 0.03)))):
                one[at] = f"n{rnd.randrange(10**7)}"
            texts[len(texts)] = " ".join(one)
            base = one if rnd.random() < 0.4 else base
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    least = near_groups(texts)
    roots, _ = simhash.near_copies(rows)
    got = {r.node.doc_id: r.root.doc_id for r in roots.collect()}
    assert all(least[d] == least[r] for d, r in got.items())
    sets, found = {d: shingles(t) for d, t in texts.items()}, {}
    for a in texts:
        for b in range(a + 1, min(a + 7, len(texts))):
            alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if alike >= 0.8:
                found.setdefault(min(int(alike * 20), 19), []).append(got.get(a, a) == got.get(b, b))
    print({k / 20: (sum(v) / len(v), len(v)) for k, v in sorted(found.items())})
    assert all(sum(v) >= 0.95 * len(v) and len(v) > 10 for v in found.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "source_mixing", "best_fit_packing"]
    step = [f for _, f in corpus_pipeline.STAGES]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    one = step[0](spark, docs, DATA)
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert one.columns == columns and ids(one) == sorted(set(ids(docs)) - bad) and bad
    one = one.cache()
    two = step[1](spark, one, DATA)
    assert two.columns == columns and ids(two) == sorted(r.doc_id for r in exact_dedup.exact_dedup(one).where("kept").collect())
    two = two.cache()
    three = step[2](spark, two, DATA)
    texts = {r.doc_id: r.text for r in two.select("doc_id", "text").collect()}
    least = near_groups(texts)
    gone = set(texts) - set(ids(three))
    assert three.columns == columns and all(least[d] < d for d in gone)  # nothing clean goes
    near = {d for d in texts if least[d] != d}
    print("near copies", len(near), "found", len(gone))
    assert len(gone) >= 0.9 * len(near)
    three = three.cache()
    four = step[3](spark, three, DATA)
    taken = {r.doc_id: sum(2 * p >= r["size"] for p in r.passes) if r["size"] else 0 for r in mixing.mix(three)["documents"].collect()}
    assert four.columns == columns and Counter(ids(four)) == Counter({d: n for d, n in taken.items() if n})
    five = step[4](spark, four, DATA).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == Counter(ids(four))


@pytest.mark.parametrize("name", ["op2_pivot_dedup", "op5_phrase_dedup", "op6_exact_dedup", "op9_pfp_dedup"])
def test_matches_sql(spark, name):
    from conceptfield.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(want)


def test_registered(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in q if k.startswith("op") and k[2].isdigit()} and "pipeline" in q
    assert q["op6_exact_dedup"](spark, "/root/testdata/sf0.001").count() > 0
