"""Vector codes and the conversation trie against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptfield.llm import prefix_trie, vector_codes

TURNS = "conv_id long, turn long, role string, text string"


def slow_codes(rows, parts, entries, rounds, scale=256):
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: r[0])
    x = np.array([[int(np.floor(scale * v)) for v in r[1]] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].copy()

    def assign():
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1).sum(axis=1)

    for _ in range(rounds):
        codes, _error = assign()
        for p in range(parts):
            for k in range(len(books)):
                mine = x[codes[:, p] == k, p]
                if len(mine):
                    books[k, p] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    codes, error = assign()
    return books.transpose(1, 0, 2), {r[0]: ("".join(f"{c:02x}" for c in code), int(e), r[2]) for r, code, e in zip(kept, codes, error, strict=True)}


@pytest.mark.parametrize(("seed", "spread", "entries", "rounds"), [(1, 1.0, 16, 2), (2, 0.01, 32, 2), (3, 30.0, 7, 3)])
def test_vector_codes(spark, seed, spread, entries, rounds):
    """A small spread gives many equal integers: ties, equal entries and entries that nothing uses."""
    rng = np.random.default_rng(seed)
    rows = [(int(i) * 3 - 50, (rng.normal(size=8) * spread).tolist(), int(i) % 5 if i % 7 else None) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1], 9) for i in range(200)] + [(-99, None, 1), (-98, [1.0] * 7 + [float("nan")], 1), (-97, [None] * 8, 2), (-96, [float("-inf")] * 8, None)]
    books, want = slow_codes(rows, 4, entries, rounds)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", F.lit(1).alias("VEC_ID")).repartition(7)
    got = vector_codes.vector_codes(table, 4, entries, rounds)
    assert np.array_equal(got["codebooks"], books)
    assert {r.vec_id: (r.code, r.error, r.label) for r in got["codes"].collect()} == want


def test_vector_code_digest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=32)], None if i % 3 == 0 else 7) for i in range(200)]
    books, want = slow_codes(rows, 16, 64, 2)
    sums = defaultdict(int)
    for _, error, label in want.values():
        sums[label] += error
    got = vector_codes.code_digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 200
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    assert all((r.code, r.error, r.label_error, r.codebooks_sha256) == (*want[r.vec_id][:2], sums[want[r.vec_id][2]], digest) for r in got)


def test_exponion_equals_a_full_scan():
    rng = np.random.default_rng(5)
    for spread in (2, 50, 2000):
        books, x = rng.integers(-spread, spread, (3, 40, 4)), rng.integers(-spread, spread, (500, 12))
        books[:, 7] = books[:, 3]
        full = ((x.reshape(500, 3, 1, 4) - books[None]) ** 2).sum(axis=3)
        index, best = vector_codes.Exponion(books).nearest(x, rng.integers(0, 40, (500, 3)))
        assert np.array_equal(index, full.argmin(axis=2)) and np.array_equal(best, full.min(axis=2))


def test_awkward_vectors(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert vector_codes.code_digest(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0, 2.0], "a"), (None, [1.0, 2.0], "a"), (1, [1e300] * 16, None), (1, [-1e300] * 16, ""), (2, [], None), (3, [0.5] * 40, "b")]
    got = vector_codes.code_digest(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 6 and all(r.error == 0 and len(r.code) == 32 for r in got)


def slow_trie(rows, group=20, most=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    nodes, children = defaultdict(lambda: ([], [])), defaultdict(set)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        path = turns.get(c - c % group, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            node = tuple(path[:d])
            nodes[node][0].append(c)
            if d == len(path):
                nodes[node][1].append(c)
            if d:
                children[node[:-1]].add(node)
    out = []

    def sums(node):
        members, ends = nodes[node]
        leaves, saved = int(not children[node]), (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for child in children[node]:
            below = sums(child)
            leaves, saved = leaves + below[0], saved + below[1]
        digest = hashlib.sha256(",".join(str(c) for c in sorted(ends)).encode()).hexdigest()
        out.append((min(members), len(node), min(nodes[node[:-1]][0]) if node else None, len(members), len(children[node]), leaves, saved, digest))
        return leaves, saved

    if nodes:
        sums(())
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@pytest.mark.parametrize(("block", "most"), [(1024, 4), (3, 4), (2, 2), (1, 1)])
def test_conversation_trie(spark, monkeypatch, block, most):
    """Small blocks split every conversation; small chunks every list of ids."""
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rnd = random.Random(11)
    rows = []
    for c in range(130):
        for t in range(rnd.choice([0, 1, 2, 3, 3, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t > 1 else "user", rnd.choice(["a b", "c", "", " \t x"]) if t else "hello there you"))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]
    rows += [(900, None, None, "first"), (900, 2, "", None), (900, 2, "", None), (900, 1, "r", "x"), (None, 1, "user", "lost"), (901, 0, "u", "word " * 5000), (2, 7, "user", "é Δ")]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, TURNS).select("*", F.lit("x").alias("Conv_id"), F.lit(0).alias("depth")).repartition(6)
    assert trie_rows(prefix_trie.conversation_trie(table, 20, most, block)) == slow_trie(rows, 20, most)


def test_awkward_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    # 21 follows an absent conversation and has no more turns than it gives up; 7 turns equal in all columns are turns each
    lost = next(c for c in range(21, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lost, 0, "user", "only turn")] + [(0, 5, "user", "again and again")] * 7
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == slow_trie(rows)
    long = [(40, i, "user", f"turn {i % 3}") for i in range(2500)]
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(long, TURNS))) == slow_trie_chain(long)


def slow_trie_chain(rows):
    """A single conversation: a chain in which nothing is shared (the recursive version would be too deep)."""
    n, empty = len(rows), hashlib.sha256(b"").hexdigest()
    return sorted(((40, d, 40 if d else None, 1, int(d < n), 1, 0, hashlib.sha256(b"40").hexdigest() if d == n else empty) for d in range(n + 1)), key=str)
