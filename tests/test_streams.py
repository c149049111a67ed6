"""Streams with restarts against batch results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptfield.functions.config import Config
from conceptfield.operators import materialize, texts
from conceptfield.streaming import consolidation

PARTS = "space_id string, concept string, seq long, judgment_id long, role string, vector array<double>, weight double, ts double"
TALK = "chat string, id long, sender string, ts double, text string"


@pytest.fixture()
def states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    consolidation.with_state_store(spark)
    yield
    spark.conf.set(name, before)


def fed(spark, tmp_path, batches, schema, stream):
    """What a stream gives over batches, each the input of a query of its own that goes on where the last one stopped."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = stream(spark.readStream.schema(schema).parquet(source))
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    return spark.read.parquet(sink).collect()


def test_consolidation_goes_on_after_restarts(spark, tmp_path, states):
    rng, cfg = np.random.default_rng(3), Config(consolidation=0.8, as_of=1e5)
    rows = [("0", f"c{i % 3}", i, i, "subject", (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=3)), float(rng.random()), float(i)) for i in range(90)]
    got = fed(spark, tmp_path, [rows[:30], rows[30:31], rows[31:]], PARTS, lambda s: consolidation.consolidate_stream(s, cfg))
    want = {r.judgment_id: (r.component, r.merged, r.anomaly) for r in materialize.consolidate(spark.createDataFrame(rows, PARTS), cfg).collect()}
    assert len(got) == 90
    for r in got:
        assert (r.component, r.merged) == want[r.judgment_id][:2] and r.anomaly == pytest.approx(want[r.judgment_id][2])


def test_bursts_by_event_time(spark, tmp_path, states):
    """Rows out of order within the delay are as in order; rows older than the watermark are left out."""
    rnd, rows, at = random.Random(5), [], 1_000_000.0
    for i in range(120):
        at += rnd.choice([3.0, 10.0, 50.0, 200.0])
        rows.append((f"chat {i % 2}", i, rnd.choice("ab"), at, f"message {i} said"))
    batches = [rows[:40], rows[40:80], rows[80:]]
    late = [("chat 0", 900, "a", rows[5][3] + 1, "late message"), ("chat 1", 901, "b", 0.0, "message of unknown time")]
    shuffled = [rnd.sample(b, len(b)) for b in batches]
    shuffled[1] += late
    end = [(f"chat {c}", 999, "z", at + 5000 + c, "the last one of all") for c in (0, 1)]
    got = fed(spark, tmp_path, [*shuffled, end, [("chat 9", 1, "y", at + 20000, "another chat goes on")]], TALK, lambda s: consolidation.burst_event_stream(s, delay="1 second"))
    want = texts.burst_merge(spark.createDataFrame(rows + end, TALK)).where(F.col("sender") != "z").collect()
    have = sorted((r.chat, r.ts, r.sender, r.n, r.text) for r in got if r.sender not in "zy")
    assert have == sorted((r.chat, r.ts, r.sender, r.n, r.text) for r in want)
