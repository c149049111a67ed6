"""Sources, sinks, text normalisation and streams on small files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from conceptfield.functions import text as X
from conceptfield.functions.config import Config
from conceptfield.operators import feedback, materialize
from conceptfield.sources import chat, export, thesaurus
from conceptfield.streaming import consolidation


def test_chat_export(spark, tmp_path):
    m = [
        {"type": "message", "from": "A", "from_id": "1", "date": "2024-01-01T00:00:00", "text": "hello there"},
        {"type": "message", "from": "A", "from_id": "1", "date": "2024-01-01T00:00:30", "text": ["see ", {"type": "link", "text": "this"}, "now"]},
        {"type": "message", "from": "A", "from_id": "1", "date": "2024-01-01T00:00:50", "text": "[not a list"},
        {"type": "service", "from": "A", "from_id": "1", "date": "2024-01-01T00:00:55", "text": "joined"},
        {"type": "message", "from": "B", "from_id": "2", "date": "bad", "text": "no"},
        {"type": "message", "from": "B", "from_id": "2", "date": "2024-01-01T00:01:00", "text": ""},
    ]
    (tmp_path / "chat.json").write_text(json.dumps({"messages": m}))
    rows = chat.messages(spark, str(tmp_path / "chat.json")).orderBy("id").collect()
    assert [r.text for r in rows] == ["hello there", "see  this now", "[not a list", "no"] and rows[3].ts == 0.0
    got = chat.blocks(spark, str(tmp_path / "chat.json")).orderBy("ts").collect()
    assert [(r.sender, r.n) for r in got] == [("A", 2), ("A", 1)] and got[0].text == "hello there\nsee  this now"
    assert chat.blocks(spark, str(tmp_path / "chat.json"), most=1).count() == 1


@pytest.mark.parametrize(("indent", "size"), [(1, 700), (None, 333), (4, 64), (None, 1 << 20)])
def test_chat_export_in_ranges(spark, tmp_path, indent, size):
    rnd = random.Random(size)
    texts = ["короткий текст", 'said {"id": 7, "type": "message", "text": "no"} aloud', "x" * 2000, ["see ", {"type": "link", "text": "this"}], "[ {", "", "a\\\"b\nc"]
    m = [{"id": i, "type": rnd.choice(["message", "message", "service"]), "date": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", "from": "A Б"[i % 2 :], "from_id": "1", "text": rnd.choice(texts)} for i in range(150)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "chat.json").write_text(json.dumps({"name": "c", "messages": m}, ensure_ascii=False, indent=indent))
    (tmp_path / "one" / "empty.json").write_text(json.dumps({"messages": []}))
    other = [{"type": "message", "id": i, "from": "B", "date": "2024-01-01T00:00:00", "text": f"other order {i}"} for i in range(30)]
    (tmp_path / "one" / "other.json").write_text(json.dumps({"messages": other}))
    got = export.messages(spark, str(tmp_path / "one"), range_bytes=size)
    want = chat.messages(spark, str(tmp_path / "one"))
    for df in (got, want):
        assert df.where("chat like '%chat.json'").count() == sum(x["type"] == "message" and x["text"] != "" for x in m)
    rows = [sorted((r.chat.rsplit("/", 1)[1], r.sender, r.ts, r.text) for r in df.collect()) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert [r.text for r in got.where("chat like '%chat.json'").orderBy("id").collect()] == [r.text for r in want.where("chat like '%chat.json'").orderBy("id").collect()]
    assert size > 5000 or got.rdd.getNumPartitions() > 5


def test_conceptnet(spark, tmp_path):
    lines = [("/r/IsA", "/c/ru/кот_серый/n", "/c/ru/зверь", '{"weight": 2.5}'), ("/r/IsA", "/c/en/cat", "/c/ru/зверь", "{}"), ("/r/Nope", "/c/ru/кот", "/c/ru/зверь", "{}"), ("/r/PartOf", "/c/ru/лапа", "/c/ru/кот", "broken"), ("/r/PartOf", "/c/ru/кот", "/c/ru/кот", "{}")]
    with gzip.open(tmp_path / "dump.csv.gz", "wt") as f:
        f.writelines("\t".join(["/a", *x]) + "\n" for x in lines)
    got = thesaurus.conceptnet_dump(spark, str(tmp_path / "dump.csv.gz"))
    assert sorted(map(tuple, got.collect())) == [("IsA", "кот серый", "зверь", 2.5), ("PartOf", "лапа", "кот", 1.0)]
    assert {(r.rel, r.n) for r in thesaurus.write_cache(got, str(tmp_path / "cache")).collect()} == {("IsA", 1), ("PartOf", 1)}
    back = thesaurus.base_layer(thesaurus.conceptnet_cache(spark, str(tmp_path / "cache"), lines=True))
    assert thesaurus.conceptnet_cache(spark, str(tmp_path / "missing")).count() == 0
    assert {(r.verb, r.intensity) for r in back.collect()} == {("является", 1.0), ("входит_в", 0.35)}


def test_ruwordnet(spark, tmp_path):
    (tmp_path / "senses.N.xml").write_text('<senses><sense name="СЕРЫЙ КОТ" synset_id="1" synt_type="NG"/><sense name="КОТ" synset_id="1" synt_type="N"/><sense name="ЗВЕРЬ" synset_id="2" synt_type="N"/></senses>')
    (tmp_path / "rel.N.xml").write_text('<relations><relation parent_id="1" child_id="2" name="hypernym"/><relation parent_id="1" child_id="1" name="hypernym"/></relations>')
    got = thesaurus.ruwordnet(spark, [str(tmp_path / "senses.N.xml")], [str(tmp_path / "rel.N.xml")])
    assert [tuple(r) for r in got.collect()] == [("hypernym", "кот", "зверь")]


def test_session_and_triples(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, "user", "hi", None)], chat.SESSION)
    chat.append_session(rows, str(tmp_path / "log"))
    chat.append_session(rows, str(tmp_path / "log"))
    assert chat.session(spark, str(tmp_path / "log")).count() == 2
    reply = spark.createDataFrame([('```json\n[{"subject": "a", "verb": "b", "object": "c"}, {"subject": "x"}]\n```',), ("none",)], "reply string")
    assert [(r.subject, r.object) for r in chat.triples(reply).collect()] == [("a", "c")]


def test_normaliser(spark):
    cases = {"спс, оч круутаааа!": "спасибо, очень круута!", "(чел)  говрю": "(человек) говорю", "2000 ....": "20 .", "см. https://x.yy/aaaa ок": "см. https://x.yy/aaaa ок", "  ": "  ", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in rows.select("t", X.normalise(F.col("t")).alias("n")).collect()} == cases
    out = spark.range(1).select(X.remerge(F.array(F.lit("что так"), F.lit("я думаю"), F.lit("Что мир прост"), F.lit("да"))).alias("s")).first().s
    assert out == ["что так", "я думаю Что мир прост", "да"]


def test_answers(spark):
    parts = spark.createDataFrame([(1, "subject", "unreviewed", True, 1, 0.0, 2, True), (1, "verb", "unreviewed", True, 1, 0.0, 2, True), (2, "object", "unreviewed", False, 1, 0.0, 1, True)], "judgment_id long, role string, status string, archived boolean, activation long, ts double, interpretation_layer int, defeasible boolean")
    answers = spark.createDataFrame([("archive", 0, [1], 9.0), ("contradiction", 7, [1, 2], 9.0), ("defeasible", 0, [2], 8.0)], "question_type string, answer_index int, judgments array<long>, ts double")
    got = {(r.judgment_id, r.role): r for r in feedback.apply(parts, feedback.transitions(answers)).collect()}
    assert (got[1, "subject"].status, got[1, "subject"].archived, got[1, "subject"].activation, got[1, "subject"].ts) == ("confirmed", False, 2, 9.0)
    assert got[1, "verb"].status == "unreviewed" and got[1, "verb"].archived
    assert (got[2, "object"].status, got[2, "object"].interpretation_layer, got[2, "object"].activation, got[2, "object"].defeasible) == ("confirmed", 0, 2, False)


def test_milestones(spark, monkeypatch):
    from conceptfield.plans import judgments

    counts = {"a": 2042, "b": 42, "c": 41, "d": 92, "e": 2043, "f": 8}
    rows = spark.createDataFrame([(k, False) for k, n in counts.items() for _ in range(n)] + [("f", True)] * 34, "object string, archived boolean")
    monkeypatch.setattr(judgments, "judgments", lambda spark, sf_dir: rows)
    assert sorted(r.concept for r in judgments.milestone(spark, "").collect()) == ["a", "b", "d"]


def test_streams(spark, tmp_path):
    import numpy as np

    consolidation.with_state_store(spark)
    rng = np.random.default_rng(2)
    rows = [("0", f"c{i % 2}", i, i, "subject", (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=2)), 1.0, float(i)) for i in range(40)]
    schema = "space_id string, concept string, seq long, judgment_id long, role string, vector array<double>, weight double, ts double"
    df = spark.createDataFrame(rows, schema)
    df.where("seq < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("seq >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = consolidation.consolidate_stream(stream, Config(consolidation=0.9)).writeStream.format("memory").queryName("folded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r.judgment_id: r.component for r in spark.sql("select * from folded").collect()}
    want = {r.judgment_id: r.component for r in materialize.consolidate(df, Config(consolidation=0.9)).collect()}
    assert len(got) == 40
    files = sorted(p.name for p in (tmp_path / "in").iterdir() if p.name.endswith("parquet"))
    assert len(files) == 2
    if all(got[i] == want[i] for i in range(20)):  # files were read in order of arrival
        assert got == want

    talk = spark.createDataFrame([("c", i, "a" if i < 3 else "b", float(1 + i), f"message {i}") for i in range(5)], "chat string, id long, sender string, ts double, text string")
    talk.coalesce(1).write.parquet(str(tmp_path / "talk"))
    q = consolidation.burst_stream(spark.readStream.schema(talk.schema).parquet(str(tmp_path / "talk"))).writeStream.format("memory").queryName("bursts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert [(r.sender, r.n) for r in spark.sql("select * from bursts").collect()] == [("a", 3)]


def test_model_segments_and_history(spark):
    from conceptfield.operators import texts

    docs = spark.createDataFrame([(1, "я думаю|что мир прост| да|ещё одно"), (2, "a|b"), (3, None)], "id long, text string")
    got = sorted((r.id, r.pos, r.segment) for r in texts.model_segments(docs, lambda: lambda t: t.split("|")).where("id < 3").collect())
    assert got == [(1, 0, "я думаю что мир прост"), (1, 1, "ещё одно"), (2, 0, "a|b")]
    events = spark.createDataFrame([("anomaly", "a:b", 2.0, "yes", "?"), ("archive", "c:d", 1.0, "no", "?")], "event_type string, judgment_key string, ts double, user_response string, prompt string")
    assert [json.loads(r.value)["event_type"] for r in feedback.history(events).collect()] == ["archive", "anomaly"]


def test_qualifier_and_categories(spark):
    cases = {"свобода всегда требует большой ответственности": True, "коротко и ясно": False, "this is mostly english да так": False, "я думаю что это просто хуйня какая": False, "он говорит что мир прост и": False, "https://a.b/c": False}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id long, t string")
    assert {r.t: r.q for r in rows.select("t", X.qualifies(F.col("t"), F.col("id")).alias("q")).collect()} == cases
    one = rows.where("id = 0").select(X.categorise(F.col("t")).alias("c")).first().c
    assert "generic" in one and "negation" not in one


def test_sentences(spark):
    text = "7 first. 1 second 1\n\n 2 third! .\r\n\u00a0fourth.3 \u2003\nend.\x0bone"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.sentences(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [["7 first.", "1 second 1", "2 third!", ".", "fourth.3", "end.\x0bone"], [], None]
