"""Pronouns, comparisons and what panels show, against plain versions."""

import random

import pytest

from conceptfield.operators import discourse, maps

MENTION = "chat string, seq long, i int, agreement string, term string"


@pytest.mark.parametrize("reach", [0, 1, 4])
def test_anaphora(spark, reach):
    rnd = random.Random(reach)
    named = [(rnd.choice("ab"), rnd.randrange(40), rnd.randrange(9), rnd.choice("mf"), rnd.choice(["x", "y", "z"])) for _ in range(70)] + [("a", 5, 0, None, "x"), (None, 5, 0, "m", "x"), ("b", None, 0, "m", "x")]
    asked = [(rnd.choice("ab"), rnd.randrange(45), rnd.randrange(9), rnd.choice("mf")) for _ in range(60)] + [("a", 6, 1, None), (None, 5, 3, "m"), ("a", 7, 1, "m"), ("a", 7, 1, "m")]
    got = discourse.resolved(spark.createDataFrame(asked, "chat string, seq long, i int, agreement string"), spark.createDataFrame(named, MENTION), reach).collect()
    assert len(got) == len(asked)
    for r in got:
        terms = {t for c, s, i, g, t in named if None not in (c, s, g) and c == r.chat and g == r.agreement and (r.seq - reach <= s < r.seq or (s == r.seq and i < r.i))}
        assert (r.found, r.term) == (min(len(terms), 2), next(iter(terms)) if len(terms) == 1 else None)
    assert reach == 0 or {r.found for r in got} == {0, 1, 2}


def test_comparisons_and_ranking(spark):
    said = [("freedom", "safety", "important", ">"), ("safety", "comfort", "important", ">"), ("comfort", "freedom", "cheap", "<"), ("a", "b", "important", "<"), ("b", "a", "important", "<"), ("same", "same", "important", ">"), ("x", "y", "important", "=")]
    said += [("p", "q", "round", ">"), ("q", "r", "round", ">"), ("r", "p", "round", ">"), ("top", "p", "round", ">"), ("r", "low", "round", ">"), ("low", "lower", "round", ">"), ("r", "s", "round", ">"), ("s", "u", "round", ">"), ("u", "s", "round", ">"), ("u", "s", "round", "<"), ("u", "s", "round", ">"), ("u", "s", "round", ">"), (None, "u", "round", ">")]
    edges = discourse.comparisons(spark.createDataFrame(said, "a string, b string, dimension string, comparator string"))
    assert {(r.subject, r.object, r.direction) for r in edges.where("dimension = 'cheap'").collect()} == {("comfort", "freedom", "<"), ("freedom", "comfort", ">")}
    got = {(r.dimension, r.term): (r.level, r.cycle) for r in discourse.ranking(edges).collect()}
    assert got[("important", "freedom")] == (2, False) and got[("important", "safety")] == (1, False) and got[("important", "comfort")] == (0, False)
    assert ("important", "a") not in got and got[("cheap", "freedom")] == (1, False)
    assert {t for (d, t), (_, c) in got.items() if d == "round" and c} == {"p", "q", "r"}
    assert got[("round", "top")] == (None, False) and got[("round", "low")] == (1, False) and got[("round", "lower")] == (0, False)
    assert got[("round", "s")] == (0, False) and got[("round", "u")] == (1, False)
    none = spark.createDataFrame([], "a string, b string, dimension string, comparator string")
    assert discourse.ranking(discourse.comparisons(none)).count() == 0


def test_panel_judgments_with_nulls(spark):
    fields = "concept string, subject string, verb string, object string, quality string, seq long, source_text string, anomaly double, condition_id long, interpretation_layer int, status string"
    rows = [("a", "s", "v", "o", "NEGATIVE", 2, "t", 0.9, None, 1, "rejected"), ("a", "s", "v", "o", "NEGATIVE", 3, "u", 0.1, 4, 0, None), ("a", "s", "v", "o", None, 1, None, None, 7, None, "unreviewed"), ("b", None, "v", "o", "AFFIRMATIVE", 4, "t", 0.849, None, 0, "confirmed")]
    got = {r.seq: (r.kind, r.anomaly_percent, r.layer, r.confirmation) for r in maps.panel_judgments(spark.createDataFrame(rows, fields)).collect()}
    assert got == {2: ("anomaly", 90, 1, "rejected"), 1: ("conditional", None, None, None), 4: ("plain", None, None, "confirmed")}
    assert maps.panel_judgments(spark.createDataFrame([], fields)).count() == 0
