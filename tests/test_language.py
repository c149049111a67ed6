"""Classification and extraction over hand-parsed sentences."""

from conceptfield.operators import classify
from conceptfield.operators import language as X


def sentence(sid, text, *tokens):
    """tokens: (lemma, pos, dep, head[, features]); heads count from 0; features: aspect, tense, mood."""
    out = []
    for i, (lemma, pos, dep, head, *more) in enumerate(tokens):
        f = more[0] if more else {}
        out.append({"i": i, "text": f.get("text", lemma), "lemma": lemma, "pos": pos, "dep": dep, "head": head, "aspect": f.get("aspect"), "tense": f.get("tense"), "mood": f.get("mood"), "has_vector": f.get("known", True)})
    return (sid, 0.0, "s", text, out)


IMP = {"aspect": "Imp", "tense": "Pres"}
PERF = {"aspect": "Perf", "tense": "Past"}
CASES = [
    sentence(1, "свобода требует ответственности", ("свобода", "NOUN", "nsubj", 1), ("требовать", "VERB", "ROOT", 1, IMP), ("ответственность", "NOUN", "obj", 1)),
    sentence(2, "ум и воля создают не страх", ("ум", "NOUN", "nsubj", 4), ("и", "CCONJ", "cc", 2), ("воля", "NOUN", "conj", 0), ("не", "PART", "advmod", 4), ("создавать", "VERB", "ROOT", 4, IMP), ("страх", "NOUN", "obj", 4)),
    sentence(3, "я не думаю что вера даёт покой", ("я", "PRON", "nsubj", 2), ("не", "PART", "advmod", 2), ("думать", "VERB", "ROOT", 2, IMP), ("что", "SCONJ", "mark", 5), ("вера", "NOUN", "nsubj", 5), ("давать", "VERB", "ccomp", 2, IMP), ("покой", "NOUN", "obj", 5)),
    sentence(4, "я не хочу чтобы ложь давала покой", ("я", "PRON", "nsubj", 2), ("не", "PART", "advmod", 2), ("хотеть", "VERB", "ROOT", 2, IMP), ("чтобы", "SCONJ", "mark", 5), ("ложь", "NOUN", "nsubj", 5), ("давать", "VERB", "ccomp", 2, IMP), ("покой", "NOUN", "obj", 5)),
    sentence(5, "если вера даёт покой воля строит мир", ("если", "SCONJ", "mark", 2), ("вера", "NOUN", "nsubj", 2), ("давать", "VERB", "advcl", 5, IMP), ("покой", "NOUN", "obj", 2), ("воля", "NOUN", "nsubj", 5), ("строить", "VERB", "ROOT", 5, IMP), ("мир", "NOUN", "obj", 5)),
    sentence(6, "свобода это очень важный долг", ("свобода", "NOUN", "nsubj", 4), ("это", "PART", "expl", 4), ("очень", "ADV", "advmod", 3), ("важный", "ADJ", "amod", 4), ("долг", "NOUN", "ROOT", 4)),
    sentence(7, "мир создан волей", ("мир", "NOUN", "nsubj:pass", 1), ("создавать", "VERB", "ROOT", 1, PERF), ("воля", "NOUN", "obl", 1)),
    sentence(8, "этот человек любит свободу", ("этот", "DET", "det", 1), ("человек", "NOUN", "nsubj", 2), ("любить", "VERB", "ROOT", 2, IMP), ("свобода", "NOUN", "obj", 2)),
    sentence(9, "ты строишь дом", ("ты", "PRON", "nsubj", 1), ("строить", "VERB", "ROOT", 1, IMP), ("дом", "NOUN", "obj", 1)),
    sentence(10, "ты вчера построил дом", ("ты", "PRON", "nsubj", 2), ("вчера", "ADV", "advmod", 2), ("построить", "VERB", "ROOT", 2, PERF), ("дом", "NOUN", "obj", 2)),
    sentence(11, "человек как правило строил дом", ("человек", "NOUN", "nsubj", 3), ("как", "ADV", "dep", 2), ("правило", "NOUN", "dep", 3), ("строить", "VERB", "ROOT", 3, PERF), ("дом", "NOUN", "obj", 3)),
    sentence(12, "проблема заключается в страхе", ("проблема", "NOUN", "nsubj", 1), ("заключаться", "VERB", "ROOT", 1, IMP), ("страх", "NOUN", "obl", 1)),
]


def extracted(spark):
    out = {}
    for r in X.extract(spark.createDataFrame(CASES, X.SENTENCES)).collect():
        out.setdefault(r.sent_id, []).append(r)
    return out


def triples(rows):
    return [(r.subject, r.verb, r.object, r.quality) for r in rows]


def test_extraction(spark):
    got = extracted(spark)
    assert triples(got[1]) == [("свобода", "требовать", "ответственность", "AFFIRMATIVE")]
    assert (got[1][0].modality, got[1][0].intensity, got[1][0].clause_type) == (1.0, 0.9, "GENERIC")
    assert abs(got[1][0].extraction_confidence - 0.9) < 1e-9  # three words
    assert triples(got[2]) == [("ум", "создавать", "страх", "NEGATIVE"), ("воля", "создавать", "страх", "NEGATIVE")]
    assert triples(got[3]) == [("вера", "давать", "покой", "NEGATIVE")] and got[3][0].modality == 0.5  # negation is raised
    assert triples(got[4]) == [("ложь", "давать", "покой", "AFFIRMATIVE")] and abs(got[4][0].modality - 0.18) < 1e-9
    assert [(r.subject, r.condition_role, r.modality) for r in got[5]] == [("вера", "ANTECEDENT", 0.4), ("воля", "CONSEQUENT", 0.4)]
    assert len({r.condition_id for r in got[5]}) == 1
    assert triples(got[6]) == [("свобода", "cop:это", "долг", "AFFIRMATIVE"), ("долг", "amod", "важный", "AFFIRMATIVE")]
    assert abs(got[6][1].intensity - 0.65) < 1e-9
    assert triples(got[7]) == [("воля", "создавать", "мир", "AFFIRMATIVE")]
    assert 8 not in got  # a determined person is no concept
    assert got[9][0].subject == "ты" and abs(got[9][0].modality - 0.7) < 1e-9  # anyone
    assert got[10][0].subject == "ты" and got[10][0].modality == 1.0 and got[10][0].clause_type == "EPISODIC"
    assert got[11][0].clause_type == "HABITUAL"
    assert 12 not in got  # points elsewhere


def test_annotation(spark):
    got = {(r.sent_id, r.i): r for r in classify.annotate(spark.createDataFrame(CASES, X.SENTENCES)).collect()}
    assert got[8, 1].ref_status == "REFERENTIAL" and got[1, 0].ref_status == "CONCEPTUAL"
    assert got[9, 0].ref_status == "GENERIC" and got[10, 0].ref_status == "INTERLOCUTOR"
    assert got[3, 0].ref_status == "SELF" and got[11, 0].clause_type == "HABITUAL"


def test_empty(spark):
    none = spark.createDataFrame([], X.SENTENCES)
    assert X.extract(none).count() == 0 and classify.annotate(none).count() == 0
