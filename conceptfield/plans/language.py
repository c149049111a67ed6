"""Classification and extraction queries: five of six events in a row are tokens of one sentence.

Event 6s + i is token i of sentence s, for i below 2 + s mod 5; its lemma, dependency and head follow from user_id and k.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import classify, language
from .registry import query, table

#: Heads of sentences and other tokens: lemma and part of speech.
ROOTS = tuple((w, "VERB") for w in ("требовать", "давать", "думать", "знать", "хотеть", "считать", "мочь", "должен", "сказать", "быть", "строить")) + (("долг", "NOUN"), ("свободный", "ADJ"), ("сомневаться", "VERB"), ("разумный", "NOUN"), ("очень", "ADV"))
WORDS = (
    *((w, "NOUN") for w in ("свобода", "человек", "вопрос", "вера", "мир", "проблема", "воля", "страх", "разумный", "дом", "правило")), *((w, "PRON") for w in ("я", "ты", "вы", "он", "никто")), ("Москва", "PROPN"),
    *((w, "ADJ") for w in ("важный", "свободный", "весь")), *((w, "DET") for w in ("этот", "каждый", "некоторый")), *((w, "VERB") for w in ("давать", "прийти", "являться", "хотеть", "любить", "знать", "мочь")),
    *((w, "PART") for w in ("не", "ни")), *((w, "ADV") for w in ("обычно", "вчера", "очень", "как", "только")), ("если", "SCONJ"), ("когда", "SCONJ"), ("быть", "AUX"), ("два", "NUM"), ("что", "ADV"), ("не", "PART"), ("очень", "ADV"),
)
DEPS = {
    "NOUN": ("nsubj", "obj", "obl", "conj", "nsubj:pass", "nsubj", "obj"), "PRON": ("nsubj", "nsubj", "obj", "nsubj"), "PROPN": ("obj", "appos", "nsubj"), "ADJ": ("amod", "amod", "acomp"), "DET": ("det", "det", "amod"),
    "VERB": ("ccomp", "advcl", "xcomp", "acl:relcl", "conj", "dep"), "PART": ("advmod",), "ADV": ("advmod", "advmod", "dep"), "SCONJ": ("mark",), "AUX": ("cop", "ccomp"), "NUM": ("nummod",),
}


def literal(x) -> str:
    return "[" + ", ".join(map(literal, x)) + "]" if isinstance(x, (tuple, list)) else f"'{x}'" if isinstance(x, str) else str(x)


TOKENS_SQL = f"""raw AS (SELECT event_id // 6 AS s, (event_id % 6)::INT AS i, user_id AS u, (props->>'k')::BIGINT AS k, value FROM events WHERE event_id % 6 < 2 + (event_id // 6) % 5),
    w AS (SELECT *, CASE WHEN i = 0 THEN {literal([w for w, _ in ROOTS])}[(u + k) % {len(ROOTS)} + 1] ELSE {literal([w for w, _ in WORDS])}[(u * 7 + k) % {len(WORDS)} + 1] END AS word,
        CASE WHEN i = 0 THEN {literal([p for _, p in ROOTS])}[(u + k) % {len(ROOTS)} + 1] ELSE {literal([p for _, p in WORDS])}[(u * 7 + k) % {len(WORDS)} + 1] END AS pos FROM raw),
    t AS (SELECT s, i, lower(word) AS lemma, pos, CASE WHEN i = 0 THEN 'ROOT' {" ".join(f"WHEN pos = '{p}' THEN {literal(d)}[(k // 3) % {len(d)} + 1]" for p, d in DEPS.items())} END AS dep, CASE WHEN i = 0 THEN 0 WHEN k % 4 < 2 THEN 0 ELSE u % i END AS head,
        CASE WHEN pos IN ('VERB', 'AUX') THEN ['Imp', 'Perf', ''][k % 3 + 1] END AS aspect, CASE WHEN pos IN ('VERB', 'AUX') THEN ['Pres', 'Past', 'Past', 'Fut'][u % 4 + 1] END AS tense,
        CASE WHEN pos IN ('VERB', 'AUX') THEN CASE WHEN k % 10 = 0 THEN 'Cnd' WHEN k % 10 = 1 THEN 'Imp' ELSE 'Ind' END END AS mood, value >= 5 AS known FROM w)"""


def sentences(spark, sf_dir):
    """sent_id, ts, text, tokens; ts is the sentence's number."""
    e = table(spark, sf_dir, "events")
    u, k, i = F.col("user_id"), F.get_json_object("props", "$.k").cast("long"), (F.col("event_id") % 6).cast("int")

    def cycle(values, at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))

    def of(n):
        return F.when(i == 0, cycle([r[n] for r in ROOTS], u + k)).otherwise(cycle([r[n] for r in WORDS], u * 7 + k))

    verb, dep = F.col("pos").isin("VERB", "AUX"), F.when(i == 0, "ROOT")
    for p, d in DEPS.items():
        dep = dep.when(F.col("pos") == p, cycle(d, F.floor(k / 3)))
    rows = e.withColumn("s", F.floor(F.col("event_id") / 6)).where(i < 2 + F.col("s") % 5).withColumn("lemma", of(0)).withColumn("pos", of(1))
    token = F.struct(
        i.alias("i"), F.col("lemma").alias("text"), "lemma", "pos", dep.alias("dep"), F.when((i == 0) | (k % 4 < 2), 0).otherwise(u % i).cast("int").alias("head"), F.when(verb, cycle(("Imp", "Perf", ""), k)).alias("aspect"),
        F.when(verb, cycle(("Pres", "Past", "Past", "Fut"), u)).alias("tense"), F.when(verb, F.when(k % 10 == 0, "Cnd").when(k % 10 == 1, "Imp").otherwise("Ind")).alias("mood"), (F.col("value") >= 5).alias("has_vector"))
    whole = rows.groupBy("s").agg(F.array_sort(F.collect_list(token)).alias("tokens"))  # six tokens at most
    return whole.select(F.col("s").alias("sent_id"), F.col("s").cast("double").alias("ts"), F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("text"), "tokens")


def has(deps=None, pos=None, lemmas=None) -> str:
    """SQL over children: whether one of them is such."""
    parts = [f"{c} IN ({', '.join(map(literal, v))})" for c, v in (("dep", deps), ("pos", pos), ("lemma", lemmas)) if v is not None]
    return "coalesce(bool_or(" + " AND ".join(parts) + "), false)"


def within(name: str, values) -> str:
    return f"{name} IN ({', '.join(map(literal, values))})"


def status_sql(of: str) -> str:
    other = "'GENERIC'" if of == "GENERIC" else "CASE WHEN hpos = 'VERB' AND (htense = 'Past' AND haspect = 'Perf' OR htemporal) THEN 'INTERLOCUTOR' ELSE 'GENERIC' END" if of == "HABITUAL" else "'INTERLOCUTOR'"
    event = f"hpos = 'VERB' AND {within('hlemma', L.SLP_VERBS)} AND haspect = 'Perf'" if of == "OTHER" else "false"
    return f"""CASE WHEN pos = 'PRON' THEN CASE WHEN {within('lemma', L.SELF_PRONOUNS)} THEN 'SELF' WHEN {within('lemma', L.INTERLOCUTORS)} THEN CASE WHEN hpos = 'VERB' AND hdep = 'advcl' AND hgmark THEN 'GENERIC'
        WHEN hpos = 'VERB' AND hmood = 'Imp' THEN 'INTERLOCUTOR' ELSE {other} END ELSE 'REFERENTIAL' END WHEN pos = 'PROPN' THEN 'REFERENTIAL' WHEN pos NOT IN ('NOUN', 'ADJ') OR {within('lemma', L.ABSTRACT_NOUNS)} THEN 'CONCEPTUAL'
        WHEN det THEN 'REFERENTIAL' WHEN {within('lemma', L.QUASI_GENERIC_NOUNS)} AND (fixed OR {event}) THEN 'REFERENTIAL' ELSE 'CONCEPTUAL' END"""


CLASSES_SQL = f"""{TOKENS_SQL}, txt AS (SELECT s, ' ' || string_agg(lemma, ' ' ORDER BY i) || ' ' AS text, count(*) AS n FROM t GROUP BY s),
    kid AS (SELECT s, head AS i, {has(('advmod',), lemmas=L.HABITUAL_MARKERS)} AS habitual, {has(('advmod', 'obl'), lemmas=L.TEMPORAL_MARKERS)} AS temporal, {has(pos=('ADJ',), lemmas=L.ILP_ADJECTIVES)} AS lasting, {has(('mark',), lemmas=L.GENERIC_MARKS)} AS gmark,
        {has(('mark',), lemmas=L.CONDITIONAL_MARKS)} AS cmark, {has(('det', 'amod'), lemmas=L.DETERMINERS)} AS det, {has(('nummod', 'acl:relcl', 'acl'))} OR {has(pos=('NUM',))} OR {has(('appos', 'flat:name', 'nmod'), ('PROPN',))} AS fixed,
        {has(('det',), lemmas=('этот', 'тот', 'наш', 'мой', 'свой'))} AS own, {has(('ccomp', 'xcomp'))} AS complement, {has(('nsubj',), ('NOUN', 'PROPN', 'PRON'))} AS named, {has(('nsubj:pass',), ('NOUN', 'PROPN', 'PRON'))} AS passive,
        string_agg(CASE WHEN {within('lemma', L.NEGATIVE_PRONOUNS)} THEN 'P' WHEN dep = 'advmod' AND {within('lemma', L.NEGATIVE_PARTICLES)} THEN 'N' ELSE '' END, '' ORDER BY i) AS ops,
        arg_max(map_extract({'MAP {' + ', '.join(f"'{a}': {b}::DOUBLE" for a, b in L.QUANTIFIERS.items()) + '}'}, lemma)[1], i) FILTER (WHERE dep IN ('det', 'amod') AND {within('lemma', L.QUANTIFIERS)}) AS q, arg_min(lemma, i) FILTER (WHERE dep = 'cop') AS cop
        FROM t WHERE i <> head GROUP BY s, head),
    b AS (SELECT t.*, txt.text, txt.n, coalesce(habitual, false) AS habitual, coalesce(temporal, false) AS temporal, coalesce(lasting, false) AS lasting, coalesce(gmark, false) AS gmark, coalesce(cmark, false) AS cmark, coalesce(det, false) AS det, coalesce(fixed, false) AS fixed,
        coalesce(own, false) AS own, coalesce(complement, false) AS complement, coalesce(named, false) AS named, coalesce(passive, false) AS passive, coalesce(ops, '') AS ops, q, cop FROM t JOIN txt USING (s) LEFT JOIN kid USING (s, i)),
    cl AS (SELECT *, CASE WHEN pos IN ('VERB', 'AUX') OR dep = 'ROOT' AND pos IN ('ADJ', 'NOUN') THEN CASE WHEN mood = 'Cnd' THEN 'GENERIC' WHEN habitual OR contains(text, ' как правило ') THEN 'HABITUAL' WHEN temporal OR contains(text, ' только что ') THEN 'EPISODIC'
        WHEN tense = 'Pres' AND aspect = 'Imp' THEN 'GENERIC' WHEN tense = 'Past' AND aspect = 'Perf' THEN 'EPISODIC' WHEN tense = 'Past' AND aspect = 'Imp' THEN 'HABITUAL' WHEN lemma IN ('быть', 'являться', 'стать') AND lasting THEN 'GENERIC'
        WHEN pos IN ('ADJ', 'NOUN') AND {within('lemma', L.ILP_ADJECTIVES)} THEN 'GENERIC' ELSE 'UNKNOWN' END END AS clause FROM b),
    h AS (SELECT x.*, coalesce(y.clause, z.clause, 'UNKNOWN') AS around, y.pos AS hpos, y.dep AS hdep, y.lemma AS hlemma, y.mood AS hmood, y.tense AS htense, y.aspect AS haspect, y.gmark AS hgmark, y.temporal AS htemporal FROM cl x JOIN cl y ON y.s = x.s AND y.i = x.head JOIN cl z ON z.s = y.s AND z.i = y.head),
    node AS (SELECT *, {", ".join(f"{status_sql(c)} AS st_{c.lower()}" for c in ("GENERIC", "HABITUAL", "OTHER"))}, {within('lemma', L.DISCOURSE_POINTERS)} AND (own OR contains(text, ' ' || lemma || ' в том') OR contains(text, ' ' || lemma || ' заключается') OR contains(text, ' ' || lemma || ' состоит')) AS points FROM h)"""


def pick_status(name: str, of: str) -> str:
    return f"CASE {of} WHEN 'GENERIC' THEN {name}.st_generic WHEN 'HABITUAL' THEN {name}.st_habitual ELSE {name}.st_other END"


@query(f"WITH {CLASSES_SQL} SELECT s AS sent_id, i, lemma, {pick_status('node', 'around')} AS ref_status, around AS clause_type FROM node WHERE pos IN ('NOUN', 'PROPN', 'PRON', 'ADJ')")
def phrase_status(spark, sf_dir):
    return classify.annotate(sentences(spark, sf_dir))


@query(f"WITH {CLASSES_SQL} SELECT s AS sent_id, i, clause, points FROM node WHERE clause IS NOT NULL OR points")
def clause_class(spark, sf_dir):
    rows = classify.classified(sentences(spark, sf_dir)).select("sent_id", F.inline("tokens"))
    return rows.where(F.col("clause").isNotNull() | F.col("points")).select("sent_id", "i", "clause", "points")


def flipped(negated: str) -> str:
    """Negation below a node: every negative pronoun sets it, every particle turns it, in order."""
    return f"(CASE WHEN contains(k.ops, 'P') THEN length(regexp_extract(k.ops, '[^P]*$')) % 2 = 0 ELSE ({negated}) <> (length(k.ops) % 2 = 1) END)"


def confidence(*of: str) -> str:
    return f"greatest(0.1, least(1.0, 1.0 - 0.15 * ({' + '.join(f'(NOT {x}.known)::INT' for x in of)}) - 0.25 * ({' + '.join(f'({x}.dep = $$dep$$)::INT' for x in of)}) - CASE WHEN {of[0]}.n < 3 THEN 0.2 WHEN {of[0]}.n < 5 THEN 0.1 ELSE 0 END - CASE WHEN {of[0]}.depth > 4 THEN 0.1 ELSE 0 END))"


def table_sql(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in values.items()) + "}"


EXTRACT_SQL = f"""WITH RECURSIVE {CLASSES_SQL}, deep AS (SELECT s, i, 0 AS depth FROM t WHERE i = head UNION ALL SELECT k.s, k.i, depth + 1 FROM deep p JOIN t k ON k.s = p.s AND k.head = p.i AND k.i <> p.i),
    env AS (SELECT unnest({literal(list(L.ENVELOPES))}) AS lemma, unnest({literal([float(e[1]) for e in L.ENVELOPES.values()])}::DOUBLE[]) AS weight, unnest([{', '.join(str(e[2]).lower() for e in L.ENVELOPES.values())}]) AS raising),
    full_ AS (SELECT node.*, deep.depth, env.weight, env.raising, dep = 'advcl' AND cmark AS conditional, least(1.0, CASE WHEN pos = 'VERB' AND node.lemma IN ('мочь', 'суметь') THEN 0.5 ELSE 1 END, CASE WHEN pos = 'VERB' AND node.lemma IN ('должен', 'обязан', 'следовать') THEN 0.7 ELSE 1 END,
        CASE WHEN dep = 'advcl' AND cmark OR mood = 'Cnd' THEN 0.4 ELSE 1 END, CASE WHEN mood = 'Imp' THEN 0.7 ELSE 1 END)::DOUBLE AS lim FROM node JOIN deep USING (s, i) LEFT JOIN env ON env.lemma = node.lemma),
    n0 AS (SELECT x.*, CASE WHEN pos IN ('VERB', 'AUX') AND weight IS NOT NULL AND complement THEN 'env' WHEN pos IN ('VERB', 'AUX') AND EXISTS (SELECT 1 FROM full_ c WHERE c.s = x.s AND c.head = x.i AND c.i <> x.i AND c.conditional) THEN 'cond' WHEN pos IN ('VERB', 'AUX') THEN 'verb'
        WHEN dep = 'ROOT' AND pos IN ('NOUN', 'ADJ') AND named THEN CASE WHEN length(lemma) >= 2 THEN 'pred' ELSE 'stop' END ELSE 'all' END AS mode FROM full_ x),
    v AS (SELECT k.s, k.i, {flipped("false")} AS neg, k.lim AS modality, coalesce(k.q, 1.0)::DOUBLE AS quantity, NULL::BIGINT AS cond, NULL::VARCHAR AS role FROM n0 k WHERE k.i = k.head
        UNION ALL SELECT k.s, k.i, {flipped("CASE WHEN p.mode = 'env' THEN v.neg AND p.raising ELSE v.neg END")},
            least(CASE p.mode WHEN 'env' THEN v.modality * p.weight * CASE WHEN v.neg AND NOT p.raising THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END WHEN 'cond' THEN least(v.modality, 0.4::DOUBLE) ELSE v.modality END, k.lim), coalesce(k.q, v.quantity),
            CASE WHEN p.mode = 'cond' THEN p.s * 1000 + p.i ELSE v.cond END, CASE WHEN p.mode = 'cond' THEN 'ANTECEDENT' ELSE v.role END
        FROM v JOIN n0 p ON p.s = v.s AND p.i = v.i JOIN n0 k ON k.s = p.s AND k.head = p.i AND k.i <> p.i
        WHERE p.mode = 'all' OR p.mode = 'env' AND k.dep IN ('ccomp', 'xcomp') OR p.mode = 'cond' AND k.conditional OR p.mode IN ('verb', 'pred') AND {within('k.dep', language.CLAUSES)}),
    kids AS (SELECT s, head AS v, i, dep, pos FROM t WHERE i <> head), conj AS (SELECT s, v AS of, i FROM kids WHERE dep = 'conj'),
    sub0 AS (SELECT s, v, i FROM kids WHERE dep IN ('nsubj', 'nsubj:pass') AND pos IN ('NOUN', 'PROPN', 'PRON')), sub AS (FROM sub0 UNION ALL SELECT x.s, v, conj.i FROM sub0 x JOIN conj ON conj.s = x.s AND conj.of = x.i),
    obj0 AS (SELECT s, v, i FROM kids x WHERE dep IN ('obj', 'dobj', 'obl', 'iobj') AND pos IN ('NOUN', 'PROPN') UNION ALL SELECT s, v, i FROM kids x WHERE dep IN ('xcomp', 'ccomp', 'acomp') AND pos IN ('NOUN', 'ADJ', 'PROPN')
        AND NOT EXISTS (SELECT 1 FROM kids y WHERE y.s = x.s AND y.v = x.v AND y.dep IN ('obj', 'dobj', 'obl', 'iobj') AND y.pos IN ('NOUN', 'PROPN'))),
    obj AS (FROM obj0 UNION ALL SELECT x.s, v, conj.i FROM obj0 x JOIN conj ON conj.s = x.s AND conj.of = x.i), agent AS (SELECT s, v, i FROM kids WHERE dep = 'obl' AND pos IN ('NOUN', 'PROPN')),
    pair AS (SELECT p.s, p.i AS v, a.i AS a, o.i AS o FROM n0 p JOIN sub a ON a.s = p.s AND a.v = p.i JOIN obj o ON o.s = p.s AND o.v = p.i WHERE NOT p.passive
        UNION ALL SELECT p.s, p.i, a.i, o.i FROM n0 p JOIN agent a ON a.s = p.s AND a.v = p.i JOIN sub o ON o.s = p.s AND o.v = p.i WHERE p.passive
        UNION ALL SELECT p.s, p.i, a.i, o.i FROM n0 p JOIN obj a ON a.s = p.s AND a.v = p.i JOIN sub o ON o.s = p.s AND o.v = p.i WHERE p.passive AND NOT EXISTS (SELECT 1 FROM agent g WHERE g.s = p.s AND g.v = p.i)),
    said AS (SELECT v.*, p.mode, p.clause, p.lemma AS verb, {pick_status('a', 'p.clause')} AS sa, {pick_status('o', 'p.clause')} AS so, a.lemma AS al, o.lemma AS ol, a.points, {confidence('p', 'a', 'o')} AS conf FROM v JOIN n0 p ON p.s = v.s AND p.i = v.i AND p.mode IN ('verb', 'cond') JOIN pair ON pair.s = v.s AND pair.v = v.i
        JOIN n0 a ON a.s = v.s AND a.i = pair.a JOIN n0 o ON o.s = v.s AND o.i = pair.o),
    found AS (SELECT s, CASE WHEN sa = 'INTERLOCUTOR' THEN 'ты' ELSE al END AS subject, verb, ol AS object, neg, greatest(0.05, CASE WHEN mode = 'cond' THEN least(modality, 0.4) ELSE modality END * quantity) * 0.7 ** ((sa = 'GENERIC')::INT + (so = 'GENERIC')::INT) AS m,
        least(1.0, coalesce(map_extract({table_sql(L.VERB_INTENSITY)}, verb)[1], 0.5)) AS intensity, CASE WHEN mode = 'cond' THEN s * 1000 + i ELSE cond END AS cond, CASE WHEN mode = 'cond' THEN 'CONSEQUENT' ELSE role END AS role, conf, clause
        FROM said WHERE sa <> 'REFERENTIAL' AND (length(al) >= 2 OR al = 'я') AND NOT points AND so <> 'REFERENTIAL' AND length(ol) >= 2 AND al <> ol
    UNION ALL SELECT v.s, a.lemma, 'cop:' || coalesce(p.cop, 'это'), p.lemma, neg, greatest(0.05, modality * quantity) * CASE WHEN {pick_status('a', 'p.clause')} = 'GENERIC' THEN 0.7 ELSE 1 END, 0.7, cond, role, {confidence('p', 'a', 'p')}, p.clause
        FROM v JOIN n0 p ON p.s = v.s AND p.i = v.i AND p.mode = 'pred' JOIN (SELECT s, v, i FROM kids WHERE dep = 'nsubj' AND pos IN ('NOUN', 'PROPN', 'PRON') UNION ALL SELECT x.s, v, conj.i FROM kids x JOIN conj ON conj.s = x.s AND conj.of = x.i WHERE x.dep = 'nsubj' AND x.pos IN ('NOUN', 'PROPN', 'PRON')) z ON z.s = v.s AND z.v = v.i
        JOIN n0 a ON a.s = v.s AND a.i = z.i WHERE {pick_status('a', 'p.clause')} <> 'REFERENTIAL' AND (length(a.lemma) >= 2 OR a.lemma = 'я')
    UNION ALL SELECT v.s, p.lemma, 'amod', a.lemma, neg, greatest(0.05, modality * quantity), least(1.0, 0.5 * coalesce((SELECT product(coalesce(map_extract({table_sql(L.ADVERB_FACTORS)}, d.lemma)[1], 1.0)) FROM t d WHERE d.s = a.s AND d.head = a.i AND d.i <> d.head AND d.dep = 'advmod'), 1.0)), NULL, NULL, 1.0, 'GENERIC'
        FROM v JOIN n0 p ON p.s = v.s AND p.i = v.i AND p.pos = 'NOUN' AND length(p.lemma) >= 3 JOIN t a ON a.s = p.s AND a.head = p.i AND a.i <> a.head AND a.dep = 'amod' AND a.pos = 'ADJ' AND length(a.lemma) >= 2)
    SELECT s AS sent_id, subject, verb, object, CASE WHEN neg THEN 'NEGATIVE' ELSE 'AFFIRMATIVE' END AS quality, round(m + 1e-9, 6) AS modality, round(intensity + 1e-9, 6) AS intensity, coalesce(cond, -1) AS condition_id, coalesce(role, '') AS condition_role, round(conf + 1e-9, 6) AS extraction_confidence, clause AS clause_type FROM found"""


@query(EXTRACT_SQL)
def tree_extract(spark, sf_dir):
    numbers = {c: F.round(F.col(c) + 1e-9, 6) for c in ("modality", "intensity", "extraction_confidence")}
    none = {"condition_id": F.coalesce("condition_id", F.lit(-1)), "condition_role": F.coalesce("condition_role", F.lit(""))}
    return language.extract(sentences(spark, sf_dir)).drop("seq", "ts", "source_text").withColumns(numbers | none)
