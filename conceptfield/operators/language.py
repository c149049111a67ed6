"""Judgment extraction over parsed sentences.

sentences: sent_id, text, ts, tokens array<struct<i, text, lemma, pos, dep, head, aspect, tense, mood, has_vector>>; the root's
head is itself. All is done by Columns in the row that holds the sentence, without a shuffle or a Python worker: clauses and
phrases are classified (classify), what each verb says is put together (`said`), then negation, modality and conditions are
handed down the tree, one depth after another (`scopes`). Tokens that no root reaches take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.vectors import let
from . import classify

TOKENS = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,aspect:string,tense:string,mood:string,has_vector:boolean>>"
SENTENCES = f"sent_id long, ts double, sender string, text string, tokens {TOKENS}"
JUDGMENTS = "sent_id long, seq int, subject string, verb string, object string, quality string, modality double, intensity double, ts double, source_text string, condition_id long, condition_role string, extraction_confidence double, clause_type string"

FLOOR = 0.05
NAMED = ("NOUN", "PROPN", "PRON")
ARGUMENTS = ("NOUN", "PROPN")
CLAUSES = ("ccomp", "xcomp", "advcl", "acl", "acl:relcl")
#: How a node hands its scope down: to the clauses it wraps, to its conditions, to clauses, to nothing, to all.
WRAPS, CONDITIONAL, VERBAL, NOMINAL, STOP, ALL = "wraps", "conditional", "verbal", "nominal", "stop", "all"


def holds(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def fixed_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def such(k: Column, deps=None, pos=None, lemmas=None) -> Column:
    out = F.lit(True)
    for name, allowed in (("dep", deps), ("pos", pos), ("lemma", lemmas)):
        if allowed is not None:
            out = out & k[name].isin(*allowed)
    return holds(out)


def below(tokens: Column, t: Column) -> Column:
    """The children of a token, in order."""
    return F.transform(t["below"], lambda p: F.get(tokens, p))


def with_conjuncts(tokens: Column, nodes: Column) -> Column:
    return F.flatten(F.transform(nodes, lambda x: F.concat(F.array(x), F.filter(below(tokens, x), lambda k: such(k, ("conj",))))))


def linked(rows: DataFrame) -> DataFrame:
    """Adds to each token below and above (places of its children and head; -1: none) and depth (null: no root above)."""
    tokens = F.col("tokens")

    def placed(ids: Column) -> Column:
        def node(t):
            kids = F.filter(F.transform(tokens, lambda k, p: F.when((k["head"] == t["i"]) & (k["i"] != t["i"]), p)), lambda p: p.isNotNull())
            return F.struct(*[t[c].alias(c) for c in ("i", "lemma", "pos", "dep", "mood", "has_vector", "clause", "generic", "habitual", "other", "points")], kids.alias("below"), (F.array_position(ids, t["head"]) - 1).cast("int").alias("above"), holds(t["head"] == t["i"]).alias("root"))

        return F.transform(tokens, node)

    rows = rows.withColumn("tokens", let(F.transform(tokens, lambda t: t["i"]), placed))
    depth = F.aggregate(tokens, F.transform(tokens, lambda t: F.when(t["root"], 0)), lambda acc, _: F.transform(tokens, lambda t, j: F.coalesce(F.get(acc, j), F.get(acc, t["above"]) + 1)))
    return rows.withColumn("tokens", F.zip_with(tokens, depth, lambda t, d: t.withField("depth", d)))


def ruled(rows: DataFrame) -> DataFrame:
    """Adds to each token what it does to a scope: negated (by a pronoun, whatever comes from above), turns (negation), quantity and
    limit (of modality), and conditional, whether it is a condition."""
    tokens = F.col("tokens")

    def rules(t, kids):
        def negation(s, k):
            turned = F.struct(s["negated"].alias("negated"), (~s["turns"]).alias("turns"))
            return F.when(such(k, lemmas=L.NEGATIVE_PRONOUNS), F.struct(F.lit(True).alias("negated"), F.lit(False).alias("turns"))).when(such(k, ("advmod",), lemmas=L.NEGATIVE_PARTICLES), turned).otherwise(s)

        none = F.struct(F.lit(False).alias("negated"), F.lit(False).alias("turns"))
        quantity = F.aggregate(kids, F.lit(None).cast("double"), lambda q, k: F.when(such(k, ("det", "amod")), F.coalesce(F.try_element_at(fixed_map(L.QUANTIFIERS), k["lemma"]), q)).otherwise(q))
        conditional = such(t, ("advcl",)) & F.exists(kids, lambda k: such(k, ("mark",), lemmas=L.CONDITIONAL_MARKS))
        limits = (F.when(such(t, pos=("VERB",), lemmas=("мочь", "суметь")), 0.5), F.when(such(t, pos=("VERB",), lemmas=("должен", "обязан", "следовать")), 0.7), F.when(conditional | holds(t["mood"] == "Cnd"), 0.4), F.when(t["mood"] == "Imp", 0.7))
        return F.struct(t.alias("t"), F.aggregate(kids, none, negation).alias("n"), quantity.alias("quantity"), F.least(*limits).alias("limit"), conditional.alias("conditional"))

    def node(t):
        r = let(below(tokens, t), lambda kids: rules(t, kids))
        return let(r, lambda x: x["t"].withField("negated", x["n"]["negated"]).withField("turns", x["n"]["turns"]).withField("quantity", x["quantity"]).withField("limit", x["limit"]).withField("conditional", x["conditional"]))

    return rows.withColumn("tokens", F.transform(tokens, node))


def confidence(tokens: Column, v: Column, *of: Column) -> Column:
    """Less for unknown words, unresolved dependencies, short sentences and deep clauses."""
    unknown = sum(F.when(holds(x["has_vector"]), 0).otherwise(1) for x in of)
    loose = sum(F.when(such(x, ("dep",)), 1).otherwise(0) for x in of)
    n = F.size(tokens)
    out = 1.0 - 0.15 * unknown - 0.25 * loose - F.when(n < 3, 0.2).when(n < 5, 0.1).otherwise(0.0) - F.when(v["depth"] > 4, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), out))


def judgment(subject, verb, object_, factor, intensity, clause, sure) -> Column:
    named = {"subject": subject, "verb": verb, "object": object_, "factor": factor, "intensity": intensity, "clause": clause, "confidence": sure}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def generic(status: Column) -> Column:
    return F.when(status == "GENERIC", 0.7).otherwise(1.0)


def nameable(t: Column, status: Column) -> Column:
    return (status != "REFERENTIAL") & ((F.length(t["lemma"]) >= 2) | (t["lemma"] == "я"))


def verbal(tokens: Column, v: Column, kids: Column) -> Column:
    """Every subject with every object of a verb; of a passive one the agents, or else the objects, are the subjects."""
    of = F.coalesce(v["clause"], F.lit("UNKNOWN"))
    subjects = with_conjuncts(tokens, F.filter(kids, lambda k: such(k, ("nsubj", "nsubj:pass"), NAMED)))
    plain, other = F.filter(kids, lambda k: such(k, ("obj", "dobj", "obl", "iobj"), ARGUMENTS)), F.filter(kids, lambda k: such(k, ("xcomp", "ccomp", "acomp"), ("NOUN", "ADJ", "PROPN")))
    objects = with_conjuncts(tokens, F.when(F.size(plain) > 0, plain).otherwise(other))
    agents = F.filter(kids, lambda k: such(k, ("obl",), ARGUMENTS))
    passive = F.exists(kids, lambda k: such(k, ("nsubj:pass",), NAMED))
    intensity = F.least(F.lit(1.0), F.coalesce(F.try_element_at(fixed_map(L.VERB_INTENSITY), v["lemma"]), F.lit(0.5)))

    def both(ends):
        first = F.when(passive, F.when(F.size(agents) > 0, agents).otherwise(ends["objects"])).otherwise(ends["subjects"])
        second = F.when(passive, ends["subjects"]).otherwise(ends["objects"])

        def pair(s, o):
            one, two = classify.status(s, of), classify.status(o, of)
            right = nameable(s, one) & ~s["points"] & (two != "REFERENTIAL") & (F.length(o["lemma"]) >= 2) & (o["lemma"] != s["lemma"])
            return F.when(right, judgment(F.when(one == "INTERLOCUTOR", "ты").otherwise(s["lemma"]), v["lemma"], o["lemma"], generic(one) * generic(two), intensity, of, confidence(tokens, v, v, s, o)))

        return let(second, lambda ends2: F.flatten(F.transform(first, lambda s: F.transform(ends2, lambda o: pair(s, o)))))

    return F.filter(let(F.struct(subjects.alias("subjects"), objects.alias("objects")), both), lambda x: x.isNotNull())


def nominal(tokens: Column, t: Column, kids: Column) -> Column:
    """A noun or adjective as predicate of its subjects."""
    of = F.coalesce(t["clause"], F.lit("UNKNOWN"))
    copula = F.concat(F.lit("cop:"), F.coalesce(F.get(F.filter(kids, lambda k: such(k, ("cop",))), F.lit(0))["lemma"], F.lit("это")))

    def pair(s):
        status = classify.status(s, of)
        return F.when(nameable(s, status), judgment(s["lemma"], copula, t["lemma"], generic(status), F.lit(0.7), of, confidence(tokens, t, t, s, t)))

    subjects = with_conjuncts(tokens, F.filter(kids, lambda k: such(k, ("nsubj",), NAMED)))
    return F.filter(F.transform(subjects, pair), lambda x: x.isNotNull())


def attributes(tokens: Column, t: Column, kids: Column) -> Column:
    """Adjectives of a noun; an adverb before them strengthens or weakens."""
    def trait(a):
        adverbs = F.filter(below(tokens, a), lambda k: such(k, ("advmod",)))
        intensity = F.aggregate(adverbs, F.lit(0.5), lambda x, k: x * F.coalesce(F.try_element_at(fixed_map(L.ADVERB_FACTORS), k["lemma"]), F.lit(1.0)))
        return judgment(t["lemma"], F.lit("amod"), a["lemma"], F.lit(1.0), F.least(F.lit(1.0), intensity), F.lit("GENERIC"), F.lit(1.0))

    adjectives = F.filter(kids, lambda k: such(k, ("amod",), ("ADJ",)) & (F.length(k["lemma"]) >= 2))
    return F.when(such(t, pos=("NOUN",)) & (F.length(t["lemma"]) >= 3), F.transform(adjectives, trait))


def said(rows: DataFrame) -> DataFrame:
    """tokens as nodes: mode, what they say (said) and what they say of themselves (traits), without a scope yet."""
    tokens = F.col("tokens")
    weights = fixed_map({k: float(w) for k, (_, w, _) in L.ENVELOPES.items()})
    raising = fixed_map({k: r for k, (_, _, r) in L.ENVELOPES.items()})

    def node(t, kids):
        verb, root = such(t, pos=("VERB", "AUX")), such(t, ("ROOT",), ("NOUN", "ADJ"))
        wraps = verb & t["lemma"].isin(*L.ENVELOPES) & F.exists(kids, lambda k: such(k, ("ccomp", "xcomp")))
        named = root & F.exists(kids, lambda k: such(k, ("nsubj",), NAMED))
        mode = F.when(wraps, WRAPS).when(verb & F.exists(kids, lambda k: k["conditional"]), CONDITIONAL).when(verb, VERBAL).when(named & (F.length(t["lemma"]) >= 2), NOMINAL).when(named, STOP).otherwise(ALL)
        found = F.when(verb & ~wraps, verbal(tokens, t, kids)).when(mode == NOMINAL, nominal(tokens, t, kids))
        return F.struct(*[t[c].alias(c) for c in ("i", "dep", "above", "root", "depth", "negated", "turns", "quantity", "limit", "conditional")], mode.alias("mode"), F.try_element_at(weights, t["lemma"]).alias("weight"),
                        F.try_element_at(raising, t["lemma"]).alias("raising"), found.alias("said"), attributes(tokens, t, kids).alias("traits"))

    return rows.withColumn("nodes", F.transform(tokens, lambda t: let(below(tokens, t), lambda kids: node(t, kids)))).drop("tokens")


def scope(negated, modality, quantity, condition, role) -> Column:
    return F.struct(negated.alias("negated"), modality.alias("modality"), quantity.alias("quantity"), condition.cast("long").alias("condition"), role.cast("string").alias("role"))


def narrowed(s: Column, n: Column) -> Column:
    """The scope below a node: negation, quantifiers and modality that it brings."""
    return scope(F.when(n["negated"], ~n["turns"]).otherwise(s["negated"] != n["turns"]), F.least(s["modality"], n["limit"]), F.coalesce(n["quantity"], s["quantity"]), s["condition"], s["role"])


def handed(s: Column, parent: Column, n: Column, sent_id: Column) -> Column:
    """What a node gets of its parent's scope; null if the parent doesn't hand it down to such a node."""
    mode = parent["mode"]
    gets = F.when(mode == WRAPS, such(n, ("ccomp", "xcomp"))).when(mode == CONDITIONAL, n["conditional"]).when(mode.isin(VERBAL, NOMINAL), such(n, CLAUSES)).otherwise(mode == ALL)
    wraps, tied = mode == WRAPS, mode == CONDITIONAL
    rejected = s["negated"] & ~parent["raising"]
    modality = F.when(wraps, s["modality"] * parent["weight"] * F.when(rejected, 0.3).otherwise(1.0)).when(tied, F.least(s["modality"], F.lit(0.4))).otherwise(s["modality"])
    whole = scope(F.when(wraps, s["negated"] & parent["raising"]).otherwise(s["negated"]), modality, s["quantity"], F.when(tied, sent_id * 1000 + parent["i"]).otherwise(s["condition"]), F.when(tied, "ANTECEDENT").otherwise(s["role"]))
    return F.when(s.isNotNull() & gets, whole)


def scopes(nodes: Column, sent_id: Column) -> Column:
    """The scope of each node, null for those that no clause hands one to; nodes of one depth after those above them."""
    start = scope(F.lit(False), F.lit(1.0), F.lit(1.0), F.lit(None), F.lit(None))
    first = F.transform(nodes, lambda n: F.when(n["root"], let(start, lambda s: narrowed(s, n))))
    deepest = F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0))
    levels = F.filter(F.sequence(F.lit(0), deepest), lambda x: x > 0)

    def got(acc, n):
        s = let(F.get(acc, n["above"]), lambda s: let(F.get(nodes, n["above"]), lambda parent: handed(s, parent, n, sent_id)))
        return let(s, lambda x: F.when(x.isNotNull(), narrowed(x, n)))

    return F.aggregate(levels, first, lambda acc, level: F.transform(nodes, lambda n, j: F.when(n["depth"] == level, got(acc, n)).otherwise(F.get(acc, j))))


def extract(sentences: DataFrame) -> DataFrame:
    """Judgments of parsed sentences, seq by the place of the word that says them. Antecedents of conditions are labelled as
    such; ids of conditions come from the sentence and its verb. Null tokens count as none, null features as absent."""
    rows = classify.classified(sentences.select("sent_id", "ts", "text", "tokens"))
    rows = said(ruled(linked(rows)))
    nodes, sent_id = F.col("nodes"), F.col("sent_id")
    rows = rows.withColumn("scopes", scopes(nodes, sent_id))

    def tell(n, s):
        tied = n["mode"] == CONDITIONAL

        def at(j, modality, condition, role):
            quality = F.when(s["negated"], "NEGATIVE").otherwise("AFFIRMATIVE")
            strength = F.greatest(F.lit(FLOOR), modality * s["quantity"]) * j["factor"]
            return F.struct(*[j[c].alias(c) for c in ("subject", "verb", "object")], quality.alias("quality"), strength.alias("modality"), j["intensity"].alias("intensity"), condition.cast("long").alias("condition_id"), role.cast("string").alias("condition_role"),
                            j["confidence"].alias("extraction_confidence"), j["clause"].alias("clause_type"))

        modality, condition, role = F.when(tied, F.least(s["modality"], F.lit(0.4))).otherwise(s["modality"]), F.when(tied, sent_id * 1000 + n["i"]).otherwise(s["condition"]), F.when(tied, "CONSEQUENT").otherwise(s["role"])
        told = F.transform(n["said"], lambda j: at(j, modality, condition, role))
        traits = F.transform(n["traits"], lambda j: at(j, s["modality"], F.lit(None), F.lit(None)))
        return F.when(s.isNotNull(), F.concat(F.coalesce(told, F.array()), F.coalesce(traits, F.array())))

    found = F.flatten(F.filter(F.zip_with(nodes, "scopes", tell), lambda x: x.isNotNull()))
    rows = rows.select("sent_id", "ts", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("source_text"), F.posexplode(found).alias("seq", "j"))
    rows = rows.select("sent_id", "seq", "ts", "source_text", "j.*")
    return rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in JUDGMENTS.split(", ")])
