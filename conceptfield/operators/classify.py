"""Classes of clauses and noun phrases as Column expressions over a sentence's array of tokens.

Everything is computed in the row that holds the sentence: no shuffle, no Python worker. Missing heads, lemmas and features
count as absent; then no rule applies that asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L

CLASSES = ("GENERIC", "HABITUAL")


def child(tokens: Column, i: Column, deps=None, pos=None, lemmas=None) -> Column:
    """Whether token i has a child of such a dependency, part of speech and lemma."""
    def fits(k):
        out = (k["head"] == i) & (k["i"] != i)
        for name, allowed in (("dep", deps), ("pos", pos), ("lemma", lemmas)):
            if allowed is not None:
                out = out & k[name].isin(*allowed)
        return out

    return F.coalesce(F.exists(tokens, fits), F.lit(False))


def head(tokens: Column, t: Column) -> Column:
    return F.get(F.filter(tokens, lambda k: k["i"] == t["head"]), F.lit(0))


def clause(tokens: Column, bigrams: Column, v: Column) -> Column:
    """GENERIC, HABITUAL, EPISODIC or UNKNOWN: the first rule that applies decides."""
    habitual = child(tokens, v["i"], ("advmod",), lemmas=L.HABITUAL_MARKERS) | F.arrays_overlap(bigrams, F.array(*map(F.lit, L.HABITUAL_BIGRAMS)))
    temporal = child(tokens, v["i"], ("advmod", "obl"), lemmas=L.TEMPORAL_MARKERS) | F.arrays_overlap(bigrams, F.array(*map(F.lit, L.TEMPORAL_BIGRAMS)))
    lasting = v["lemma"].isin("быть", "являться", "стать") & child(tokens, v["i"], pos=("ADJ",), lemmas=L.ILP_ADJECTIVES)
    lasting_root = v["pos"].isin("ADJ", "NOUN") & (v["dep"] == "ROOT") & v["lemma"].isin(*L.ILP_ADJECTIVES)

    def form(tense, aspect):
        return (v["tense"] == tense) & (v["aspect"] == aspect)

    return (
        F.when(v["mood"] == "Cnd", "GENERIC").when(habitual, "HABITUAL").when(temporal, "EPISODIC").when(form("Pres", "Imp"), "GENERIC")
        .when(form("Past", "Perf"), "EPISODIC").when(form("Past", "Imp"), "HABITUAL").when(lasting, "GENERIC").when(lasting_root, "GENERIC").otherwise("UNKNOWN")
    )


def addressee(tokens: Column, t: Column, of: str) -> Column:
    """Whether "you" in a clause of class `of` is the person addressed or anyone."""
    v = head(tokens, t)
    verb = v["pos"] == "VERB"
    met = verb & ((v["tense"] == "Past") & (v["aspect"] == "Perf") | child(tokens, v["i"], ("advmod", "obl"), lemmas=L.TEMPORAL_MARKERS))
    otherwise = F.lit("GENERIC") if of == "GENERIC" else F.when(met, "INTERLOCUTOR").otherwise("GENERIC") if of == "HABITUAL" else F.lit("INTERLOCUTOR")
    return F.when(verb & (v["dep"] == "advcl") & child(tokens, v["i"], ("mark",), lemmas=L.GENERIC_MARKS), "GENERIC").when(verb & (v["mood"] == "Imp"), "INTERLOCUTOR").otherwise(otherwise)


def quasi_generic(tokens: Column, t: Column, of: str) -> Column:
    fixed = child(tokens, t["i"], ("nummod", "acl:relcl", "acl")) | child(tokens, t["i"], pos=("NUM",)) | child(tokens, t["i"], ("appos", "flat:name", "nmod"), ("PROPN",))
    v = head(tokens, t)
    event = (v["pos"] == "VERB") & v["lemma"].isin(*L.SLP_VERBS) & (v["aspect"] == "Perf") & F.lit(of not in CLASSES)
    return F.when(fixed | event, "REFERENTIAL").otherwise("CONCEPTUAL")


def phrase(tokens: Column, t: Column, of: str) -> Column:
    """Referential status in a clause of class `of`: SELF, INTERLOCUTOR, GENERIC, REFERENTIAL or CONCEPTUAL."""
    pronoun = F.when(t["lemma"].isin(*L.SELF_PRONOUNS), "SELF").when(t["lemma"].isin(*L.INTERLOCUTORS), addressee(tokens, t, of)).otherwise("REFERENTIAL")
    noun = F.when(t["lemma"].isin(*L.ABSTRACT_NOUNS), "CONCEPTUAL").when(child(tokens, t["i"], ("det", "amod"), lemmas=L.DETERMINERS), "REFERENTIAL").when(t["lemma"].isin(*L.QUASI_GENERIC_NOUNS), quasi_generic(tokens, t, of))
    return F.when(t["pos"] == "PRON", pronoun).when(t["pos"] == "PROPN", "REFERENTIAL").when(t["pos"].isin("NOUN", "ADJ"), noun.otherwise("CONCEPTUAL")).otherwise("CONCEPTUAL")


def pointer(tokens: Column, text: Column, t: Column) -> Column:
    """Whether a discourse noun points at what follows: "the point is that", "this question"."""
    said = F.lit(False)
    for w in ("в том", "заключается", "состоит"):
        said = said | F.contains(F.concat(F.lit(" "), text), F.concat(F.lit(" "), t["lemma"], F.lit(" " + w)))
    return t["lemma"].isin(*L.DISCOURSE_POINTERS) & (said | child(tokens, t["i"], ("det",), lemmas=("этот", "тот", "наш", "мой", "свой")))


def classified(sentences: DataFrame) -> DataFrame:
    """sentences with tokens in order, lemmas in lower case, and in each token clause (its class if it heads one, else null),
    generic, habitual and other (its status in clauses of that class) and points."""
    plain = F.array_sort(F.transform(F.coalesce("tokens", F.array().cast(sentences.schema["tokens"].dataType)), lambda t: F.struct(
        t["i"].alias("i"), F.lower(F.coalesce(t["text"], F.lit(""))).alias("text"), F.lower(F.coalesce(t["lemma"], F.lit(""))).alias("lemma"), *[t[c].alias(c) for c in ("pos", "dep", "head", "aspect", "tense", "mood", "has_vector")])))
    words = F.transform("tokens", lambda t: t["text"])
    rows = sentences.withColumn("tokens", plain).withColumn("_text", F.lower(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_bigrams", F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))
    tokens = F.col("tokens")

    def full(t):
        heads = t["pos"].isin("VERB", "AUX") | (t["dep"] == "ROOT") & t["pos"].isin("ADJ", "NOUN")
        return F.struct(
            *[t[c].alias(c) for c in ("i", "lemma", "pos", "dep", "head", "mood", "has_vector")], F.when(heads, clause(tokens, F.col("_bigrams"), t)).alias("clause"),
            *[phrase(tokens, t, of).alias(of.lower()) for of in (*CLASSES, "OTHER")], F.coalesce(pointer(tokens, F.col("_text"), t), F.lit(False)).alias("points"))

    return rows.withColumn("tokens", F.transform(tokens, full)).drop("_text", "_bigrams")


def status(t: Column, of: Column) -> Column:
    return F.when(of == "GENERIC", t["generic"]).when(of == "HABITUAL", t["habitual"]).otherwise(t["other"])


def annotate(sentences: DataFrame) -> DataFrame:
    """(sent_id, i, lemma, ref_status, clause_type) of every noun, proper noun, pronoun and adjective."""
    tokens = F.col("tokens")

    def note(t):
        h = head(tokens, t)
        of = F.coalesce(h["clause"], head(tokens, h)["clause"], F.lit("UNKNOWN"))
        return F.struct(t["i"].alias("i"), t["lemma"].alias("lemma"), status(t, of).alias("ref_status"), of.alias("clause_type"))

    named = F.filter(tokens, lambda t: t["pos"].isin("NOUN", "PROPN", "PRON", "ADJ"))
    return classified(sentences.select("sent_id", "text", "tokens")).select("sent_id", F.inline(F.transform(named, note)))
