"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon, a weighted automaton over characters, reads a word into a class: insult words, intensifiers, threatening verbs,
words of intent, targets, negations, speech verbs; clause ends are a class too. Five small weighted transducers over
classes are composed into one: the insult transducer writes insults, stronger after an intensifier; the threat
transducer writes threats, a verb of violence after words of intent weighing more than a bare one; negation turns both
into weakened ones until their clause ends; reported speech into reported ones; and a target before an insult or
beside a threat strengthens it. The composed machine gives each clause a score; a logistic function of the clauses'
scores is the text's score.

Insult words and stems beside the fixed ones are learned from labelled rows: words, and prefixes that inflected words
share, whose documents are nearly all toxic. The labelled rows used are a bounded sample (`SAMPLE`); texts are scored whole.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, plain, stage

#: Labelled rows that train the model, at most: those with the smallest hashes.
SAMPLE = 20_000
#: Learned words and stems, at most.
LEXICON = 4_000

INSULTS = "idiot idiots moron morons imbecile stupid dumb dumbass loser losers scum scumbag worthless pathetic trash disgusting clown jerk creep freak bastard bitch asshole retard vermin filth".split()
THREATS = "kill hurt destroy beat punch shoot stab strangle murder attack smash burn hang crush die".split()
INTENSIFIERS = "such so very really total totally complete completely absolute absolutely utter utterly fucking damn bloody most tellement vraiment très so sehr wirklich total tan muy totalmente".split()
INTENTS = "will gonna going shall must should let let's lets hope wish want wants deserve deserves ought i'll we'll they'll he'll she'll you'll vais va veux devrais werde wird will soll voy va quiero debería".split()
TARGETS = "you your yours yourself u ur he him his she her they them their this these those everyone people tu toi vous ton du dich ihr euch sie usted ustedes te ellos".split()
NEGATIONS = "not no never none nor neither cannot isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't hardly ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says saying told tells called calls claimed claims wrote writes reported reports quoted quotes alleged accused according dit disait écrit sagte sagt schrieb dijo dice escribió".split()

#: A word with its apostrophes, or a clause end.
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """Weighted, deterministic: arcs (state, symbol) -> (next state, output, weight); symbols without an arc pass unchanged."""

    def __init__(self, arcs: dict):
        self.arcs = arcs
        self.states = sorted({0} | {s for s, _ in arcs} | {a[0] for a in arcs.values()})

    def step(self, state: int, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def then(self, other: Transducer, symbols: str) -> Transducer:
        """Composition: other reads what this one writes; weights multiply. An empty output is read as nothing."""
        width, arcs = len(other.states), {}
        for p in self.states:
            for q in other.states:
                for s in symbols:
                    p2, out, w = self.step(p, s)
                    q2, out2, w2 = other.step(q, out) if out else (q, "", 1.0)
                    arcs[p * width + q, s] = (p2 * width + q2, out2, w * w2)
        return Transducer(arcs)


#: Read: w insult word, X intensifier, v verb of violence, M intent, T target, N negation, R speech verb, B clause end.
SYMBOLS = "wXvMTNRB"
#: Written, from machine to machine: I insult, H threat, h bare violence, i negated, r reported, J targeted insult, K threat with target.
INSULT = Transducer({(0, "w"): (0, "I", 1.0), (0, "X"): (1, "", 1.0), (1, "X"): (1, "", 1.0), (1, "w"): (0, "I", 1.25), (1, "B"): (0, "B", 1.0)})
THREAT = Transducer({(0, "v"): (0, "h", 1.0), (0, "M"): (1, "", 1.0), (1, "M"): (1, "", 1.0), (1, "v"): (1, "H", 1.0), (1, "B"): (0, "B", 1.0)})
NEGATION = Transducer({(0, "N"): (1, "", 1.0), (1, "N"): (0, "", 1.0), (1, "B"): (0, "B", 1.0), (1, "I"): (1, "i", 0.3), (1, "H"): (1, "i", 0.2), (1, "h"): (1, "i", 0.1)})
REPORT = Transducer({(0, "R"): (1, "", 1.0), (1, "R"): (1, "", 1.0), (1, "B"): (0, "B", 1.0), (1, "I"): (1, "r", 0.4), (1, "i"): (1, "r", 0.4), (1, "H"): (1, "r", 0.3), (1, "h"): (1, "r", 0.15)})
TARGET = Transducer({
    (0, "T"): (1, "", 1.0), (1, "T"): (1, "", 1.0), (1, "B"): (0, "B", 1.0), (1, "I"): (1, "J", 1.5), (1, "H"): (1, "K", 2.0), (1, "h"): (1, "K", 1.0),
    (0, "H"): (2, "", 1.0), (2, "H"): (2, "", 1.0), (2, "h"): (2, "", 1.0), (2, "T"): (1, "K", 2.0), (2, "B"): (0, "B", 1.0),
    (0, "h"): (3, "", 1.0), (3, "h"): (3, "", 1.0), (3, "H"): (2, "", 1.0), (3, "T"): (1, "K", 1.0), (3, "B"): (0, "B", 1.0)})
MACHINES = (INSULT, THREAT, NEGATION, REPORT, TARGET)
GRAMMAR = INSULT
for _machine in MACHINES[1:]:
    GRAMMAR = GRAMMAR.then(_machine, SYMBOLS)


class Lexicon:
    """A weighted automaton over characters: reads a word, writes its class and weight; "" for words of no class.

    Final states of stems hold wherever a word passes them, those of words only at its end. The heaviest insult word or
    stem decides, else the class of the whole word.
    """

    def __init__(self, insults: dict[str, float], stems: dict[str, float], classes: dict[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[float] = [0.0]
        self.ended: list[tuple[str, float]] = [("", 0.0)]
        for entry, weight in stems.items():
            at = self.path(entry)
            self.passed[at] = max(self.passed[at], weight)
        for entry, symbol in classes.items():
            self.ended[self.path(entry)] = (symbol, 1.0)
        for entry, weight in insults.items():
            self.ended[self.path(entry)] = ("w", weight)

    def path(self, entry: str) -> int:
        at = 0
        for c in entry:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.passed.append(0.0)
                self.ended.append(("", 0.0))
            at = self.next[at][c]
        return at

    def read(self, word: str) -> tuple[str, float]:
        at, stem = 0, 0.0
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                return ("w", stem) if stem else ("", 0.0)
            stem = max(stem, self.passed[at])
        symbol, weight = self.ended[at]
        return ("w", max(stem, weight if symbol == "w" else 0.0)) if stem else (symbol, weight)


#: The logistic function before training: constant, direct insults, weakened insults, threats, strongest clause.
PRIOR = np.array([-2.5, 4.0, 1.0, 3.0, 0.5])


class Model:
    """The lexicon, the grammar and the logistic function."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], beta=PRIOR):
        classes = {w: c for c, ws in (("X", INTENSIFIERS), ("M", INTENTS), ("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("v", THREATS)) for w in ws}
        insults = dict.fromkeys(INSULTS, 1.0) | words
        self.lexicon, self.beta = Lexicon(insults, stems, classes), np.asarray(beta, float)
        self.marks = sorted({*insults, *stems, *THREATS})
        self.finder = None

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def hits(self, text: str) -> bool:
        """Whether a word of the text starts as an insult or threat does; others have no matched clause."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for w in self.marks:
                self.finder.add_word(w, len(w))
            self.finder.make_automaton()
        return any(end < n or not text[end - n].isalpha() for end, n in self.finder.iter(text))

    def features(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        out = np.zeros(len(self.beta))
        out[0] = 1
        if not self.hits(text):
            return out
        state, clause = 0, [0.0, 0.0, 0.0]
        sums, top = np.zeros(3), 0.0
        for token in [*TOKEN.findall(text), "."]:
            symbol, weight = self.lexicon.read(token) if token[0].isalpha() else ("B", 1.0)
            if not symbol:
                continue
            state, kind, w = GRAMMAR.step(state, symbol)
            if kind in ("I", "J"):
                clause[0] += w * weight
            elif kind in ("i", "r"):
                clause[1] += w * weight
            elif kind == "K":
                clause[2] += w
            elif kind == "B" and any(clause):
                sums += np.minimum(clause, 3.0)
                top, clause = max(top, *clause), [0.0, 0.0, 0.0]
        out[1:4], out[4] = np.log1p(sums), min(top, 3.0)
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-self.features(text) @ self.beta)))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    train = pick(labels, "doc_id", "toxic").where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isin(0, 1))
    train = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return pick(docs, "doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "toxic")


def learn_lexicon(train: DataFrame, least: int = 5, purity: float = 0.5, cover: int = 3) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic documents: (words, stems) with weights up to 1.5 by purity.

    Candidates occur in `least` toxic documents and make up at least `purity` of all documents with them; of stems that
    extend one another the longest is a candidate that still has nine tenths of the shorter one's documents. They are
    taken greedily while they cover toxic documents that fewer than `cover` taken ones cover, where copies, which have
    the same candidates, count once: words that merely occur in a copied document explain nothing more.
    """
    def words(frames):
        seen: dict[str, list[int]] = {}
        for pdf in frames:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                for w in set(WORD.findall((text or "").lower())):
                    seen.setdefault(w, [0, 0])[int(toxic)] += 1
            if len(seen) > 50_000:
                yield pd.DataFrame([(w, c, t) for w, (c, t) in seen.items()], columns=["w", "c", "t"])
                seen = {}
        yield pd.DataFrame([(w, c, t) for w, (c, t) in seen.items()], columns=["w", "c", "t"])

    each = train.mapInPandas(words, "w string, c long, t long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where(F.length("w") >= 3)
    stem = F.explode(F.concat(F.array(F.concat("w", F.lit("$"))), F.transform(F.sequence(F.lit(3), F.least(F.length("w"), F.lit(8))), lambda n: F.substring("w", F.lit(1), n))))
    kept = each.select(stem.alias("f"), "c", "t").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where((F.col("t") >= least) & (F.col("t") >= purity * (F.col("c") + F.col("t"))))
    rows = {r.f: (r.t, r.c) for r in kept.orderBy(F.desc("t"), "f").limit(4 * LEXICON).collect()}
    longer: dict[str, list[str]] = {}
    for f in rows:
        longer.setdefault(f[:-1], []).append(f)
    candidates = {f: t / (t + c + 5.0) for f, (t, c) in rows.items() if not any(rows[g][0] >= 0.9 * t and rows[g][1] <= c for g in longer.get(f, []))}
    if not candidates:
        return {}, {}

    def marks(frames):
        for pdf in frames:
            out = []
            for text in pdf["text"][pdf["toxic"] == 1]:
                found = set()
                for w in set(WORD.findall((text or "").lower())):
                    found.update(f for f in [w + "$", *(w[:n] for n in range(3, 1 + min(8, len(w))))] if f in candidates)
                out.append(" ".join(sorted(found)))
            yield pd.DataFrame({"m": out})

    docs = [set(r.m.split()) for r in train.mapInPandas(marks, "m string").distinct().orderBy("m").collect()]  # at most the sample
    with_: dict[str, list[int]] = {}
    for i, found in enumerate(docs):
        for f in found:
            with_.setdefault(f, []).append(i)
    covered, words_, stems = [0] * len(docs), {}, {}
    gain = {f: len(ids) * candidates[f] ** 3 for f, ids in with_.items()}
    while gain and len(words_) + len(stems) < LEXICON:
        f = max(gain, key=lambda g: (gain[g], g))
        now = sum(covered[i] < cover for i in with_[f]) * candidates[f] ** 3
        if now < gain[f] and now >= 2:
            gain[f] = now
            continue
        del gain[f]
        if now < 2:
            continue
        for i in with_[f]:
            covered[i] += 1
        (words_ if f[-1] == "$" else stems)[f.rstrip("$")] = 1.5 * candidates[f] ** 2
    return words_, stems


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards prior."""
    beta = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + strength * (beta - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(beta)), grad)
        beta -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return beta


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns lexicon and logistic function; without labelled rows the fixed words and weights hold."""
    train = stage(labelled(docs, labels, sample), "toxic-sample")
    model = Model(*learn_lexicon(train))

    def features(frames):
        for pdf in frames:
            yield pd.DataFrame({"y": pdf["toxic"].astype(float), "x": [model.features(t).tolist() for t in pdf["text"]]})

    rows = train.mapInPandas(features, "y double, x array<double>").toPandas()  # at most `sample` rows of five numbers
    if len(rows):
        rows = rows.iloc[np.lexsort(np.array(rows["x"].tolist()).T)]
        beta = fit(np.array(rows["x"].tolist()), rows["y"].to_numpy())
        model.beta = np.concatenate([beta[:1], np.maximum(beta[1:], 0.2 * PRIOR[1:])])  # a matched clause never lowers a score
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t.as_py()) for t in batch.column("text")], pa.float64())], names=["doc_id", "score"])

    docs = pick(docs, "doc_id", "text")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores every whole text of docs(doc_id, text); labels(doc_id, toxic) train it.

    Returns one row for each input row: doc_id, held_out (its label is never used), score, predicted. A null or empty
    text has the score of a text without matched clauses; null labels and labels of unknown documents are ignored, of
    several labels of a document the larger holds; a null doc_id is kept with held_out null; an empty table gives an
    empty result; other columns are ignored.
    """
    scored = score_documents(docs, train_model(docs, labels, sample))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the documents predicted toxic; all columns, one pass over the texts.

    Null and empty texts have no matched clause and stay; rows that repeat stay or go together; null ids stay rows like
    any other; an empty table gives an empty one; columns may have any names.
    """
    model = train_model(docs, labels, sample)
    rows, at = plain(docs)
    text = at["text"]

    def run(batches):
        for batch in batches:
            keep = [model.score(t.as_py()) < 0.5 for t in batch.column(text)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
