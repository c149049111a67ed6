"""Substring dedup by repeated-phrase automata over words.

* Candidates: all documents are read whole, and the pieces of text around anchors that occur again are kept (see
  `anchored`). What can't hold a recurring window is in no piece.
* Confirmation: pieces of one anchor meet, and windows that occur more than once among them, by content and not by
  hash, are joined with those that follow them into recurring passages.
* Automata: the passages, dealt by anchor into shards, are compiled into Aho-Corasick automata over word numbers, and
  the pieces of all documents stream through the automaton of their shard. What it finds is what is removed.

Anchors with very many occurrences would make large groups. Their windows are pieces of their own, dealt by content;
equal ones are combined before the shuffle to confirm them, and the occurrences of each are dealt over several shards,
which all have the passage.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchored import groups_in_order, keyed, merged, pieces, runs, with_spans
from .common import stage

GRAM = 8
#: Occurrences of an anchor that one task compares together; those of more frequent ones are compared window by window.
HOT = 50_000
#: Rows of a block that is confirmed or of an automaton with what streams through it, groups being whole.
BLOCK = 4_000
#: Shards over which the occurrences of each window of an anchor of over HOT are dealt.
SALTS = 16


def recurring(words: list[np.ndarray], copies: np.ndarray, group: np.ndarray, offset: np.ndarray, many: np.ndarray, width: int) -> np.ndarray:
    """marked[piece, offset]: the window with the anchor at that offset occurs more than once in the piece's group.

    Classes of equal windows are refined word by word: words right of the anchor number classes of beginnings, words
    left of it classes of ends, and a window is a pair of both. A piece counts as often as it has copies.
    """
    n = len(words)
    top = int(offset.max()) if n else 0
    # ahead[d]: class of the d words from the anchor on; behind[d]: class of the d words before it; -1 where a piece is too short.
    line = np.full((n, top + width), -1, np.int64)
    for i, w in enumerate(words):
        line[i, top - offset[i] : top - offset[i] + len(w)] = w

    def refine(columns) -> list[np.ndarray]:
        now, out = np.unique(group, return_inverse=True)[1], []
        for c in columns:
            out.append(now)
            now = np.unique(now * (1 << 32) + (line[:, c] + 1), return_inverse=True)[1]
        return [*out, now]

    ahead, behind = refine(range(top, top + width)), refine(range(top - 1, -1, -1))
    marked = np.zeros((n, width), bool)
    for r in range(top + 1):
        i = np.flatnonzero((offset >= r) & (offset - many < r))
        if len(i):
            _, at = np.unique(ahead[width - r][i] * n + behind[r][i], return_inverse=True)
            marked[i, r] = np.bincount(at, copies[i])[at] > 1
    return marked


def numbered(texts: list[bytes], numbers: dict[bytes, int]) -> list[list[int]]:
    return [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts]


def confirmed(table: pa.Table, width: int) -> tuple[list[int], list[bytes]]:
    """(hash, passage) of the recurring passages of a table of pieces, whole groups by hash."""
    copies: dict[tuple, int] = {}
    for key in zip(*(table.column(c).to_pylist() for c in ("hash", "offset", "windows", "piece")), strict=True):
        copies[key] = copies.get(key, 0) + 1
    group, offset, many = (np.array(x, np.int64) for x in list(zip(*copies, strict=True))[:3])
    words = numbered([k[3] for k in copies], {})
    marked = recurring([np.array(w) for w in words], np.fromiter(copies.values(), np.int64), group, offset, many, width)
    row, low, high = runs(marked)
    texts = [k[3].split() for k in copies]
    found = {(int(group[i]), b" ".join(texts[i][a:b])) for i, a, b in zip(row.tolist(), (offset[row] - high).tolist(), (offset[row] - low + width).tolist(), strict=True)}
    return [h for h, _ in found], [p for _, p in found]


def located(passages: list[bytes], texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, first word, last word + 1) of every place where a text holds one of the passages."""
    numbers = {b"": 0}  # 0 stands for words of no passage
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in numbered(passages, numbers):
        automaton.add_word(tuple(p), len(p))
    automaton.make_automaton()
    known = numbers.get
    return [(i, end - n + 1, end + 1) for i, t in enumerate(texts) for end, n in automaton.iter(tuple([known(w, 0) for w in t.split()]))]


def repeated_spans(docs: DataFrame, width: int = 35, hot: int = HOT) -> DataFrame:
    """Spans (did, tie, start, end) in words of what recurs; they overlap and may touch."""
    made, singles = pieces(keyed(docs), width, GRAM, True, hot)
    made = stage(made, "pieces")

    def confirm(batches):
        for table in groups_in_order(batches, BLOCK):
            h, p = confirmed(table, width)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.binary())], names=["hash", "piece"])

    whole = made.select("hash", "offset", "windows", "piece").repartition("hash").sortWithinPartitions("hash")
    passages = whole.mapInArrow(confirm, "hash long, piece binary").withColumn("salt", F.lit(0))
    stream = made.select("hash", F.lit(0).alias("salt"), "did", "tie", (F.col("anchor") - F.col("offset")).alias("begin"), "piece")
    if singles is not None:
        again = singles.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1")
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        passages = passages.unionByName(again.select(F.xxhash64("piece").alias("hash"), "piece", every))
        dealt = F.pmod(F.xxhash64("did", "tie", "start"), F.lit(SALTS)).cast("int").alias("salt")
        stream = stream.unionByName(singles.select(F.xxhash64("piece").alias("hash"), dealt, "did", "tie", F.col("start").alias("begin"), "piece"))
    passages = stage(passages, "passages")

    def locate(batches):
        for table in groups_in_order(batches, BLOCK):
            did, texts = table.column("did").to_numpy(zero_copy_only=False), table.column("piece").to_pylist()
            is_text = table.column("is_text").to_numpy(zero_copy_only=False)
            passage, text = np.flatnonzero(~is_text), np.flatnonzero(is_text)
            if not len(passage) or not len(text):
                continue
            found = located([texts[i] for i in passage], [texts[i] for i in text])
            if found:
                i, first, last = np.array(found, np.int64).T
                at = text[i]
                begin, tie = table.column("begin").to_numpy()[at], table.column("tie").to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(did[at]), pa.array(tie), pa.array(begin + first), pa.array(begin + last)], names=["did", "tie", "start", "end"])

    zero = F.lit(0).cast("long")
    both = stream.withColumn("is_text", F.lit(True)).unionByName(passages.select("hash", "salt", zero.alias("did"), zero.alias("tie"), zero.alias("begin"), "piece", F.lit(False).alias("is_text")))
    return both.repartition("hash", "salt").sortWithinPartitions("hash").mapInArrow(locate, "did long, tie long, start long, end long")


def phrase_dedup(docs: DataFrame, width: int = 35, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """Removes from docs(doc_id, text) each word covered by a window of `width` words that also starts anywhere else.

    Words are runs of other characters than space and ASCII controls 9 to 13, compared unchanged; windows lie within
    one document and are judged on the input. Returns one row for each input row: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), and kept with keep_text. Null text has no words; a null
    doc_id is kept as it is; texts shorter than a window keep all; rows that repeat doc_id and text are documents of
    their own, so they lose what they share. An empty table gives an empty result; other columns are ignored.
    """
    rows = keyed(docs)
    none, some = with_spans(rows, repeated_spans(docs, width, hot))
    fields = [rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept", T.StringType())] * keep_text)

    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            out = [[] for _ in range(4)]
            for text, spanned in zip(batch.column("text"), spans, strict=True):
                words = text.as_py().encode().split()
                kept = words
                if spanned:
                    at = [0, *[x for s in merged([(s["start"], s["end"]) for s in spanned]) for x in s], len(words)]
                    kept = [w for a, b in zip(at[::2], at[1::2], strict=True) for w in words[a:b]]
                data = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data.decode() if keep_text else None), strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:2]], pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[3], pa.string())] * keep_text, names=[f.name for f in schema])

    return none.select("doc_id", "text").mapInArrow(run, schema).unionByName(some.select("doc_id", "text", "spans").mapInArrow(run, schema))
