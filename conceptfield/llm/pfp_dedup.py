"""Suffix-array dedup by prefix-free parsing: repeated byte strings are removed after their first occurrence.

All documents are read whole. Text around anchors that occur again, where alone a string can repeat, is dealt by
anchor into shards (see `anchored`), so that equal strings meet. Each shard is parsed prefix-free: a rolling hash over
a few bytes triggers the ends of phrases, each phrase runs to the end of the next trigger, and no phrase's suffix that
ends in a trigger is the beginning of another. Equal pieces are parsed once, equal phrases are one entry of the
dictionary. The suffix array of the dictionary and that of the parse, both by prefix doubling, combine into the order
of all strings of the shard: by the phrase's suffix up to the next trigger, then by the parse from there on. Strings
that are neighbours in this order and agree in their first `width` bytes are equal, and the earliest in the corpus
stays. The order of the shards' anchors makes that the order of all strings that can repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchored import groups_in_order, keyed, merged, pieces, runs, with_spans
from .common import lookup, stage

GRAM = 16
#: Occurrences of an anchor that one task compares together; those of more frequent ones are compared window by window.
HOT = 50_000
BLOCK = 2_000
#: Bytes of a trigger, and the power of two of which one in so many byte strings is a trigger.
TRIGGER, RARITY = 4, 4


def doubled(rank: np.ndarray, end: np.ndarray, have: int) -> np.ndarray:
    """Ranks of all suffixes, by prefix doubling: rank orders them by their first `have` elements; end is where the
    suffix of each place ends. Equal suffixes have equal ranks; what ends first comes first.

    A rank is how many suffixes come before its class, so that a class can be split without touching others: each round
    sorts only classes of several suffixes that go on. The given rank is changed.
    """
    n = len(rank)
    while True:
        many, open_ = np.bincount(rank, minlength=n), np.arange(n) + have < end
        live = np.zeros(n, bool)
        live[rank[open_]] = True
        at = np.flatnonzero(live[rank] & (many[rank] > 1))
        key = rank[at] * (n + 1) + np.where(open_[at], rank[np.minimum(at + have, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], at[order]
        here = np.arange(len(at))
        mine = rank[at]
        part = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(at)], here, 0))
        whole = np.maximum.accumulate(np.where(np.append(True, mine[1:] != mine[:-1])[: len(at)], here, 0))
        if (part == whole).all():  # no class splits, so none will
            return rank
        rank[at] = mine + part - whole
        have *= 2


def ranks(keys: np.ndarray) -> np.ndarray:
    """How many keys are smaller than each."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1])[: len(keys)], np.arange(len(keys)), 0))
    return rank


def dictionary_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix ranks of a dictionary, phrase after phrase, and where each phrase starts in them."""
    length = np.fromiter(map(len, phrases), np.int64, len(phrases))
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(phrases) + bytes(7), np.uint8).astype(np.int64) + 1
    n = int(length.sum())
    end, here, first = np.repeat(start + length, length), np.arange(n), np.zeros(n, np.int64)
    for k in range(7):
        first = (first << 9) | np.where(here + k < end, data[k : k + n], 0)
    return doubled(ranks(first), end, 7), start


def string_order(texts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, place, text) of the first `many` strings of each text, in the order of the strings: the joined texts, each
    string's place in them and the text that it is from."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(length)
    start = end - length
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    gram = data.astype(np.uint32)
    packed = gram[:-3] | gram[1:-2] << np.uint32(8) | gram[2:-1] << np.uint32(16) | gram[3:] << np.uint32(24)
    trigger = np.flatnonzero((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - RARITY) == 0)
    owner = np.searchsorted(end, trigger, side="right")
    trigger = trigger[trigger + TRIGGER <= end[owner]]
    cut = np.union1d(start, trigger)  # where phrases begin
    owner = np.searchsorted(end, cut, side="right")
    after = np.append(cut[1:] + TRIGGER, len(data))
    stop = np.where(after - TRIGGER < end[owner], after, end[owner])
    phrases = [joined[a:b] for a, b in zip(cut.tolist(), stop.tolist(), strict=True)]
    dictionary = sorted(set(phrases))
    rank = {p: i for i, p in enumerate(dictionary)}
    parse = np.fromiter(map(rank.__getitem__, phrases), np.int64, len(phrases))
    suffix, first = dictionary_ranks(dictionary)
    last = np.searchsorted(cut, end[owner])  # the parse of each text ends where the next one begins
    order = doubled(ranks(parse), last, 1)
    text = np.repeat(np.arange(len(texts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + start[text]
    phrase = np.searchsorted(cut, place, side="right") - 1
    follow = np.where(phrase + 1 < last[phrase], order[np.minimum(phrase + 1, len(order) - 1)] + 1, 0)
    inside = suffix[first[parse[phrase]] + place - cut[phrase]]
    by = np.argsort(inside * (len(order) + 1) + follow, kind="stable")
    return data, place[by], text[by]


def later_windows(table: pa.Table, width: int) -> np.ndarray:
    """marked[piece, window]: the window, of 8 bytes or more, also occurs earlier in the corpus. Rows are whole groups by hash."""
    keys = np.stack([table.column(c).to_numpy() for c in ("did", "tie", "anchor")])
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = (keys[:, order[1:]] == keys[:, order[:-1]]).all(axis=0)
    turn = np.empty(len(order), np.int64)  # the piece's turn in the corpus; rows that repeat have one
    turn[order] = np.cumsum(~same)
    seen: dict[tuple, int] = {}
    numbers = [table.column(c).to_numpy().tolist() for c in ("hash", "offset", "windows")]
    groups = list(zip(*numbers, table.column("piece").to_pylist(), strict=True))
    first = np.empty(len(order), np.int64)  # the earliest piece that is equal
    for i in order.tolist():
        first[i] = seen.setdefault(groups[i], i)
    distinct = np.fromiter(seen.values(), np.int64, len(seen))
    many = table.column("windows").to_numpy()
    copy = turn > turn[first]
    marked = np.zeros((len(order), width), bool)
    marked[copy] = np.arange(width) < many[copy][:, None]
    # Equal strings have their anchor at one offset, so none is twice in a piece: a piece alone with its anchor has no equals.
    _, back, pieces_ = np.unique(table.column("hash").to_numpy()[distinct], return_inverse=True, return_counts=True)
    distinct = distinct[pieces_[back] > 1]
    if not len(distinct):
        return marked
    data, place, text = string_order([groups[i][3] for i in distinct.tolist()], many[distinct])
    words = np.ndarray((max(0, len(data) - 7),), np.uint64, data, 0, (1,))  # the eight bytes from each place on
    equal = np.arange(1, len(place))
    for k in [*range(0, width - 8, 8), width - 8]:
        equal = equal[words[place[equal] + k] == words[place[equal - 1] + k]]
    new = np.ones(len(place), bool)
    new[equal] = False
    mine = turn[distinct[text]]
    earliest = np.minimum.reduceat(mine, np.flatnonzero(new))[np.cumsum(new) - 1]
    size = np.array([len(groups[i][3]) for i in distinct.tolist()])
    own = np.zeros((len(order), width), bool)
    own[distinct[text], place - (np.cumsum(size) - size)[text]] = mine > earliest
    return np.where(copy[:, None], marked, own[first])


def repeated_spans(docs: DataFrame, width: int = 100, hot: int = HOT) -> DataFrame:
    """Spans (did, tie, start, end) in bytes of what occurs earlier too; they overlap and may touch."""
    rows = keyed(docs)
    made, singles = pieces(rows, width, GRAM, False, hot)

    def run(batches):
        for table in groups_in_order(batches, BLOCK):
            row, low, high = runs(later_windows(table, width))
            if len(row):
                begin = (table.column("anchor").to_numpy() - table.column("offset").to_numpy())[row]
                yield pa.RecordBatch.from_arrays([pa.array(table.column("did").to_numpy()[row]), pa.array(table.column("tie").to_numpy()[row]), pa.array(begin + low), pa.array(begin + high + width)], names=["did", "tie", "start", "end"])

    spans = made.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "did long, tie long, start long, end long")
    if singles is not None:
        first = singles.groupBy("piece").agg(F.min(F.struct("did", "tie", "start")).alias("first"), F.count("*").alias("n"))
        first = stage(first.where("n > 1"), "firsts")
        total = first.agg(F.sum("n")).first()[0] or 0
        met = lookup(singles, first, ["piece"], "n", total, F.xxhash64("did", "start"))
        met = met.where(F.col("first").isNotNull() & (F.col("first") != F.struct("did", "tie", "start")))
        spans = spans.unionByName(met.select("did", "tie", "start", (F.col("start") + width).alias("end")))
    return spans


def pfp_dedup(docs: DataFrame, width: int = 100, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """Removes from docs(doc_id, text), as UTF-8 bytes, each byte covered by a `width`-byte string that starts earlier too.

    Earlier means in a document of smaller doc_id or before in the same one; strings are judged on the input. Returns
    one row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept (the
    bytes) with keep_text. Null text is empty; a null doc_id comes after all others; of different texts with the same
    doc_id a hash of the text decides which comes first; rows that repeat both count as one document, so each keeps what
    the document keeps. An empty table gives an empty result; other columns are ignored.
    """
    rows = keyed(docs)
    none, some = with_spans(rows, repeated_spans(docs, width, hot))
    fields = [rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept", T.BinaryType())] * keep_text)

    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            out = [[] for _ in range(5)]
            for text, spanned in zip(batch.column("text"), spans, strict=True):
                data = text.as_py().encode()
                gone = merged([(s["start"], s["end"]) for s in spanned or []])
                at = [0, *[x for s in gone for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)) if gone else data
                for column, value in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[4], pa.binary())] * keep_text, names=[f.name for f in schema])

    return none.select("doc_id", "text").mapInArrow(run, schema).unionByName(some.select("doc_id", "text", "spans").mapInArrow(run, schema))
