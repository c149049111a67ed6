"""Windows of a fixed length, brought together by content: anchors, pieces and the filters between passes.

Every window of `width` elements (bytes or words) has an anchor, the gram of least rolling hash in it. Equal windows
have equal anchors at equal offsets, so windows need only be compared with those of the same anchor. The windows that
share one occurrence of an anchor are consecutive; together they are a piece, the text from the first to the last.

Pass 1 counts anchors. Anchors met once have no equal windows elsewhere; the others set bits in a bitmap whose size
follows their number up to a bound (a fuller bitmap only lets more pieces through). Pass 2 writes the pieces whose
anchor's bit is set. Anchors with more occurrences than a group may have (`hot`) give their windows one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, bits_for, maybe, pick, stage

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Elements hashed at a time; longer texts are cut into overlapping segments.
CHUNK = 1 << 20
PLACE = (1 << 24) - 1
#: Bits of a bitmap: at least, and at most (64 MiB).
LEAST_BITS, MOST_BITS = 20, 29
NO_ID = (1 << 63) - 1


def powers(n: int, store: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if store.get("n", 0) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            up[0] = down[0] = 1
            store.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return store["up"][:n], store["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of data[start:end] for each pair."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    m, have = x, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m


class Chunk:
    """Some segments of texts as one byte array, with the windows of each segment grouped by anchor.

    After `find`: row (of the batch), first and last window start, anchor place (all in elements of the whole text),
    hash of the anchor, and `at`, the first window's place in this chunk.
    """

    def __init__(self, words: bool):
        self.words, self.parts, self.rows, self.bases, self.counts, self.size = words, [], [], [], [], 0

    def add(self, row: int, base: int, data: bytes, count: int) -> None:
        self.parts.append(data)
        self.rows.append(row)
        self.bases.append(base)
        self.counts.append(count)
        self.size += len(data) + 1

    def find(self, width: int, gram: int) -> bool:
        if self.words:
            joined = b" ".join(self.parts)
            self.data = np.frombuffer(joined, np.uint8)
            gaps = np.flatnonzero(self.data == 32)
            self.starts, self.ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(self.data)]))
        else:
            joined = b"".join(self.parts)
            self.data = np.frombuffer(joined, np.uint8)
            self.starts = np.arange(len(self.data))
            self.ends = self.starts + 1
        self.joined = joined
        n, counts = len(self.starts), np.array(self.counts)
        if n < width:
            return False
        hashes = span_hashes(self.data, self.starts[: n - gram + 1], self.ends[gram - 1 :])
        least = sliding_min((hashes & np.uint64(~PLACE & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64), width - gram + 1)
        anchor = (least & np.uint64(PLACE)).astype(np.int64)
        begin = np.cumsum(counts) - counts
        segment = np.repeat(np.arange(len(counts)), counts)[: len(anchor)]
        ok = np.arange(len(anchor)) + width <= (begin + counts)[segment]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1]) | (ok[1:] != ok[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(anchor)) - 1
        heads, tails = heads[ok[heads]], tails[ok[heads]]
        seg = segment[heads]
        shift = np.array(self.bases)[seg] - begin[seg]
        self.row, self.first, self.last, self.anchor = np.array(self.rows)[seg], heads + shift, tails + shift, anchor[heads] + shift
        self.hash, self.at, self.until = hashes[anchor[heads]], heads, tails
        return len(heads) > 0

    def text(self, first: int, last: int) -> bytes:
        """The bytes of elements first .. last of this chunk."""
        return self.joined[self.starts[first] : self.ends[last]]


def chunks(texts: list[str | None], width: int, words: bool) -> Iterator[Chunk]:
    now = Chunk(words)
    for row, text in enumerate(texts):
        data = (text or "").encode()
        if words:
            items = data.split()
            n, step = len(items), CHUNK // 8
        else:
            n, step = len(data), CHUNK
        if n < width:
            continue
        for base in range(0, n - width + 1, step):
            part = items[base : base + step + width - 1] if words else data[base : base + step + width - 1]
            piece = b" ".join(part) if words else part
            if now.parts and now.size + len(piece) > CHUNK:
                yield now
                now = Chunk(words)
            now.add(row, base, piece, len(part))
    if now.parts:
        yield now


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, did, tie, text) of docs(doc_id, text): did is doc_id with null as the largest, tie tells rows of equal
    doc_id apart by their text. Rows that repeat both count as one document."""
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("tie"), "text")


def batches_of(batches, limit: int = 2000):
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            yield batch.slice(at, limit)


def count_anchors(rows: DataFrame, width: int, gram: int, words: bool) -> DataFrame:
    """(hash, n): how often each anchor occurs in rows of `keyed`; only those that occur again are kept."""
    def run(batches):
        for batch in batches_of(batches):
            for chunk in chunks(batch.column("text").to_pylist(), width, words):
                if chunk.find(width, gram):
                    h, n = np.unique(chunk.hash, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "n"])

    each = rows.select("text").mapInArrow(run, "hash long, n long")
    return each.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")


def bitmap(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes' lowest bits, about 16 bits for each of n hashes within the bounds; and its bits' exponent.
    Only its fixed-size rows come to the driver."""
    exponent = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, 16 * n)))))
    place = F.expr(f"hash & {(1 << exponent) - 1}L").alias("place")
    rows = hashes.select(place).groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << (exponent - 3), np.uint8)
    for b, bits in rows.toLocalIterator():
        at = (b - 1) * 4096 if b else 0  # Spark counts buckets and bits from place 1; place 0 shares the first bit
        out[at : at + 4096] |= np.frombuffer(bytes(bits), np.uint8)
    return out, exponent


def test_bits(bits: np.ndarray, exponent: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << exponent) - 1)
    place -= (place > 0).astype(np.uint64)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pieces(rows: DataFrame, width: int, gram: int, words: bool, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Pass 1 and pass 2: (pieces, single windows or None).

    pieces: hash, did, tie, anchor (place in the document), offset (of the anchor in the piece), windows, piece.
    Single windows, of anchors with more than `hot` occurrences: did, tie, start, piece.
    """
    spark = rows.sparkSession
    again = stage(count_anchors(rows, width, gram, words), "anchors")
    n, most = again.agg(F.count("*"), F.max("n")).first()
    seen = spark.sparkContext.broadcast(bitmap(again, n))
    over = spark.sparkContext.broadcast(bitmap(again.where(F.col("n") > hot), 1 << 10)) if (most or 0) > hot else None

    def reader(singles: bool) -> Callable:
        def run(batches):
            for batch in batches_of(batches):
                did, tie = batch.column("did").to_numpy(), batch.column("tie").to_numpy()
                for chunk in chunks(batch.column("text").to_pylist(), width, words):
                    if not chunk.find(width, gram):
                        continue
                    good = test_bits(*seen.value, chunk.hash)
                    if over is not None:
                        good &= test_bits(*over.value, chunk.hash) == singles
                    g = np.flatnonzero(good)
                    if not len(g):
                        continue
                    row = chunk.row[g]
                    if singles:
                        many = chunk.last[g] - chunk.first[g] + 1
                        k = np.repeat(np.arange(len(g)), many)
                        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        at = (chunk.at[g][k] + step).tolist()
                        yield pa.RecordBatch.from_arrays([pa.array(did[row][k]), pa.array(tie[row][k]), pa.array(chunk.first[g][k] + step), pa.array([chunk.text(a, a + width - 1) for a in at], pa.binary())], names=["did", "tie", "start", "piece"])
                    else:
                        texts = [chunk.text(a, b + width - 1) for a, b in zip(chunk.at[g].tolist(), chunk.until[g].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(chunk.hash[g].view(np.int64)), pa.array(did[row]), pa.array(tie[row]), pa.array(chunk.anchor[g]), pa.array(chunk.anchor[g] - chunk.first[g]), pa.array(chunk.last[g] - chunk.first[g] + 1), pa.array(texts, pa.binary())], names=["hash", "did", "tie", "anchor", "offset", "windows", "piece"])
        return run

    source = rows.select("did", "tie", "text")
    made = source.mapInArrow(reader(False), "hash long, did long, tie long, anchor long, offset long, windows long, piece binary")
    return made, None if over is None else stage(source.mapInArrow(reader(True), "did long, tie long, start long, piece binary"), "windows")


def groups_in_order(batches, least: int):
    """Tables of whole groups: batches sorted by hash are cut and joined to `least` rows and a change of hash."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches_of(batches, least):
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        h = table.column("hash").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of each run of True in a 2-D array."""
    padded = np.zeros((marked.shape[0], marked.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marked
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of (start, end) spans, as sorted disjoint maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without spans, documents with a column spans): only texts that may have spans are shuffled.

    spans: did, tie, start, end. A bitmap of the documents with spans, of bounded size, decides which are read in place.
    """
    per_doc = stage(spans.groupBy("did", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    exponent = bits_for(per_doc.count())
    marked = maybe(rows, ["did", "tie"], bitmap_of(per_doc.select("did", "tie"), exponent), exponent)
    none, some = marked.where("not _may").select(*rows.columns), marked.where("_may").select(*rows.columns)
    met = some.join(per_doc.withColumnsRenamed({"did": "_d", "tie": "_t"}).hint("merge"), (F.col("did") == F.col("_d")) & (F.col("tie") == F.col("_t")), "left")
    return none, met.select(*rows.columns, "spans")
