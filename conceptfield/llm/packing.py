"""Best-fit packing of tokenised documents into fixed-length sequences by swap-based local search.

Documents are tokenised where they are read; the pieces (a few numbers each) are dealt by hash into groups of bounded
size. A group starts with its pieces in the order they come, each bin filled until the next piece doesn't fit. The
local search then takes the least full bins one after another and moves documents out of them to where they fit best,
or exchanges one for one, two for one or one for two with other underfull bins, each step raising the sum of squared
fills, until bins are empty. It ends at the lower bound or when a round over all underfull bins finds no step. The
waste of a group is a bin or so, so with groups of tens of thousands of pieces the whole stays within a fraction of a
thousandth of one global packing.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, stage

#: Chunks of which a worker process remembers the ids, beside those of the texts at hand: about 60 MB.
CACHE = 300_000
#: Bytes of text that are encoded at a time, if they are of more than one document.
PART = 3_000_000
#: Characters that end a chunk and are tokens apart from the word before them.
ENDS = b".,;:!?"
#: Bytes by what chunks need to know: 1 white space, 2 a lower-case letter or digit, 4 a mark that ends a chunk.
KINDS = bytes(1 if c in b" \t\n\v\f\r" else 2 if c in b"abcdefghijklmnopqrstuvwxyz0123456789" else 4 if c in ENDS else 0 for c in range(256))
#: The characters by which byte-level BPE writes bytes: those without a print of their own follow U+0100.
BYTES = "".join(map(chr, [*range(256, 289), *range(33, 127), *range(289, 323), *range(161, 173), 323, *range(174, 256)]))
#: Words of Latin letters that lower case and composition leave as they are, in UTF-8.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def combining(data: bytes) -> bool:
    """May hold one of U+0300 .. U+036F (UTF-8 begins them with these bytes), the marks that compose with ASCII letters."""
    return b"\xcc" in data or b"\xcd" in data


def chunks(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' white-space separated chunks one after another, and where each text's begin, and the last one's end.

    Where neither composition nor the names of special tokens can tell, ASCII letters are lower-cased, and an end mark after a
    letter or digit begins a chunk, so that fewer different chunks have to be known.
    """
    whole = [combining(t) or b"<|" in t for t in texts]
    data = b"\n".join([t if w else t.lower() for t, w in zip(texts, whole, strict=True)] + [b""])
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    marked = np.zeros(len(kind), bool)
    marked[1:] = (kind[1:] == 4) & (kind[:-1] == 2)
    for i in np.flatnonzero(whole):
        marked[begin[i] : begin[i + 1]] = False
    solid = kind != 1
    first = solid.copy()
    first[1:] &= (kind[:-1] == 1) | marked[1:]
    at = np.flatnonzero(first)
    held = np.frombuffer(data, np.uint8)[solid]  # chunks without what lies between
    ends = np.append(np.cumsum(solid)[at] - 1, len(held)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(held)])
    return found.dictionary_encode(), np.searchsorted(at, begin)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by way of their white-space separated chunks.

    The tokenizer's pre-tokenisation never crosses white space, so a text's ids are its chunks' ids in order; ids of
    chunks are remembered, which makes common words cheap.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.word = self.bytes = None
        if plan["model"].get("end_of_word_suffix") and {"type": "Lowercase"} in (plan["normalizer"] or {}).get("normalizers", []):
            # For plain lower-case words normalisation changes nothing and each word is one unit: the model alone is asked.
            self.word = self.tokenizer.model.tokenize
            self.bytes = [i.to_bytes(4, "little") for i in range(max(plan["model"]["vocab"].values()) + 1)]

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One encoder for each worker process and path."""
        store = sys.modules.setdefault("_conceptfield_process", types.ModuleType("_conceptfield_process"))
        encoders = store.__dict__.setdefault("encoders", {})
        if path not in encoders:
            encoders[path] = cls(path)
        return encoders[path]

    def plain(self, words: dict[bytes, bytes]) -> set[bytes]:
        """Remembers the ids of those chunks that are plain words in lower case, and returns them."""
        known, ask, data, found = self.known, self.word, self.bytes, set()
        if ask:
            is_plain, decode = PLAIN.fullmatch, codecs.charmap_decode
            for c, low in words.items():
                if is_plain(low):
                    known[c] = b"".join([data[t.id] for t in ask(decode(low, "strict", BYTES)[0])])
                    found.add(c)
        return found

    def learn(self, new: set[bytes]) -> None:
        """Remembers the ids of new chunks. One that is a word and end marks is put together from both."""
        known, whole, split = self.known, set(), []
        for c in new - self.plain({c: c for c in new}):
            base = c.lower().rstrip(ENDS)
            # A mark is a token apart only after what normalisation leaves a letter or digit: it may end in a combining sign.
            if b"<|" in c or combining(c) or not base or base == c or not (base[-1:].isalnum() or base[-1] > 127 and unicodedata.normalize("NFC", base.decode()[-1].lower()).isalpha()):
                whole.add(c)
            else:
                tail = c[len(base) :]
                split.append((c, base, tail))
                whole.update(x for x in (base, tail) if x and x not in known)
        whole = list(whole - self.plain({c: c.decode().lower().encode() for c in whole}))
        for e in range(0, len(whole), 20_000):
            part = whole[e : e + 20_000]
            for c, got in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False), strict=True):
                known[c] = np.array(got.ids, "<u4").tobytes()
        for c, base, tail in split:
            known[c] = known[base] + (known[tail] if tail else b"")

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        found, begin = chunks([(t or "").encode() for t in texts])
        all_ = found.dictionary.to_pylist()
        new = set(all_).difference(self.known)
        if len(self.known) + len(new) > CACHE:  # what these texts share with earlier ones stays
            self.known = {c: self.known[c] for c in all_ if c not in new}
        self.learn(new)
        ids = list(map(self.known.__getitem__, all_))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length) - length
        which = found.indices.to_numpy(zero_copy_only=False)
        each = length[which]
        end = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(start[which] - end[:-1], each) + np.arange(end[-1])]
        return [out[a:b].tobytes() for a, b in itertools.pairwise(end[begin].tolist())]


def parted(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """The batch in slices of texts of about PART bytes together."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PART
    if not batch.num_rows:
        return []
    cuts = [0, *(np.flatnonzero(end[1:] != end[:-1]) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in itertools.pairwise(cuts)]


def pieces(docs: DataFrame, capacity: int = 2048, end: int = 0, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text): each document's ids, then the id `end`,
    cut into pieces of `capacity` only if it is longer."""
    path, width = tokenizer or default_tokenizer(), 4 * capacity

    def run(batches):
        encoder = Encoder.shared(path)
        for whole in batches:
            for batch in parted(whole):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                    ids += end.to_bytes(4, "little")
                    for k in range(0, len(ids), width):
                        part = ids[k : k + width]
                        row.append(i)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int64))
                out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out, names = [*out, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    docs = pick(docs, "doc_id", "text")
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    return docs.mapInArrow(run, T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * keep_ids))


def next_fit(size: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes, filled in the order of the items."""
    bins: list[list[int]] = []
    room = -1
    for i, n in enumerate(size):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


def lower_bound(size: list[int], capacity: int) -> int:
    """Bins that any packing needs: for each k, documents over half a bin have one each, and those of k up to half a bin
    need what space is left beside the ones that k fits beside."""
    n = np.bincount(np.asarray(size, np.int64), minlength=capacity + 1)
    number, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    beside = number[capacity - k] - number[half]
    space = capacity * beside - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    return int((number[capacity] - number[half] + np.maximum(0, -(-(small - space) // capacity))).max()) if size else 0


class Bin:
    """Documents by size, with the amounts that one or two of them sum to as bits of integers."""

    __slots__ = ("docs", "fill", "reach", "sums")

    def __init__(self, items: list[int], size: list[int]):
        self.docs: dict[int, list[int]] = {}
        self.fill = 0
        for i in items:
            self.docs.setdefault(size[i], []).append(i)
            self.fill += size[i]
        self.sums = self.reach = None

    def amounts(self) -> tuple[int, int]:
        """Bits of what one document or none amounts to, and of what up to two do."""
        if self.sums is None:
            one = 1
            for n in self.docs:
                one |= 1 << n
            both = one
            for n, held in self.docs.items():
                both |= (one if len(held) > 1 else one ^ (1 << n)) << n
            self.sums = (one, both)
        return self.sums

    def parts(self, amount: int) -> tuple[int, ...]:
        """Sizes of the one or two documents that sum to amount."""
        if amount in self.docs or not amount:
            return (amount,) if amount else ()
        return next((n, amount - n) for n in self.docs if amount - n in self.docs and (2 * n != amount or len(self.docs[n]) > 1))

    def reached(self, room: int) -> tuple[int, int]:
        """Bits of what may come in for one document of this bin or none, and for up to two, if up to room, its free space, is gained."""
        if self.reach is None:
            self.reach = tuple(raised(x, room) for x in self.amounts())
        return self.reach

    def pop(self, sizes: tuple[int, ...]) -> list[int]:
        out = []
        for n in sizes:
            held = self.docs[n]
            out.append(held.pop())
            if not held:
                del self.docs[n]
            self.fill -= n
        self.sums = self.reach = None
        return out

    def push(self, items: list[int], sizes: tuple[int, ...]) -> None:
        for i, n in zip(items, sizes, strict=True):
            self.docs.setdefault(n, []).append(i)
            self.fill += n
        self.sums = self.reach = None

    def items(self) -> list[int]:
        return [i for held in self.docs.values() for i in held]


def raised(bits: int, room: int) -> int:
    """Bits of all sums of a set bit's place and 1 .. room."""
    out, have = bits << 1, 1
    while 2 * have <= room:
        out, have = out | out << have, 2 * have
    return out | out << (room - have)


def exchange(a: Bin, b: Bin, room: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The exchange of one for one, two for one or one for two, or the move, that shifts the largest net amount, at most
    room, from a to b: the sizes that leave a and those that leave b. Empty if there is none."""
    (one, both), (less, more), (near, far) = a.amounts(), b.amounts(), b.reached(room)
    best, leave, enter = 0, 0, 0
    for gives, takes in ((one & far, more), (both & ~one & near, less)):
        while gives and best < room:
            n = gives.bit_length() - 1
            gives ^= 1 << n
            least = max(0, n - room)
            rest = takes >> least
            amount = least + (rest & -rest).bit_length() - 1  # the least amount that makes the net fit
            if n - amount > best:
                best, leave, enter = n - amount, n, amount
    return a.parts(leave), b.parts(enter)


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Empties underfull bins, the least full first; ends at the lower bound or when a round finds no step.

    Each step shifts a net amount to a bin that is at least as full, which raises the sum of squared fills, so the
    search ends. Bins are found by their free space, of bins with the same space the one that got it last.
    """
    bound = lower_bound(size, capacity)
    now = [Bin(b, size) for b in bins]
    while len(now) > bound:
        steps = 0
        now.sort(key=lambda b: b.fill)
        spaces: list[dict[Bin, None]] = [{} for _ in range(capacity + 1)]  # underfull bins by free space
        open_ = 0
        for b in now:
            if b.fill < capacity:
                spaces[capacity - b.fill][b] = None
                open_ |= 1 << (capacity - b.fill)
        slack = capacity * len(now) - sum(size)

        def place(b: Bin, was: int):
            nonlocal open_
            del spaces[was][b]
            if not spaces[was]:
                open_ &= ~(1 << was)
            if (space := capacity - b.fill) and b.fill:
                spaces[space][b] = None
                open_ |= 1 << space

        left, stuck = len(now), set()
        for a in now:
            if left <= bound or not 0 < a.fill < capacity or slack - (capacity - a.fill) < a.fill:
                continue
            if (kind := a.amounts()) in stuck:
                continue
            moved = True
            while a.fill and moved:
                moved = False
                for n in sorted(a.docs, reverse=True):  # moves, to the fullest bin with room
                    while n in a.docs:
                        fits = open_ >> n
                        b = None
                        while fits and b is None:
                            space = n + (fits & -fits).bit_length() - 1
                            b = next((x for x in reversed(spaces[space]) if x is not a), None)
                            fits &= fits - 1
                        if b is None or b.fill + n <= a.fill:
                            break
                        was, mine = capacity - b.fill, capacity - a.fill
                        b.push(a.pop((n,)), (n,))
                        place(b, was)
                        place(a, mine)
                        moved, steps = True, steps + 1
                if not a.fill:
                    break
                todo, (one, both) = open_, a.amounts()
                while todo and a.fill:  # exchanges, with the fullest bins first
                    space = (todo & -todo).bit_length() - 1
                    todo &= todo - 1
                    for b in list(spaces[space]):
                        reach = b.reach or b.reached(space)
                        if not (one & reach[1] or both & reach[0]) or b is a or b.fill < a.fill:
                            continue
                        leave, enter = exchange(a, b, space)
                        if leave:
                            mine = capacity - a.fill
                            out, back = a.pop(leave), b.pop(enter)
                            b.push(out, leave)
                            a.push(back, enter)
                            place(b, space)
                            place(a, mine)
                            moved, steps = True, steps + 1
                            if not a.fill:
                                break
                            one, both = a.amounts()
            if a.amounts() == kind:
                stuck.add(kind)  # nothing has changed
            else:
                stuck.clear()
            if not a.fill:
                left, slack = left - 1, slack - capacity
        now = [b for b in now if b.fill]
        if not steps:
            break
    return [b.items() for b in now]


def best_fit(size: list[int], capacity: int) -> list[list[int]]:
    """Bins of best fit decreasing: each document, the largest first, goes to the fullest bin with room."""
    bins: list[list[int]] = []
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    open_ = 0
    for i in sorted(range(len(size)), key=size.__getitem__, reverse=True):
        fits = open_ >> size[i]
        if fits:
            space = size[i] + (fits & -fits).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                open_ ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if rest := space - size[i]:
            spaces[rest].append(b)
            open_ |= 1 << rest
    return bins


def searched(size: list[int], capacity: int) -> list[list[int]]:
    """The search from bins in the order of arrival; if that ends above the lower bound, once more from those of best fit
    decreasing, and the better of both: never more bins than best fit decreasing."""
    found = local_search(next_fit(size, capacity), size, capacity)
    if len(found) > lower_bound(size, capacity):
        found = min(found, local_search(best_fit(size, capacity), size, capacity), key=len)
    return found


def pack(items: DataFrame, capacity: int = 2048, per_group: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to items, which have a length of 1 .. capacity."""
    rows = stage(items.withColumn("_item", F.monotonically_increasing_id()), "items")  # stored, so that numbers stay
    groups = max(1, round(rows.count() / per_group))
    whole = rows.where(F.col("length") == capacity).select(*items.columns, (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(pdf):
        pdf = pdf.sort_values("_item", ignore_index=True)
        size = pdf["length"].tolist()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s, b in enumerate(searched(size, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = s, at
                at += size[i]
        return pd.DataFrame({"item": pdf["_item"], "sequence_id": (int(pdf["g"].iloc[0]) << 32) + sequence, "offset": offset})

    part = rows.where(F.col("length") < capacity)
    found = part.select("_item", "length", F.pmod(F.xxhash64("_item"), F.lit(groups)).alias("g")).groupBy("g").applyInPandas(run, "item long, sequence_id long, offset long")
    return whole.unionByName(part.join(found, F.col("_item") == F.col("item")).select(*items.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, end: int = 0, tokenizer: str | None = None, per_group: int = 20_000, keep_ids: bool = False) -> DataFrame:
    """Packs docs(doc_id, text) into sequences of at most `capacity` ids.

    Returns one row for each piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids with keep_ids. A null text is empty and gives one piece that holds the end id alone; repeated rows are packed
    one by one; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
    """
    return pack(pieces(docs, capacity, end, tokenizer, keep_ids), capacity, per_group)
