"""Product codes of vectors: one codebook for each part of the components, trained by whole-table rounds of integer k-means.

Nearest entries are found by exponion search. A part starts at the entry that it had in the round before; the nearest
entry can lie no farther from that one than twice the part's distance to it, so only the head of that entry's list of
neighbours, sorted by distance, is scanned. Distances are squared and exact integers (the radius is four times the
squared distance), bounds are inclusive, and ties go to the lower index, so the result is that of a full scan.

Codebooks are bounded by their parameters (entries x components) and are all that passes the driver: sums and counts of
the entries are added up in each task and then by Spark. Each round's codes are written beside the integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, pick, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that a task scores at once.
CHUNK = 4096


def limit_for(width: int) -> int:
    """Largest integer component at which sums of `width` squared differences, and four times them, fit 64 bits."""
    return 1 << ((60 - (width - 1).bit_length()) // 2 - 1)


def quantised(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the rows whose vector has only finite components, and the number of integers in x."""
    rows = pick(vectors, "vec_id", "label", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    least, most = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    width = max(1, -(-(most or 0) // parts)) * parts
    limit = limit_for(width)
    x = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(limit)), F.lit(-limit)).cast("int"))
    if least is not None and least < width:
        x = F.concat(x, F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")), width


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Exponion:
    """Nearest entries of codebooks [part, entry, component]: each entry's neighbours sorted by distance, then index."""

    def __init__(self, books: np.ndarray):
        self.parts, self.entries, self.size = books.shape
        apart = squares(books[:, :, None], books[:, None])
        order = np.argsort(apart, axis=2, kind="stable")
        self.near = order.reshape(-1, self.entries)
        self.radius = np.take_along_axis(apart, order, 2).reshape(-1, self.entries)
        self.flat = books.reshape(-1, self.size)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances [row, part] of the entries nearest to x[row, part * component]."""
        x, shape = x.reshape(-1, self.size), start.shape
        first = np.tile(np.arange(self.parts) * self.entries, shape[0])
        index = start.reshape(-1).astype(np.int64)
        at = first + index
        best = squares(x, self.flat[at])
        reach, live = 4 * best, np.arange(len(x))
        for j in range(self.entries):
            live = live[self.radius[at[live], j] <= reach[live]]
            if not len(live):
                break
            other = self.near[at[live], j]
            d = squares(x[live], self.flat[first[live] + other])
            better = (d < best[live]) | ((d == best[live]) & (other < index[live]))
            best[live[better]], index[live[better]] = d[better], other[better]
        return index.reshape(shape), best.reshape(shape)


def components_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def codes_of(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    joined = b"".join(batch.column("code").to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(batch.num_rows, parts)


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows(vec_id, label, x[, code]) with code, the nearest entries as one byte for each part, and error. Starts at the code given, else at entry 0."""
    search, width, parts = Exponion(books), books.shape[0] * books.shape[2], books.shape[0]
    started = "code" in rows.columns

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                start = codes_of(batch, parts) if started else np.zeros((batch.num_rows, parts), np.uint8)
                index, best = search.nearest(components_of(batch, width), start)
                codes = [c.tobytes() for c in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array(codes, pa.binary()), pa.array(best.sum(axis=1), pa.int64())], ["vec_id", "label", "x", "code", "error"]
                )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x", *(["code"] if started else [])).mapInArrow(run, f"vec_id long, label {kind}, x array<int>, code binary, error long")


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    parts, entries, size = books.shape

    def run(batches):
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x, at = components_of(batch, parts * size).reshape(-1, size), (codes_of(batch, parts) + np.arange(parts) * entries).reshape(-1)
            counts += np.bincount(at, minlength=len(counts))
            for c in range(size):  # exact: a batch's sums stay below 2**53
                sums[:, c] += np.bincount(at, x[:, c], len(counts)).astype(np.int64)
        used = np.repeat(np.flatnonzero(counts), size)
        place = np.tile(np.arange(size), len(used) // size)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(place), pa.array(counts[used]), pa.array(sums[used, place])], ["at", "place", "n", "s"])

    added = rows.select("x", "code").mapInArrow(run, "at long, place long, n long, s long").groupBy("at", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = books.reshape(-1, size).copy()
    for r in added.collect():  # at most entries x components
        new[r["at"], r["place"]] = int(r["s"]) // r["n"]
    return new.reshape(books.shape)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> dict:
    """Codebooks of vectors(vec_id, embedding, label), and the code of each vector.

    Returns `codebooks`, integers as an array [part, entry, component], and `codes`, a DataFrame with vec_id, label, code
    (hex, two digits for each part) and error (squared distance of the integers, summed over the parts), a row for each
    row whose vector has only finite components; rows whose vector is null or holds a null or non-finite component are
    dropped. Components become floor(scale * x). At most 256 entries.

    Odd cases: the first entries are the smallest vec_ids, null ids last, rows of one id ordered by their integers;
    fewer vectors than entries give as many entries as vectors, an empty table an empty result. Lengths that parts don't
    divide, and vectors shorter than the longest one, are filled with zeros. Integers beyond `limit_for` the width
    (2**26 at 64 components) become that limit, so that all sums are exact. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have a byte for each part: 1 to 256 entries")
    rows, width = quantised(vectors, parts, scale)
    first = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not first:
        return {"codebooks": np.zeros((parts, 0, width // parts), np.int64), "codes": rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))}
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        rows = stage(assigned(rows, books), "codes")
        books = moved(rows, books)
    return {"codebooks": books, "codes": stage(assigned(rows, books).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "coded")}


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """The codes with label_error, the sum of error over equal labels (nulls are equal), and the digest of the codebooks.

    The sums are looked up by label, so that a label of very many rows isn't shuffled as one; a sum beyond 64 bits is null.
    """
    found = vector_codes(vectors)
    codes = found["codes"].withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = codes.groupBy("group").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    out = lookup(codes, sums, ["group"], "n", codes.count(), F.xxhash64("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(found["codebooks"])).alias("codebooks_sha256"))
