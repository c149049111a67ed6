"""What the training-data operators share: column picking, shared tables, skew-safe joins, components."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import clear_staged, is_heavy, lookup, shared_dir, stage  # noqa: F401

#: The white space of every contract here: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling, so that extra columns can't clash with ours.

    A name that occurs twice gives its first column; a name that is missing raises KeyError.
    """
    columns = list(df.columns)
    for n in names:
        if n not in columns:
            raise KeyError(f"no column {n!r} among {columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[plain[f"c{columns.index(n)}"].alias(n) for n in names])


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns numbered (c0, c1, ...), and the number of each name (its first column, by exact spelling).

    Names of ours can't clash with numbered ones, however df's columns are called; `toDF(*df.columns)` names them again.
    """
    names = list(df.columns)
    return df.toDF(*[f"c{i}" for i in range(len(names))]), {n: f"c{names.index(n)}" for n in names}


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Bits of a membership bitmap as a power of two: at least (4 KiB) and at most (64 MiB to broadcast).
LEAST_BITS, MOST_BITS = 15, 29


def bits_for(n: int) -> int:
    """The exponent of a bitmap for n keys: eight bits or more for each, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, 8 * n)))))


def bitmap_of(keys: DataFrame, exponent: int) -> DataFrame:
    """A bitmap over the hashes of whole rows of keys: (_bucket, _bits), at most 2**exponent bits."""
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(1 << exponent))
    at = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    return at.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def maybe(rows: DataFrame, keys: Sequence[str], bitmap: DataFrame, exponent: int) -> DataFrame:
    """Adds _may: false where the row's keys are surely not among those of the bitmap. Its size is bounded, so it is broadcast."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << exponent))
    at = rows.withColumn("_at", F.bitmap_bucket_number(place)).withColumn("_place", F.bitmap_bit_position(place))
    both = at.join(F.broadcast(bitmap), F.col("_at") == F.col("_bucket"), "left")
    byte = "cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int)"
    return both.select(*rows.columns, F.expr(f"coalesce(shiftright({byte}, cast(_place % 8 as int)) & 1, 0) = 1").alias("_may"))


def without(docs: DataFrame, dropped: DataFrame, key: Column | None = None) -> DataFrame:
    """docs whose key (doc_id by default) isn't among the values of dropped's one column, null being a value.

    Only rows that a bitmap lets through are shuffled, so that texts that stay are read in place. Columns may have any names.
    """
    rows, at = plain(docs)
    rows = rows.withColumn("key", F.col(at["doc_id"]) if key is None else key)
    ids = stage(dropped.toDF("gone").distinct(), "dropped")
    exponent = bits_for(ids.count())
    marked = maybe(rows, ["key"], bitmap_of(ids, exponent), exponent)
    sure, rest = marked.where("not _may"), marked.where("_may").join(ids.hint("merge"), F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return sure.unionByName(rest).drop("key", "_may").toDF(*docs.columns)


def keep_rows(docs: DataFrame, key: Column, dropped: DataFrame, several: DataFrame | None) -> DataFrame:
    """docs without the rows whose key (over `plain` columns) is in dropped; of rows with a key in several the first by their columns stays."""
    if several is None or several.isEmpty():
        return without(docs, dropped, key)
    rest = without(docs, dropped.toDF("k").unionByName(several.toDF("k")), key)
    rows, _ = plain(docs)
    same = rows.withColumn("key", key).join(several.toDF("k").hint("merge"), F.col("key").eqNullSafe(F.col("k")), "left_semi")
    nth = F.row_number().over(W.partitionBy("key").orderBy(*[c for c, t in rows.dtypes if "map<" not in t]))
    return rest.union(same.withColumn("nth", nth).where("nth = 1").drop("key", "nth").toDF(*docs.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, root) for every node of an edge, root its smallest reachable node.

    Alternating large-star and small-star rounds, each staged in the shared folder, until the edges stop changing.
    Minima are combined before the shuffle; AQE splits the joins of nodes with very many neighbours.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(down, F.col("a") == F.col("k"))
        moved = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(down.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    was = mark(now)
    while was[0]:
        now = stage(stars(now), "edges")
        if (new := mark(now)) == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
