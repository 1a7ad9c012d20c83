"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into cells of about equal frequency; the Hilbert index
of a row's cells orders the rows, and the order is cut into runs. A shard so
covers a compact region of all dimensions at once, and a file's minima and
maxima prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialise

#: Rows of one cell that a task should have to order: a cell is ordered in parts, as many as all rows would need if they were in it.
ROWS_PER_SALT = 500_000
LEAST_SALTS = 32


def hilbert_index(cells: Column, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of ``cells``, an array of ``dims`` integers of ``bits`` bits.

    Skilling's transform (AIP Conf. Proc. 707, 2004) as folds: undo excess
    work level by level, Gray-encode, then interleave the bits.
    """
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in levels for i in range(dims)])

    def undo(x: Column, s: Column) -> Column:
        own, first = F.get(x, s["i"]), F.get(x, F.lit(0))
        flip = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(s["q"] - 1)
        return F.transform(
            x,
            lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(s["q"] - 1)).otherwise(v)).otherwise(F.when(s["i"] == 0, v).otherwise(F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))),
        )

    x = F.aggregate(steps, cells, undo) if levels else cells
    gray = lambda y: F.transform(y, lambda _, j: F.aggregate(F.slice(y, 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    turn = lambda y: F.aggregate(F.array(F.lit(0), *[F.lit(q) for q in levels]), F.lit(0), lambda t, q: F.when(F.element_at(y, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    final = lambda y: F.transform(y, lambda v: v.bitwiseXOR(turn(y)))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
    woven = lambda y: F.aggregate(places, F.lit(0), lambda a, p: a * 2 + F.call_function("getbit", F.get(y, p["i"]), p["b"]).cast("int"))
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return bound(x, lambda y: bound(gray(y), lambda g: bound(final(g), woven)))


def string_cuts(df: DataFrame, value: Column, n: int) -> list[str]:
    """The quantile cuts at 1/n to (n-1)/n of a string column without nulls, by whole values.

    Counts by value are dealt out by ranges; a range's first rank is the sum of
    the ranges below it, so only sums a range and the cuts come to the driver.
    """
    counts = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranges = materialise(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    # parts are numbered in the order of their values
    sums = sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(x for _, x in sums)
    if not total:
        return []
    below, firsts = 0, []
    for part, x in sums:
        firsts.append((part, below))
        below += x
    starts = F.broadcast(df.sparkSession.createDataFrame(firsts, "part int, below long"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reach = ranges.join(starts, "part").select("v", "n", upto.alias("upto"))
    # a value is a cut when a multiple of total / n lies within its ranks
    step = lambda x: F.floor(x * n / total)
    return [r["v"] for r in reach.where((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (step(F.col("upto") - F.col("n")) < n - 1)).select("v").orderBy("v").toLocalIterator()]


def quantised(df: DataFrame, dims: list[Column], bits: int) -> Column:
    """Array of the cell of each dimension: how many of the dimension's quantile cuts lie below the value.

    Only ``2**bits - 1`` cuts a dimension come to the driver.
    """
    n = 1 << bits
    text = [_is_text(df, d) for d in dims]
    numbers = {i: d for i, d in enumerate(dims) if not text[i]}
    cuts = df.select(*[F.percentile_approx(d, [k / n for k in range(1, n)], 10_000).alias(f"d{i}") for i, d in numbers.items()]).first() if numbers else None

    def cell(value: Column, own: list) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in own]), lambda cut: cut < value)) if own else F.lit(0)

    return F.array(*[cell(d, string_cuts(df, d, n) if text[i] else sorted(set(cuts[f"d{i}"] or []))) for i, d in enumerate(dims)])


def _is_text(df: DataFrame, value: Column) -> bool:
    return isinstance(df.select(value).schema[0].dataType, StringType)


def shard_by_curve(df: DataFrame, dims: list[Column], n_shards: int, bits: int = 4, tie: Column | None = None) -> DataFrame:
    """Adds shard and slot: ``df``'s rows in curve order, cut into ``n_shards`` runs at most one row apart.

    ``dims``: numeric or string columns, null taken as below all. Strings are
    compared whole. Within a cell rows are ordered by a hash of ``tie`` and then
    ``tie`` itself (default: every column). slot numbers a shard's rows from 0
    without gaps. Rows that are equal in ``dims`` and ``tie`` share an order
    that is arbitrary among them; the numbers remain gapless. An empty table
    gives no rows. Other columns are carried along; they must not be named
    shard or slot.

    The ranks come from counts by cell and hash part. A cell has as many parts
    as the whole table would need (``ROWS_PER_SALT``), so no task sorts more
    than about that, even if one cell holds most rows.
    """
    for name in ("shard", "slot"):
        if name in df.columns:
            raise ValueError(f"the input has a column {name}")
    if not 1 <= bits * len(dims) <= 16:
        raise ValueError("bits times dimensions must be from 1 to 16")
    spark = df.sparkSession
    dims = [F.coalesce(d, F.lit("")) if _is_text(df, d) else F.coalesce(d.cast("double"), F.lit(float("-inf"))) for d in dims]
    all_cells = 1 << (bits * len(dims))
    parts = F.array(*[F.shiftright(F.col("id"), bits * i).bitwiseAND((1 << bits) - 1).cast("int") for i in range(len(dims))])
    table = [r[1] for r in sorted(spark.range(0, all_cells, 1, 1).select("id", hilbert_index(parts, len(dims), bits)).collect())]
    cell = F.aggregate(F.reverse(quantised(df, dims, bits)), F.lit(0), lambda a, c: a * (1 << bits) + c)
    tie = F.struct(*df.columns) if tie is None else tie
    total = df.count()
    salts = max(LEAST_SALTS, -(-total // ROWS_PER_SALT))
    keyed = df.withColumns({"__order": F.get(F.lit(table), cell), "__tie": tie}).withColumn("__salt", F.pmod(F.xxhash64("__tie"), F.lit(salts)))
    counts = keyed.groupBy("__order", "__salt").count()
    by_order = counts.groupBy("__order").agg(F.sum("count").alias("rows"))
    order_first = by_order.select("__order", F.coalesce(F.sum("rows").over(Window.orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__order").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__order", "__salt", F.coalesce(F.sum("count").over(within), F.lit(0)).alias("__inner")).join(order_first, "__order").select("__order", "__salt", (F.col("__before") + F.col("__inner")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__order", "__salt").orderBy("__tie")) - 1
    ranked = keyed.withColumn("__rank", rank).join(offsets, ["__order", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    # a whole-number division by way of decimals would lose speed; products stay below 2**63 for any table
    shard = F.floor((F.col("__rank") * n_shards) / F.lit(max(total, 1))) if total < (1 << 50) // n_shards else F.expr(f"(__rank * {n_shards}) div {total}")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__rank") - first).select(*df.columns, "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Writes sharded rows as Parquet, a folder for each shard, rows in slot order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
