"""Dense numbers and running sums over all rows, without a task that sees them all."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracegraph.store import saved


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with dense numbers from 1 in ``order``: places inside range partitions plus the counts before them, so that
    no task sees all rows."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())

    placed = saved(placed, "numbered")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(before), "_p").withColumn(name, (inside + F.col("_before")).cast("long")).drop("_p", "_before")  # a row a partition


def summed_before(df: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in ``order``: sums inside range partitions plus those of
    the partitions before, so that no task sees all rows."""
    placed = saved(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "summed")
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_n"))
    upto = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    before = sums.select("_p", F.coalesce(upto, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("_before")).drop("_p", "_before")  # a row a partition


def permuted(df: DataFrame, name: str, n: int, seed: int = 0) -> DataFrame:
    """``df`` with each number 0 to n - 1 in ``name`` taken to its place in a keyed permutation of these numbers.

    A Feistel network on pairs (left, right) of a x b >= n numbers, four rounds of md5. A place of n or more is taken on
    until it is less: there are fewer than a such places, so nearly all rows need one round. The work is that of the rows,
    however large n is: the i-th draw without repetition costs no draw before it.
    """
    if n <= 1:
        return df
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def turned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_l": F.expr(f"`{name}` div {b}"), "_r": F.col(name) % b})
        for k in range(4):
            to, by, most = ("_l", "_r", a) if k % 2 == 0 else ("_r", "_l", b)
            hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col(by).cast("string"))), 1, 13), 16, 10).cast("long")
            rows = rows.withColumn(to, (F.col(to) + hashed) % most)
        return rows.withColumn(name, F.col("_l") * b + F.col("_r")).drop("_l", "_r")

    done, left = [], saved(turned(df), "permuted")
    while True:
        done.append(left.where(F.col(name) < n))
        beyond = left.where(F.col(name) >= n)
        if beyond.isEmpty():
            break
        left = saved(turned(beyond), "permuted")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out
