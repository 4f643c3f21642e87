"""Distributed LSD radix sort: a position for every row by stable counting-sort passes.

Rows stand in blocks of consecutive positions. A pass takes one digit of the key, the least
significant first: it counts the digits of each block, turns the counts into the first place
of each (digit, block) by prefix sums over the blocks, and sends each row to that place plus
its rank among the rows of its digit in its block. Blocks hold the same number of rows after
every pass, whatever the keys are, so equal keys and hot digits cost no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.session import saved, shared_dir

#: Bits of a digit at most; a pass collects the totals of its 2 ** DIGIT_BITS digits.
DIGIT_BITS = 11
#: Rows of a block: 2 ** BLOCK_BITS, or more where that makes over MOST_BLOCKS blocks.
BLOCK_BITS, MOST_BLOCKS = 12, 1 << 16


def digits_of(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """The digits of the composite key ``keys`` (long column, descending), least significant
    first. A key takes as many digits as the range of its values needs."""
    ends = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c, _ in keys for f in (F.min, F.max))).first()
    out = []
    for name, descending in reversed(keys):
        low, high = ends[f"min_{name}"], ends[f"max_{name}"]
        if high - low < 1 << 63:
            value = F.lit(high) - F.col(name) if descending else F.col(name) - F.lit(low)
            bits = (high - low).bit_length()
        else:  # the difference does not fit: unsigned order of all 64 bits
            value = F.col(name).bitwiseXOR(F.lit((1 << 63) - 1 if descending else -(1 << 63)))
            bits = 64
        n = -(-bits // DIGIT_BITS)
        width = -(-bits // n) if n else 0
        out += [
            F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(n)
        ]
    return out


def counting_pass(rows: DataFrame, digit: Column, block_bits: int, always: bool) -> DataFrame | None:
    """``rows`` (block, pos, ...) in stable order of ``digit``, at positions from 0 without gaps.

    None if all rows have one digit, in which case nothing moves, unless ``always``.
    """
    spark = rows.sparkSession
    tagged = rows.withColumn("__digit", digit)
    counts = saved(
        tagged.groupBy("block", "__digit").agg(F.count("*").alias("__n")), shared_dir(spark, "radix-count")
    )
    totals = sorted((r[0], r[1]) for r in counts.groupBy("__digit").agg(F.sum("__n")).collect())
    if len(totals) < 2 and not always:
        return None
    first, bases = 0, []
    for value, n in totals:
        bases.append((value, first))
        first += n
    base = F.broadcast(spark.createDataFrame(bases, "__digit int, __base long"))  # 2 ** DIGIT_BITS rows at most
    earlier = Window.partitionBy("__digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .join(base, "__digit")
        .select("block", "__digit", (F.col("__base") + F.col("__before")).alias("__first"))
    )
    rank = F.row_number().over(Window.partitionBy("block", "__digit").orderBy("pos"))
    moved = (
        tagged.withColumn("__rank", rank)
        .join(places, ["block", "__digit"])
        .withColumn("pos", F.col("__first") + F.col("__rank") - 1)
        .withColumn("block", F.shiftright("pos", block_bits))
        .select(*rows.columns)
    )
    return saved(moved, shared_dir(spark, "radix-pass"))


def positions(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in the order of ``keys`` (long column without
    nulls, descending), as a stored table. Rows with equal keys get different places next to
    each other. No rows in, no rows out; columns named block or pos are replaced.
    """
    spark = rows.sparkSession
    rows = saved(rows.drop("block", "pos"), shared_dir(spark, "radix-rows"))
    n = rows.count()
    if not n:
        return rows.withColumn("pos", F.lit(0).cast("long"))
    bits = max(BLOCK_BITS, (n // MOST_BLOCKS).bit_length())
    started = rows.withColumn("pos", F.monotonically_increasing_id())
    rows = saved(started.withColumn("block", F.shiftright("pos", bits)), shared_dir(spark, "radix-pass"))
    digits = digits_of(rows, keys) or [F.lit(0)]
    for i, digit in enumerate(digits):
        rows = counting_pass(rows, digit, bits, i == len(digits) - 1) or rows
    return rows.drop("block")
