"""Order-aware digests of activity sequences that merge piece by piece.

The digest of a sequence is its length and four polynomial hashes

    h = sum over events of code(activity) * base ** position   (mod p)

with four bases and four primes below 2^31, 124 bits together.  Two pieces
``a`` then ``b`` join as ``h_a + h_b * base ** length_a``, which is associative,
so a case's digest comes from any cutting of the case into consecutive pieces:
each (case, time slice) yields one piece of a few numbers, and a case is a sum
over its slices.  No list and no text of a case exists anywhere; a case of any
length is a few numbers.

Products of two numbers below 2^31 stay below 2^62, so all arithmetic is plain
64-bit and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.sequence import order_columns, with_slice
from caseflow.schema import ACTIVITY, CASE, SLICE

# The four largest primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515249, 1140671487, 1220703129, 1540483477)
DIGITS, WIDTH = 4, 1024  # positions up to 2^40

PARTS = [f"h{k}" for k in range(len(PRIMES))]
KEY = ["d1", "d2", "n_events"]  # the packed digest: equal for equal sequences


def _powers(k: int, digit: int) -> Column:
    """``base ** (i * WIDTH ** digit)`` for i below ``WIDTH``: one literal array
    (the cast of a literal is folded when the plan is made)."""
    step = pow(BASES[k], WIDTH ** digit, PRIMES[k])
    values, value = [], 1
    for _ in range(WIDTH):
        values.append(str(value))
        value = value * step % PRIMES[k]
    return F.split(F.lit(",".join(values)), ",").cast("array<long>")


def _power(k: int, position: Column) -> Column:
    """``base ** position``; most positions have one digit, which costs one lookup."""
    def digit(d: int) -> Column:
        return F.get(_powers(k, d), F.shiftright(position, 10 * d).bitwiseAND(F.lit(WIDTH - 1)).cast("int"))

    p = F.lit(PRIMES[k])
    full = digit(0)
    for d in range(1, DIGITS):
        full = full * digit(d) % p
    return F.when(position < WIDTH, digit(0)).when(
        position < WIDTH ** 2, digit(0) * digit(1) % p).otherwise(full)


def _shifted_sum(value: Column, k: int, position: Column) -> Column:
    """Sum of ``value * base ** position``.  The sum of fewer than 2^32 numbers
    below 2^31 fits in 64 bits."""
    return F.sum(value * _power(k, position) % F.lit(PRIMES[k])) % F.lit(PRIMES[k])


def slice_digests(log: DataFrame, slice_hours: int = 24) -> DataFrame:
    """One piece for each case and time slice: ``case_id, ts_slice, n, h0..h3``."""
    log = with_slice(log, slice_hours).select(CASE, SLICE, ACTIVITY, *order_columns()[:2])
    w = Window.partitionBy(CASE, SLICE).orderBy(*order_columns())
    # 32 bits of a code are reduced by each prime; a code is never 0
    codes = F.xxhash64(ACTIVITY)
    ev = log.select(CASE, SLICE, codes.alias("_c1"), F.xxhash64(ACTIVITY, F.lit(1)).alias("_c2"),
                    (F.row_number().over(w) - 1).cast("long").alias("_i"))
    code = lambda k: F.pmod(F.col("_c1" if k < 2 else "_c2"), F.lit(PRIMES[k] - 1)) + 1
    return ev.groupBy(CASE, SLICE).agg(
        F.count(F.lit(1)).alias("n"),
        *[_shifted_sum(code(k), k, F.col("_i")).alias(PARTS[k]) for k in range(len(PRIMES))])


def combine_digests(pieces: DataFrame, group: list | tuple = (CASE,), order: str = SLICE) -> DataFrame:
    """Pieces of each group joined in the order of ``order``: ``n, h0..h3``.
    Any consecutive pieces can be combined first and the results again."""
    group = list(group)
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.groupBy(*group).agg(
        F.sum("n").alias("n"),
        *[_shifted_sum(F.col(PARTS[k]), k, F.col("_at")).alias(PARTS[k]) for k in range(len(PRIMES))])


def packed(digests: DataFrame, group: list | tuple = (CASE,)) -> DataFrame:
    """``d1, d2, n_events``: two hashes in each number."""
    two = lambda a, b: F.shiftleft(F.col(a), 31).bitwiseOR(F.col(b))
    return digests.select(*group, two("h0", "h1").alias("d1"), two("h2", "h3").alias("d2"),
                          F.col("n").alias("n_events"))


def case_digests(log: DataFrame, slice_hours: int = 24) -> DataFrame:
    """``case_id, d1, d2, n_events``: equal for cases of the same variant."""
    return packed(combine_digests(slice_digests(log, slice_hours)))
