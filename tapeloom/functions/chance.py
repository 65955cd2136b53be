"""Random numbers and tail probabilities as plain column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: a 32-bit mixing function whose products stay within 63 bits ----
WORD = 0xFFFFFFFF
STEPS = [(16, 0x7FEB352D), (15, 0x31848BAB), (16, 0x7FEB352D)]
BLOCK_STEP, REPLICATE_STEP = 0x1B873593, 0x27D4EB2F
# ---- fixed values: the normal distribution to double precision as a quotient of polynomials (Hart 1968) ----
NORMAL_TOP = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
NORMAL_BOTTOM = [
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
NORMAL_SPLIT = 7.07106781186547
# ---- end of fixed values ----


def with_counter_hash(df: DataFrame, name: str, block: Column, replicate: Column, seed: int = 0) -> DataFrame:
    """Adds a number of 32 even bits that depends on nothing but its arguments, so any task can draw it again.

    Blocks and replicates may be any whole numbers below 2^31.  Every step reads the one before twice, so each is a column of
    its own; in one expression they would double the code at every step.
    """
    step = lambda x, shift, factor: (x.bitwiseXOR(F.shiftrightunsigned(x, shift)) * factor).bitwiseAND(WORD)
    x = F.col(name)
    df = df.withColumn(name, (block.cast("bigint") * BLOCK_STEP).bitwiseAND(WORD)).withColumn(name, step(x, 15, REPLICATE_STEP))
    df = df.withColumn(name, (x + replicate.cast("bigint") * REPLICATE_STEP + seed).bitwiseAND(WORD))
    for shift, factor in STEPS:
        df = df.withColumn(name, step(x, shift, factor))
    return df.withColumn(name, x.bitwiseXOR(F.shiftrightunsigned(x, 15)))


def poisson_limits(mean: float = 1.0) -> list[int]:
    """``limits[k]``: the numbers of 32 bits from here on stand for more than k, until the chance is below one in 2^32."""
    limits, term, below, k = [], math.exp(-mean), 0.0, 0
    while (below := below + term) < 1 - 2.0**-33:
        limits.append(int(below * 2**32))
        k += 1
        term *= mean / k
    return limits


def poisson_weight(x: Column) -> Column:
    """How often a block is drawn: Poisson with mean 1 from a number of 32 even bits."""
    return reduce(lambda a, b: a + b, [(x >= limit).cast("int") for limit in poisson_limits()])


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to about 14 digits."""
    x = F.abs(z)
    horner = lambda terms: reduce(lambda a, b: a * x + b, terms[1:], F.lit(terms[0]))
    density = F.exp(x * x / -2.0)
    far = reduce(lambda a, k: x + F.lit(float(k)) / a, (4, 3, 2, 1), x + 0.65)
    tail = F.when(x < NORMAL_SPLIT, density * horner(NORMAL_TOP) / horner(NORMAL_BOTTOM)).otherwise(density / far / math.sqrt(2 * math.pi))
    return F.when(z < 0, 1.0 - tail).otherwise(tail)


def two_sided(z: Column) -> Column:
    """P(\\|Z\\| > \\|z\\|) of the standard normal."""
    return F.when(z.isNotNull(), F.least(2.0 * normal_tail(F.abs(z)), F.lit(1.0)))
