"""Generated keys, values and access patterns; the same seed gives the same rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, *key: Column) -> Column:
    """A uniform number in [0, 1) from a hash of the row's key: no order, no state."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)


def uniform(low: Column | int, high: Column | int, point: Column) -> Column:
    """A whole number in [low, high] from a point in [0, 1)."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (F.floor(point * (high - low + 1)) + low).cast("long")


def uniform_except(low: int, high: int, banned: Column, point: Column) -> Column:
    """As uniform(), but never the banned number."""
    value = uniform(low, high - 1, point)
    return F.when(value >= banned, value + 1).otherwise(value)


def digits(count: int, seed: int, *key: Column) -> Column:
    return F.lpad(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10**count)).cast("string"), count, "0")


def letters(count: Column, seed: int, *key: Column) -> Column:
    """So many letters and digits from a digest of the key, repeated where it is short."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *key), 512)
    return F.substring(F.repeat(digest, F.ceil(count / 128).cast("int")), F.lit(1), count.cast("int"))


def zipf_table(spark: SparkSession, keys: int, theta: float) -> DataFrame:
    """key, low, high: the part of [0, 1) that each of ``keys`` ranks takes."""
    weights = 1.0 / np.arange(1, keys + 1) ** theta
    high = np.cumsum(weights) / weights.sum()
    low = np.concatenate([[0.0], high[:-1]])
    return spark.createDataFrame(pd.DataFrame({"key": np.arange(keys), "low": low, "high": high}))


def zipf(keys: int, theta: float, point: Column) -> Column:
    """A Zipf-distributed rank in [0, keys) from a point, by inverting the bounding
    integral; accurate to the integral's approximation of the sum, for any number of keys."""
    if math.isclose(theta, 1.0):
        value = F.exp(point * math.log(keys + 0.5) + (1 - point) * math.log(0.5)) + 0.5
    else:
        a = 1 - theta
        span, base = (keys + 0.5) ** a - 0.5**a, 0.5**a
        value = F.pow(point * span + base, F.lit(1 / a)) + 0.5
    return F.least(F.greatest(F.floor(value), F.lit(1)), F.lit(keys)).cast("long") - 1


def gamma_sizes(shape: float, mean: float, seed: int):
    """A function of a key column: gamma-distributed whole sizes of at least 1."""

    @F.pandas_udf("bigint")
    def size(key: pd.Series) -> pd.Series:
        out = [max(1, int(np.random.default_rng((seed, int(k))).gamma(shape, mean / shape))) for k in key]
        return pd.Series(out)

    return size


def permutation(keys: int, seed: int, key: Column) -> Column:
    """A bijection of [0, keys): an affine map by a step coprime to it."""
    step = (0x9E3779B1 + 2 * seed) % keys or 1
    while math.gcd(step, keys) != 1:
        step += 1
    return F.pmod(key * step + seed % keys, F.lit(keys))


@dataclass
class Zone:
    """A share of accesses that goes to a share of pages in some way."""

    access: float
    pages: float
    kind: str = "uniform"


def parse_zones(spec: str) -> list[Zone]:
    """Zones of ``s<access> f<pages> <kind>`` triples, e.g. "s0.9 f0.1 uniform s0.1 f0.9 uniform"."""
    parts = spec.split()
    if not parts or len(parts) % 3:
        raise ValueError("zones are triples of s<share>, f<fraction> and a kind")
    zones = []
    for s, f, kind in zip(parts[::3], parts[1::3], parts[2::3]):
        if not (s.startswith("s") and f.startswith("f")) or kind not in ("uniform", "sequential"):
            raise ValueError(f"not a zone: {s} {f} {kind}")
        zones.append(Zone(float(s[1:]), float(f[1:]), kind))
    if not math.isclose(sum(z.access for z in zones), 1) or not math.isclose(sum(z.pages for z in zones), 1):
        raise ValueError("the shares of all zones add up to 1")
    return zones


def access_pattern(spark: SparkSession, count: int, pages: int, kind: str, seed: int = 1, theta: float = 0.6, zones: str = "") -> DataFrame:
    """n, pid: ``count`` page accesses, sequential, uniform, by zones or Zipf (shuffled)."""
    rows = spark.range(count).withColumnRenamed("id", "n")
    point = draw(seed, F.col("n"))
    if kind == "sequential":
        return rows.withColumn("pid", F.pmod(F.col("n"), F.lit(pages)))
    if kind == "uniform":
        return rows.withColumn("pid", uniform(0, pages - 1, point))
    if kind == "zipf":
        return rows.withColumn("pid", permutation(pages, seed, zipf(pages, theta, point)))
    if kind != "zones":
        raise ValueError(f"no pattern {kind}")
    case, reached, start = F, 0.0, 0
    inner = draw(seed + 1, F.col("n"))
    for zone in parse_zones(zones):
        size = max(1, round(zone.pages * pages))
        reached += zone.access
        within = uniform(0, size - 1, inner) if zone.kind == "uniform" else F.pmod(F.col("n"), F.lit(size))
        case = case.when(point < reached, F.least(within + start, F.lit(pages - 1)))
        start += size
    return rows.withColumn("pid", case.otherwise(pages - 1).cast("long"))
