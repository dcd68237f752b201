"""Comparison of two results: differences, ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_biased_overlap(a: list, b: list, p: float) -> float:
    """Extrapolated rank-biased overlap of two lists without repeats, which may differ in length (Webber, Moffat, Zobel 2010)."""
    short, long = sorted((list(a), list(b)), key=len)
    s, n = len(short), len(long)
    if not s:
        return 0.0
    overlap, seen_short, seen_long, at = 0, set(), set(), []
    for d in range(n):
        if d < s:
            overlap += (short[d] in seen_long) + (long[d] in seen_short) + (short[d] == long[d])
            seen_short.add(short[d])
        else:
            overlap += long[d] in seen_short
        seen_long.add(long[d])
        at.append(overlap)
    x_s, x_n = at[s - 1], at[-1]
    total = sum(x / d * p**d for d, x in enumerate(at, 1)) + sum(x_s * (d - s) / (s * d) * p**d for d in range(s + 1, n + 1))
    return (1 - p) / p * total + ((x_n - x_s) / n + x_s / s) * p**n


def top_list(scores: DataFrame, n: int, value: str = "score", key: str = "id") -> list:
    """The ids of the n highest values, ties to the smaller id: n rows reach the driver."""
    return [r[0] for r in scores.orderBy(F.desc(value), key).select(key).limit(n).collect()]


def top_n(scores: DataFrame, n: int, value: str = "score", key: str = "id") -> DataFrame:
    """(rank, key, value) of the n highest values."""
    top = scores.orderBy(F.desc(value), key).limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc(value), key)).cast("int").alias("rank"), key, value)  # over n rows


def differences(a: DataFrame, b: DataFrame, value: str, key: str = "id") -> DataFrame:
    """(key, l1): absolute differences of two results; an id that only one has counts its whole value."""
    x, y = a.select(key, F.col(value).alias("_x")), b.select(key, F.col(value).alias("_y"))
    return x.join(y, key, "full").select(key, F.abs(F.coalesce("_x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0))).alias("l1"))


def compare(a: DataFrame, b: DataFrame, value: str, key: str = "id") -> DataFrame:
    """One row: vertices, average, median, 95th percentile and maximum of the differences."""
    return differences(a, b, value, key).agg(
        F.count("*").alias("vertices"),
        F.avg("l1").alias("avg_l1"),
        F.percentile("l1", F.lit(0.5)).alias("median_l1"),
        F.percentile("l1", F.lit(0.95)).alias("p95_l1"),
        F.max("l1").alias("max_l1"),
    )


def picked_differences(a: DataFrame, b: DataFrame, value: str, ignore: int = 0) -> tuple[float, float]:
    """(median, 95th) of the differences by index: past `ignore` leading ones, at the middle and at 0.95 of the rest.

    An odd number of rows averages the middle two. Compatible with older reports; `compare` gives the usual ones.
    """
    l1 = differences(a, b, value)
    n = l1.count()
    if not n:
        return 0.0, 0.0
    middle, high = (n - ignore) // 2 + ignore, int((n - ignore) * 0.95) + ignore
    at = sorted({max(0, middle - 1), min(middle, n - 1), min(high, n - 1)})
    values = l1.agg(*[F.percentile("l1", F.lit(k / max(1, n - 1))).alias(f"p{k}") for k in at]).first()
    pick = {k: float(v) for k, v in zip(at, values, strict=True)}
    mid = pick[min(middle, n - 1)]
    return ((mid + pick[max(0, middle - 1)]) / 2 if n % 2 and n > 1 else mid), pick[min(high, n - 1)]


def overlap_report(a: DataFrame, b: DataFrame, value: str = "score") -> DataFrame:
    """One row as in an oracle comparison: average and 95th percentile of L1, overlap of the top 1000 (p 0.6) and 10 (p 0.5)."""
    stats = compare(a, b, value).select(F.col("avg_l1"), F.col("p95_l1"))
    x, y = top_list(a, 1000, value), top_list(b, 1000, value)
    return stats.select("avg_l1", "p95_l1", F.lit(rank_biased_overlap(x, y, 0.6)).alias("rbo6_1000"), F.lit(rank_biased_overlap(x[:10], y[:10], 0.5)).alias("rbo5_10"))
