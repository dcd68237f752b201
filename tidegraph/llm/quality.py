"""Quality by importance resampling.

Two generative models over hashed n-grams (words, marks, and pairs of neighbours): one of the target, fitted on the
good rows of a bounded labelled sample, one of the raw corpus, counted over every row. The log of a text's importance
weight is the sum of the log ratios of all its n-grams; with standard Gumbel noise added, the k highest keys are a draw
of k texts without replacement, in proportion to their weights. k is given, or else estimated: a trial model is fitted
on one half of the sample, the cut that best tells good rows from bad ones is chosen on the other half, and k is how
many rows of the corpus clear it.

Counts have a fixed number of buckets, so what is shuffled and sent is bounded per task and in all. The k-th key is
found by counting keys in ever finer bins; no sort of all rows and no row leaves its partition for it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import materialise, raw_texts, slices, table

BUCKETS = 1 << 16
#: Labelled rows in all; one half of them fits the trial model, the other chooses the cut.
SAMPLE = 20_000
#: Occurrences, in the raw model's proportions, that the target model adds to each bucket: a bucket that the sample lacks
#: is no proof against a text unless the raw text holds much of it.
PRIOR = 50.0
#: How many bad rows kept weigh as much as one good row lost (as shares of their class) when the cut is chosen.
CARE = 3.0
SEED = 17
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")
CACHE = 300_000


class Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[token] = zlib.crc32(token)
        return h


def ngrams(text: bytes, cache: Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the tokens and of the pairs of neighbours of a text; marks count in runs, letters in lower case.

    A token after itself is one n-gram whatever the token (bucket 0): which word repeats says little, that one does much.
    """
    tokens = TOKEN.findall(text.lower())
    h = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    same = h[:-1] == h[1:]
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    rest = np.uint64(buckets - 1)
    return np.concatenate([h % rest + np.uint64(1), np.where(same, np.uint64(0), pairs % rest + np.uint64(1))]).astype(np.int64)


def bucket_counts(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of n-grams over all rows, over rows whose id is in `good` (bounded: it is broadcast), and over those of them with fit."""
    marked = docs.select("doc_id", "text").join(F.broadcast(good.select("doc_id", F.when(F.col("fit"), 2).otherwise(1).alias("part"))), "doc_id", "left").select("text", F.coalesce("part", F.lit(0)).alias("part"))

    def run(batches):
        cache, sums = Hashes(), np.zeros((3, buckets), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                for text, row in zip(raw_texts(part), part.column("part").to_pylist(), strict=True):
                    got = np.bincount(ngrams(text, cache, buckets), minlength=0)
                    sums[: row + 1, : len(got)] += got
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), **{f"n{k}": pa.array(sums[k, at]) for k in range(3)}})

    got = marked.mapInArrow(run, "bucket long, n0 long, n1 long, n2 long").groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)]).toArrow()
    out = np.zeros((3, buckets))
    out[:, got.column("bucket").to_numpy()] = [got.column(f"n{k}").to_numpy() for k in range(3)]
    return out


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    p = (raw + 1e-3) / (raw + 1e-3).sum()
    q = p * (target + prior) / (target.sum() * p + prior)
    return np.log(q / q.sum()) - np.log(p)


def gumbel(doc_id, text: bytes, seed: int) -> float:
    """Standard Gumbel noise from the row and the seed alone, so that a repeated task draws the same."""
    h = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(str(doc_id), seed))
    return float(-np.log(-np.log(((h >> 11) + 0.5) / (1 << 53))))


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight with the least of CARE times the share of good rows lost and the share of bad rows kept; midway between the rows around it."""
    if not len(weight) or good.all():
        return -np.inf
    if not good.any():
        return np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    value = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum() - CARE * np.concatenate([[0], np.cumsum(g)]) / g.sum()
    value[1:-1][w[1:] == w[:-1]] = -np.inf
    k = int(np.argmax(value))
    return -np.inf if k == 0 else np.inf if k == len(w) else float((w[k - 1] + w[k]) / 2)


def label_rows(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, good, fit) of at most `rows` labelled ids, those with the smallest hashes; of several labels the best counts. The rows with fit are for the trial model."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    few = one.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)
    return few.withColumn("fit", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(2)) == 0)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value of a materialised column of finite doubles, by counts in ever finer bins."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = rows.where(F.col(column).between(low, high))
        step = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / F.lit(step)), F.lit(bins - 1)) if step > 0 else F.lit(0)
        counts = {r["b"]: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        low, high = counts[b]["lo"], counts[b]["hi"]
        if counts[b]["n"] <= few:
            got = sorted((r[0] for r in rows.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return got[k - 1]
    return low


def weigh(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, seed: int = SEED):
    """The labelled sample, and a function that gives (n-grams, weight, trial weight, key) of each row of a slice."""
    spark = docs.sparkSession
    known = materialise(label_rows(labels, sample), "labels")
    raw, target, trial = bucket_counts(docs, known.where("good"), buckets)
    ratios = spark.sparkContext.broadcast((log_ratio(raw, target), log_ratio(raw, trial)))

    def work(part: pa.RecordBatch, cache: Hashes) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        texts = raw_texts(part)
        grams = [ngrams(t, cache, buckets) for t in texts]
        weight, tried = (np.array([r[g].sum() for g in grams]) for r in ratios.value)
        noise = np.array([gumbel(i, t, seed) for i, t in zip(part.column("doc_id").to_pylist(), texts, strict=True)])
        return [len(g) for g in grams], weight, tried, weight + noise

    return known, work


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """doc_id, n_grams, weight (log), key, selected of every row: the k highest keys are selected, ties all.

    Without k it is the number of rows whose trial weight clears the cut that labelled rows give; without labels of both
    kinds all rows do (or none, if only bad ones are known). A text without n-grams (null, empty, blank) has weight
    zero. Null labels count for nothing. Repeated rows get the same key and the same fate; null ids are weighed like
    any other. An empty table gives no rows. Columns other than doc_id, text and quality are ignored.
    """
    known, work = weigh(docs, labels, **options)

    def run(batches):
        cache = Hashes()
        for batch in batches:
            for part in slices(batch):
                n, weight, tried, key = work(part, cache)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "n_grams": pa.array(n, pa.int64()), "weight": pa.array(weight), "tried": pa.array(tried), "key": pa.array(key)})

    rows = materialise(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, weight double, tried double, key double"), "weights")
    return rows.drop("tried").withColumn("selected", F.col("key") >= F.lit(threshold(rows, known, k)))


def threshold(rows: DataFrame, known: DataFrame, k: int | None) -> float:
    """The least key that is selected."""
    if k is None:
        k = rows.where(F.col("tried") >= trial_cut(rows, known)).count()
    if k <= 0:
        return float("inf")
    n = rows.count()
    return float("-inf") if k >= n else float(kth_largest(rows, "key", k))


def trial_cut(rows: DataFrame, known: DataFrame) -> float:
    """The trial weight that best tells the labelled rows apart that the trial model has not seen (all of them, where those are of one kind)."""
    pairs = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.avg("tried").alias("tried"), F.first("good").alias("good"), F.first("fit").alias("fit")).select("tried", "good", "fit").toArrow()  # at most the sample
    tried, good, fit = (pairs.column(c).to_numpy(zero_copy_only=False) for c in ("tried", "good", "fit"))
    good, fit = good.astype(bool), fit.astype(bool)
    use = ~fit if len(set(good[~fit].tolist())) == 2 else np.ones(len(fit), dtype=bool)
    return best_cut(tried[use], good[use])


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """The rows of `docs` that `resample` selects, with all their columns, whatever their names.

    Null, empty and very long texts, null ids, ties and repeated rows fare as there; an empty table stays empty.
    """
    known, work = weigh(docs, labels, **options)
    taken = {c.lower() for c in docs.columns}
    extra = [next(n for i in range(len(taken) + 1) if (n := f"_{x}{i or ''}") not in taken) for x in ("tried", "key")]

    def run(batches):
        cache = Hashes()
        for batch in batches:
            for part in slices(batch):
                _, _, tried, key = work(part, cache)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tried), pa.array(key)], names=[*part.schema.names, *extra])

    rows = materialise(docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(x, T.DoubleType()) for x in extra]])), "weighed")
    edge = threshold(rows.select("doc_id", F.col(extra[0]).alias("tried"), F.col(extra[1]).alias("key")), known, k)
    return rows.where(F.col(extra[1]) >= edge).drop(*extra)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
