"""Near copies by the share of five-word shingles they have in common, without a missed pair.

Two sets of shingles with a Jaccard similarity of at least 4/5 share one of the first n - ceil(4n / 5) + 1 shingles of
either, in any order that is the same for all texts (prefix filter). Texts that share such a shingle are compared,
by sketches and then exactly, unless they are known to be linked. Shingles that a sample finds in many texts come last in the order; the
sample decides only how many pairs are compared, not which are found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.common import map_rows, materialise, raw_texts, shuffle_width, small_batches
from tidegraph.llm.simhash import _text_hash, best_of_each, first_row, near_duplicates, one_of_each, shingles
from tidegraph.operators.links import components
from tidegraph.plans.storage import drop

WORDS = 5
#: Least similarity, as a fraction, so that it is compared in integers.
ALIKE = 4, 5
#: About how many texts are looked at for common shingles, and most such shingles.
SAMPLE, COMMON = 10_000, 200_000
#: Places of the bitmap that tells which texts are compared; it goes to every task.
PLACES = 1 << 24
#: Least bits of the sketch of a set.
BITS = 512
#: Parts of the bitmap of shingles that stand in several texts.
SEGMENTS = 256
#: Shingles ahead of a shared one by which a pair that has met before is known, mostly.
AHEAD = 4


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingles(text, WORDS))


def common_shingles(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled texts, sorted, and in how many they stand. rows: of texts."""

    def work(part: pa.RecordBatch) -> dict:
        return {"s": pa.array([shingle_set(t).view(np.int64) for t in raw_texts(part)], pa.list_(pa.int64()))}

    some = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "h"), F.lit(rows // SAMPLE + 1)) == 0)
    seen = map_rows(some, ["text"], "s array<long>", work).select(F.explode("s").alias("s"))
    got = seen.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    s, n = got["s"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def prefix(shingled: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set that a similar set shares at least one of, in the order that is the same for all texts."""
    often, count = common
    if len(often):
        at = np.minimum(np.searchsorted(often, shingled), len(often) - 1)
        shingled = shingled[np.argsort(np.where(often[at] == shingled, count[at], 0), kind="stable")]
    return shingled[: len(shingled) - -(-ALIKE[0] * len(shingled) // ALIKE[1]) + 1]


def repeated(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap): a shingle that stands in the prefixes of two texts has the place of its lowest 32 bits' highest `bits` set.

    A few others have too, so the bitmap only spares shuffling most shingles that stand in one text. Tasks deal 4 bytes
    a shingle by SEGMENTS of the places. rows: of texts.
    """
    bits = min(max(16, (256 * rows).bit_length()), 28)  # 32 MB at most
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def work(part: pa.RecordBatch) -> dict:
        keys = [prefix(shingle_set(t), sent.value).astype(np.uint32) for t in raw_texts(part)]
        keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
        cuts = np.searchsorted(keys, np.arange(SEGMENTS + 1, dtype=np.uint64) * ((1 << 32) // SEGMENTS))
        return {"p": np.arange(SEGMENTS, dtype=np.int32), "z": pa.array([keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())}

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, z in zip(batch.column("p").to_pylist(), batch.column("z"), strict=True):
                held.setdefault(p, []).append(np.frombuffer(z.as_buffer(), np.uint32).copy())
        for p, parts in held.items():
            keys = np.sort(np.concatenate(parts))
            places = np.zeros((1 << bits) // SEGMENTS, dtype=bool)
            places[(keys[1:][keys[1:] == keys[:-1]] >> np.uint32(32 - bits)) - np.uint32(p * len(places))] = True
            yield pa.RecordBatch.from_pydict({"p": np.array([p], np.int32), "z": pa.array([np.packbits(places).tobytes()], pa.binary())})

    got = map_rows(texts, ["text"], "p int, z binary", work).repartition(shuffle_width(texts.sparkSession), "p").mapInArrow(merge, "p int, z binary").toArrow()
    out = np.zeros((SEGMENTS, (1 << bits) // SEGMENTS // 8), dtype=np.uint8)
    for p, z in zip(got.column("p").to_pylist(), got.column("z").to_pylist(), strict=True):
        out[p] = np.frombuffer(z, np.uint8)
    return bits, out.ravel()


def prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], rows: int) -> DataFrame:
    """(h, n, k, at): the shingles k of each text's prefix that another may share, their places and the size of its set."""
    sent = texts.sparkSession.sparkContext.broadcast((common, repeated(texts, common, rows)))

    def work(part: pa.RecordBatch) -> dict:
        common, (bits, places) = sent.value
        hs, keys, at, sizes = part.column("h").to_numpy(), [], [], []
        for t in raw_texts(part):
            s = shingle_set(t)
            sizes.append(len(s))
            s = prefix(s, common)
            place = s.astype(np.uint32) >> np.uint32(32 - bits)
            at.append(np.flatnonzero(places[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1))
            keys.append(s[at[-1]])
        many = np.array([len(k) for k in keys], dtype=np.int64)
        flat, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (at, np.int64)))
        return {"h": np.repeat(hs, many), "n": np.repeat(np.array(sizes, np.int32), many), "k": flat.view(np.int64), "at": at.astype(np.int32)}

    return map_rows(texts, ["h", "text"], "h long, n int, k long, at int", work)


def sketch(shingled: np.ndarray) -> np.ndarray:
    """For each of 2^i classes of shingles whether the set holds an odd number of them: two classes a shingle, at least BITS."""
    size = max(BITS, 1 << (2 * len(shingled) - 1).bit_length())
    return np.packbits((np.bincount((shingled & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.uint64)


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many classes two sketches differ, the finer one folded to the classes of the other."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(words: np.ndarray) -> np.ndarray:
    """The sketch in BITS classes."""
    while len(words) * 64 > BITS:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h")))


def of_named(named: DataFrame, texts: DataFrame, schema: str, work: Callable[[list[bytes]], dict]) -> DataFrame:
    """A row (h, columns that `work` makes of texts) for each text whose h is in `named`, and for a few more."""
    places = np.zeros(PLACES, dtype=bool)
    places[named.select(F.col("h").bitwiseAND(F.lit(PLACES - 1)).alias("h")).distinct().toPandas()["h"].to_numpy(np.int64)] = True
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(places))

    def run(part: pa.RecordBatch) -> dict:
        at = part.column("h").to_numpy() & (PLACES - 1)
        part = part.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))  # a few more pass; joins drop them
        return {"h": part.column("h"), **work(raw_texts(part))}

    return materialise(map_rows(texts, ["h", "text"], f"h long, {schema}", run).dropDuplicates(["h"]), "named")


def of_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, x_<c>, y_<c>): the pairs with the columns of both their texts."""
    of = lambda end, name: held.select(*[F.col(c).alias(end if c == "h" else f"{name}_{c}") for c in held.columns])
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", *[f"{x}_{c}" for x in "xy" for c in held.columns if c != "h"])


FOLDED = [f"w{k}" for k in range(BITS // 64)]


def sketches(named: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, n, s, w0, w1 ..): the size and sketch of the sets of the texts named, and the sketch in BITS classes, 64 a column."""

    def work(texts: list[bytes]) -> dict:
        sets = [shingle_set(t) for t in texts]
        held = [sketch(s) for s in sets]
        words = np.array([folded(s) for s in held], dtype=np.uint64).reshape(-1, len(FOLDED)).view(np.int64)
        return {"n": np.array([len(s) for s in sets], dtype=np.int64), "s": pa.array([s.tobytes() for s in held], pa.binary()), **{c: words[:, k].copy() for k, c in enumerate(FOLDED)}}

    return of_named(named, texts, "n long, s binary, " + ", ".join(f"{c} long" for c in FOLDED), work)


def plausible(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, d): the pairs whose sketches, d bits apart, allow similarity, an exact bound. held: sketches of their texts.

    Sketches differ in no more bits than there are shingles that only one set holds, and alike sets of n and m shingles
    have at most (n + m) / 9 of those. As long texts have long sketches, few other pairs pass.
    """

    def run(batches):
        for batch in batches:
            ends = zip(batch.column("x_s"), batch.column("y_s"), strict=True)
            d = np.array([bits_apart(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy)) for xy in ends], dtype=np.int64)
            n = batch.column("x_n").to_numpy() + batch.column("y_n").to_numpy()
            found = pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "d": d})
            yield found.filter(pa.array(d * sum(ALIKE) <= n * (ALIKE[1] - ALIKE[0])))

    return materialise(of_both(pairs, held.select("h", "n", "s")).mapInArrow(run, "a long, b long, d long"), "plausible")


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike, which the texts decide; compressed, they are a third of their sets."""

    def work(texts: list[bytes]) -> dict:
        return {"n": np.array([len(t) for t in texts], dtype=np.int64), "z": pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())}

    def run(batches):
        for batch in batches:
            keep, last = [], (None, None)
            for b, xn, xz, yn, yz in zip(*(batch.column(c) for c in ("b", "x_n", "x_z", "y_n", "y_z")), strict=True):
                x = shingle_set(pa.decompress(xz.as_buffer(), xn.as_py(), "zstd", asbytes=True))
                if last[0] != b.as_py():
                    last = b.as_py(), shingle_set(pa.decompress(yz.as_buffer(), yn.as_py(), "zstd", asbytes=True))
                both = len(np.intersect1d(x, last[1], assume_unique=True))
                keep.append(ALIKE[1] * both >= ALIKE[0] * (len(x) + len(last[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = of_named(ends(pairs), texts, "n long, z binary", work)
    out = materialise(of_both(pairs, held).mapInArrow(run, "a long, b long"), "alike")
    drop(held)
    return out


def possible(x: str, y: str):
    """Whether sizes and the places of a shared shingle leave room for similarity: exact bounds."""
    n, m, i, j = (F.col(f"{t}.{c}") for c in ("n", "at") for t in (x, y))
    top = F.least(i, j) + F.least(n - i, m - j)
    return (ALIKE[1] * F.least(n, m) >= ALIKE[0] * F.greatest(n, m)) & (sum(ALIKE) * top >= ALIKE[0] * (n + m))


def ready_to_meet(mixed: DataFrame, held: DataFrame) -> DataFrame:
    """mixed, its x with the sketch in BITS classes and `ahead`, the AHEAD shingles of `mixed` before k in the text's prefix."""
    order = Window.partitionBy("h").orderBy("x.at", "k")
    rows = mixed.withColumn("h", F.col("x.h")).join(held.select("h", *FOLDED), "h")
    rows = rows.withColumn("ahead", F.array_compact(F.array(*[F.lag("k", j).over(order) for j in range(1, AHEAD + 1)])))
    return rows.select("k", "root", "low", F.struct("x.*", "ahead", *FOLDED).alias("x"))


def meetings(ready: DataFrame) -> DataFrame:
    """(a, b), some several times: the pairs of different roots that share a shingle and may be alike, by exact bounds.

    ready: (k, x, root, low): the text x with the shingle k, its root, and the least root of any text with k. A bucket's
    texts of the root `low` are not paired among themselves. Sketches rule out most others where the texts meet, so a
    large group of texts that are not quite alike gives few rows. A pair that has one of the shingles ahead of k in
    common is left to that one's bucket: its first shared shingle has none, so no pair is lost.
    """
    other = ready.select("k", F.col("x").alias("y"), F.col("root").alias("other"))
    apart = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in FOLDED)
    near = apart * sum(ALIKE) <= (F.col("x.n") + F.col("y.n")) * (ALIKE[1] - ALIKE[0])
    met = ready.where("root <> low").join(other, "k").where("root <> other and (other = low or x.h < y.h)").where(possible("x", "y"))
    return met.where(near).where(~F.arrays_overlap("x.ahead", "y.ahead")).select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, h, component) of every row: rows are linked by op4's rule or by ALIKE of their five-word shingles."""
    prints, now = joined_copies(docs)
    return prints.join(now, "component").select("doc_id", "h", F.col("root").alias("component"))


def joined_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, component) of every row by op4's rule, and the (component, root) that near copies join.

    The links of op4 stay, as null and blank texts have no shingles. Shingles are taken as op4 takes them: lower case
    for A-Z, words between ASCII white space, a shorter text is one shingle. All jobs that work on texts end in here.
    """
    with small_batches(docs.sparkSession):
        return _joined_copies(docs)


def _joined_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    prints = materialise(near_duplicates(docs).select("doc_id", "h", "component"), "copies")
    texts = docs.select("doc_id", _text_hash().alias("h"), "text")  # exact copies of a text stay; they meet in one h
    label = materialise(prints.select("h", "component").distinct(), "label")
    rows, bucket = prints.count(), Window.partitionBy("k")
    starts = prefixes(texts, common_shingles(texts, rows), rows).repartition(shuffle_width(docs.sparkSession), "k").groupBy("k", "h").agg(F.min("n").alias("n"), F.min("at").alias("at"))
    shared = starts.select("k", F.struct("h", "n", "at").alias("x")).withColumn("pivot", F.min("x").over(bucket)).withColumn("last", F.max("x.h").over(bucket))
    shared = materialise(shared.where(F.col("pivot.h") < F.col("last")).drop("last"), "shared")
    of = lambda c, what: what.select(F.col("h").alias(c), F.col("root").alias(f"c{c}"))
    own = label.select("h", F.col("component").alias("root"))
    apart = lambda pairs, root: materialise(pairs.distinct().join(of("a", root), "a").join(of("b", root), "b").where("ca <> cb").select("a", "b"), "pairs")
    links = None

    def join_up(pairs: DataFrame) -> DataFrame:
        nonlocal links
        found = alike(pairs, texts)
        found = materialise(found.join(of("a", own), "a").join(of("b", own), "b").select("ca", "cb"), "links")
        links = found if links is None else links.union(found)
        root = components(links, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("root"))
        return materialise(label.select("component").distinct().join(root, "component", "left").select("component", F.coalesce("root", "component").alias("root")), "roots")

    # each text with the nearest first text of its buckets, then all pairs of a bucket that this has not joined
    pairs = apart(shared.where("x.h <> pivot.h").where(possible("pivot", "x")).select(F.col("pivot.h").alias("a"), F.col("x.h").alias("b")), own)
    held = sketches(shared.select("x.h"), texts)
    near = plausible(pairs, held)
    now = join_up(near.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b"))
    drop(pairs, near)
    root = materialise(label.join(now, "component").select("h", "root"), "root")
    mixed = shared.select("k", "x").join(root, F.col("x.h") == F.col("h")).select("k", "x", "root")
    mixed = mixed.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).where("low < high").drop("high")
    mixed = materialise(ready_to_meet(mixed, held), "mixed")
    drop(shared, root)
    pairs = materialise(meetings(mixed).distinct(), "pairs")
    drop(mixed)
    near = plausible(pairs, held)
    drop(held)
    now = join_up(near.select("a", "b"))
    drop(pairs, near)
    return prints, now


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """One row of each component of near_copies, chosen as op4's keep_one chooses it.

    The best row of each component of op4 goes on to its root, so a group of many copies meets in no task.
    """
    prints, now = joined_copies(docs.select("doc_id", "text"))
    return one_of_each(docs, best_of_each(prints).join(now, "component").groupBy("root").agg(first_row()))
