"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most `radius` of 64 bits agree on at least m - radius of m bands, so every way to
choose m - radius bands is a table whose buckets hold all links. Inside a bucket the fingerprints stand vertically:
word w of bit plane b holds bit b of 64 candidates. One row is compared with 64 candidates at once by adding the
planes it differs in to carry-save counters (one word per counter bit); a block is abandoned as soon as no candidate
of it is within the radius. What leaves a bucket is a spanning forest of its links, never all pairs, and the links of
all buckets meet in the component search.

Exact copies are one fingerprint before any comparison. A bucket past `block` rows is dealt as pairs of blocks, so no
task holds an unbounded group; m grows with the number of fingerprints, which keeps buckets small at any size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import map_rows, materialise, raw_texts, shuffle_width, table
from tidegraph.operators.links import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Most rows of a bucket that are compared in one piece.
BLOCK = 2048
#: Rows that a bucket should hold on average; the number of bands follows from it.
BUCKET = 16


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's word shingles in their order, repeats included."""
    parts = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    n = len(parts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    whole = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1) - 1
    k = min(words, n)
    begin = np.concatenate([[0], ends[: n - k] + 1]).tolist()
    end = ends[k - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter([one(whole[a:b], SEED) for a, b in zip(begin, end, strict=True)], dtype=np.uint64, count=n - k + 1)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits set in over half of the hashes of the text's word shingles (repeats included); no words: 0."""
    h = shingles(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, h): the fingerprint as a signed 64-bit integer and a hash of the text as it stands."""

    def work(part: pa.RecordBatch) -> dict:
        texts = raw_texts(part)
        fp = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
        return {"doc_id": part.column("doc_id").cast(pa.int64()), "fp": fp, "h": part.column("h")}

    return map_rows(docs.select("doc_id", "text", _text_hash().alias("h")), ["doc_id", "text", "h"], "doc_id long, fp long, h long", work)


def _text_hash():
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def band_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """One mask per table: the bits that links share. Any two fingerprints within the radius agree on one of them.

    From radius + 2 bands up to radius + 4: with 4 bits, 15 tables hold 40 million fingerprints, 35 hold 3 billion.
    """
    best = None
    for m in range(radius + 2, radius + 5):
        best = m
        if rows / 2 ** (64 * (m - radius) / m) <= BUCKET:
            break
    cuts = [round(64 * k / best) for k in range(best + 1)]
    bands = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(bands, best - radius)]


def planes_of(fp: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertical bit planes [64, words] and the mask of lanes in use; fingerprint i stands in lane[i] of word[i]."""
    planes = np.zeros((64, words), dtype=np.uint64)
    bit = np.uint64(1) << lane.astype(np.uint64)
    for b in range(64):
        np.bitwise_or.at(planes[b], word, np.where((fp >> np.uint64(b)) & np.uint64(1), bit, np.uint64(0)))
    used = np.zeros(words, dtype=np.uint64)
    np.bitwise_or.at(used, word, bit)
    return planes, used


def near_lanes(fp: np.ndarray, query: np.ndarray, word: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each (query row, word): the mask of the word's lanes within the radius. Returns the pairs that keep a lane."""
    live = np.arange(len(query))
    width = radius.bit_length() + 1  # counter bits; the last is sticky: over the range of the others
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    within = used[word]
    for b in range(64):
        q = (fp[query[live]] >> np.uint64(b)) & np.uint64(1)
        carry = planes[b][word[live]] ^ (np.uint64(0) - q)
        for k in range(width - 1):  # carry-save addition of one plane of differences to all lanes
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        counters[-1] |= carry
        if b % 4 == 3 or b == 63:
            over = counters[-1].copy()  # lanes whose count is past the radius
            more, equal = np.zeros_like(over), np.full_like(over, ones)
            for k in range(width - 2, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    more |= equal & counters[k]
                    equal &= ~counters[k]
            within = used[word[live]] & ~(over | more)
            stay = within != 0  # a block without a lane within the radius is abandoned
            if not stay.all():
                live, within = live[stay], within[stay]
                counters = [c[stay] for c in counters]
            if not len(live):
                break
    return live, within


def bucket_links(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join all rows linked inside each bucket; `bucket` numbers are sorted."""
    n = len(fp)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    sizes = np.diff(np.concatenate([starts, [n]]))
    several = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(several)
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_words = -(-sizes // 64)
    first = np.cumsum(n_words) - n_words
    inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lanes_at = np.zeros(n, dtype=np.int64)
    lanes_at[at] = np.repeat(first, sizes) * 64 + inner
    planes, used = planes_of(fp[at], lanes_at[at] // 64, lanes_at[at] % 64, int(n_words.sum()))
    row_at = np.zeros(int(n_words.sum()) * 64, dtype=np.int64)
    row_at[lanes_at[at]] = at
    per_row = np.repeat(n_words, sizes)
    rows, words = np.repeat(at, per_row), np.arange(int(per_row.sum())) - np.repeat(np.cumsum(per_row) - per_row, per_row) + np.repeat(np.repeat(first, sizes), per_row)
    keep = words * 64 + 63 > lanes_at[rows]  # a pair is seen once, from its earlier row
    rows, words = rows[keep], words[keep]
    a, b = [], []
    for at_pair in range(0, len(rows), 1 << 16):
        r, w = rows[at_pair : at_pair + (1 << 16)], words[at_pair : at_pair + (1 << 16)]
        live, mask = near_lanes(fp, r, w, planes, used, radius)
        r, w = r[live], w[live]
        own = lanes_at[r] // 64 == w  # lanes up to the row itself are the same pair or the row
        upto = (np.uint64(0xFFFFFFFFFFFFFFFF) << (lanes_at[r] % 64).astype(np.uint64)) << np.uint64(1)
        mask = np.where(own, mask & upto, mask)
        got = mask != 0
        r, w, mask = r[got], w[got], mask[got]
        hit = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        x, lane = np.nonzero(hit)
        x, lane = spanning(r[x], row_at[w[x] * 64 + lane], n) if len(x) > n else (r[x], row_at[w[x] * 64 + lane])
        a.append(x)
        b.append(lane)
    return np.concatenate(a), np.concatenate(b)


def spanning(a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace links by (row, least row of its component): at most one per row."""
    label = np.arange(rows)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(rows))
    return moved, label[moved]


def linked(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all fingerprints within the radius of each other. `distinct`: materialised, column fp."""
    spark = distinct.sparkSession
    masks = band_masks(distinct.count(), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for k, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > block).select("t", "k", F.ceil(F.col("n") / (block // 2)).cast("int").alias("parts"))
    sizes = materialise(sizes, "hot")  # buckets past a block: few, and none on even data
    if sizes.isEmpty():
        dealt = rows.select("fp", "t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:  # row of part p goes to the block pairs (p, q) and (q, p)
        with_parts = rows.join(sizes, ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        dealt = with_parts.select("fp", "t", "k", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select("fp", "t", "k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    deal = dealt.repartition(shuffle_width(spark), "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def compare(fp, bucket):
        a, b = bucket_links(fp, bucket, radius)
        a, b = spanning(a, b, len(fp))
        return pa.RecordBatch.from_pydict({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "t", "k", "i", "j")])
            if sum(len(h[0]) for h in held) < 8 * block:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0)
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if cut:
                yield compare(cols[0][:cut].view(np.uint64), np.concatenate([[0], np.cumsum(new)])[:cut])
            held = [[c[cut:] for c in cols]]
        if held and len(held[0][0]):
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0)
            yield compare(cols[0].view(np.uint64), np.concatenate([[0], np.cumsum(new)]))

    return deal.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, h, component, component_id) of every row: component_id is the smallest doc_id a chain of links reaches.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat are each
    returned. A null doc_id is a row like any other, but it names no component unless its whole component has none.
    An empty table gives no rows. Columns other than doc_id and text are ignored. `component` is the least
    fingerprint of the component, `h` a hash of the row's text.
    """
    prints = materialise(fingerprints(docs, words), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(linked(distinct.select("fp"), radius, block), "a", "b").select(F.col("id").alias("fp"), F.col("component").alias("root"))
    member = materialise(distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component")), "member")
    roots = member.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = member.join(roots, "component").select("fp", "component", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "h", "component", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of the smallest doc_id (nulls last), of those the smallest text hash.

    All columns pass through; of rows equal in doc_id and text one stays. Ids and hashes alone decide; the texts are
    shuffled once, to meet the decision.
    """
    return one_of_each(docs, best_of_each(near_duplicates(docs.select("doc_id", "text"), words, radius)))


def first_row(x: str = "x"):
    """The aggregate that keep_one chooses by, over structs (doc_id, h, n)."""
    return F.min_by(F.col(x), F.struct(F.col(f"{x}.doc_id").isNull().alias("none"), F.col(f"{x}.doc_id"), F.col(f"{x}.h"))).alias("x")


def best_of_each(found: DataFrame) -> DataFrame:
    """(component, x): the row (doc_id, h, n) of each component that keep_one names; found: (doc_id, h, component) of every row."""
    rows = found.groupBy("component", "doc_id", "h").agg(F.count("*").alias("n"))
    return rows.select("component", F.struct("doc_id", "h", "n").alias("x")).groupBy("component").agg(first_row())


def one_of_each(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows that the column x of `best` names, each once."""
    best = materialise(best.select(F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_h"), F.col("x.n").alias("_n")), "kept")
    taken = {c.lower() for c in docs.columns}
    h = next(n for i in range(len(taken) + 1) if (n := f"_text_h{i or ''}") not in taken)
    hashed = docs.withColumn(h, _text_hash())
    on = hashed["doc_id"].eqNullSafe(best["_id"]) & (hashed[h] == best["_h"])
    if best.where("_n > 1").isEmpty():
        return hashed.join(best, on, "left_semi").drop(h)
    once = hashed.join(best.where("_n = 1"), on, "left_semi")
    many = hashed.join(best.where("_n > 1"), on, "left_semi").dropDuplicates(["doc_id", h])
    return once.unionByName(many).drop(h)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
