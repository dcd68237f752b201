"""Near copies of the pipeline against brute force over all pairs."""

import itertools
import random

import numpy as np

from tidegraph.llm import common, near_copies, simhash


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark):
    rnd = random.Random(4)
    word = lambda: "w%d" % rnd.randrange(4000)
    line = [word() for _ in range(12)]
    rows = [None, "", "one two", "One two"]
    for size in (8, 25, 60, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)] + line
            rows.append(" ".join(base))
            for changes in (1, 1, 2, 3, 5):
                copy = list(base)
                for at in rnd.sample(range(len(copy)), min(changes * size // 80 + 1, 9)):
                    copy[at] = word()
                rows.append(" ".join(copy + [word()] * rnd.randrange(3)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets, prints = [brute_set(t) for t in rows], [simhash.fingerprint((t or "").encode()) for t in rows]
    missed = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        close, both = (prints[a] ^ prints[b]).bit_count() <= 4, len(sets[a] & sets[b])
        same = both and 5 * both >= 4 * len(sets[a] | sets[b])
        missed += bool(same and not close)
        if close or same:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert missed > 20  # op4's links alone do not do
    got = near_copies.keep_one_copy(df)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(k) for k in range(len(rows))})
    assert near_copies.keep_one_copy(df.limit(0)).count() == 0


def test_sketches_of_long_texts():
    """Sketches grow with their sets, so they still rule out long texts that have little in common; they bound the difference."""
    rnd = np.random.default_rng(3)
    for n in (0, 1, 40, 900, 5000, 20_000):
        x = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        for m, shared in ((n, 0.0), (n, 0.7), (n, 0.9), (n + n // 5, 1.0)):
            y = np.union1d(x[: int(shared * n)], rnd.integers(0, 1 << 63, m - int(shared * n)).astype(np.uint64))
            only, d = len(np.setxor1d(x, y)), near_copies.bits_apart(near_copies.sketch(x), near_copies.sketch(y))
            assert d <= only and d % 2 == only % 2
            if n >= 900 and shared <= 0.7:  # a similarity of 0.54 at most
                assert 9 * d > len(x) + len(y)


def test_few_shingles_are_shuffled(spark):
    """Texts with nothing in common shuffle no shingle but a few; each shared one of a prefix is shuffled by all that hold it."""
    texts = [" ".join("t%dw%d" % (k, j) for j in range(200)) for k in range(60)] + [" ".join("same%d" % j for j in range(60)) + " x%d" % k for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = near_copies.prefixes(df, none, len(texts)).collect()
    want = {}
    for k, t in enumerate(texts):
        for s in near_copies.prefix(near_copies.shingle_set(t.encode()), none).tolist():
            want.setdefault(s, set()).add(k)
    several = {(s, k) for s, ks in want.items() if len(ks) > 1 for k in ks}
    assert several and several <= {(r["k"] % (1 << 64), r["h"]) for r in got} and len(got) < len(several) + 50


def test_large_group_gives_few_pairs(spark, monkeypatch):
    """Texts that are not quite alike but share most shingles are not written as pairs; those that are alike all come out."""
    rnd = random.Random(9)
    base, rows = ["b%d" % j for j in range(150)], []
    for k in range(70):
        copy = list(base)
        for at in rnd.sample(range(10, 140), 4):
            copy[at] = "x%d" % rnd.randrange(10**9)
        rows.append(" ".join(copy))
        if k % 7 == 0:  # one more word: alike
            copy[rnd.randrange(5)] = "y%d" % k
            rows.append(" ".join(copy))
    sets, prints = [brute_set(t) for t in rows], [simhash.fingerprint(t.encode()) for t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(k) for k in range(len(rows))}) > 50
    written, materialise = [], near_copies.materialise

    def counted(df, name, *more):
        out = materialise(df, name, *more)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    got = near_copies.keep_one_copy(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(k) for k in range(len(rows))})
    assert sum(written) < 5 * len(rows)  # all pairs are 3,160


def test_batches_of_texts_are_small(spark, monkeypatch):
    """What Python gets of the texts at once stays near SLICE_BYTES, and the session's own limit is as before."""
    read, most = near_copies.raw_texts, 2 * common.SLICE_BYTES

    def checked(batch):
        held = batch.column("text").buffers()[2]  # of the whole batch, not of the slice alone
        assert held is None or held.size <= most, held.size
        return read(batch)

    monkeypatch.setattr(near_copies, "raw_texts", checked)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    rows = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 5000), x -> cast(x * (id div 2 + 1) as string)), ' ') as text")
    assert near_copies.near_copies(rows).select("component").distinct().count() == 200
    assert spark.conf.get(limit) == before
