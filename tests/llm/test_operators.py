"""The operators against brute force on small tables, and their defined results for odd rows."""

import itertools
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegraph.llm import chat, decontaminate, language_model, neighbours, packing, personal_data, quality, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, length int, word string"
RND = random.Random(11)
VOCAB = ["alpha", "beta", "gamma", "delta", "Über", "eins", "zwei", "idiot", "loser", "the", "of", "and", "x1", "日本"]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


BASE = [prose(n) for n in (30, 60, 5, 1, 200, 80, 45)]
ODD = [(None, None), (1, None), (2, ""), (2, ""), (3, " \t\n "), (None, BASE[0]), (4, BASE[0]), (5, BASE[0] + " end"), (6, "!!! ... ###"), (7, "word " * 30_000), (8, BASE[1]), (8, BASE[2]), (9, "a" * 50_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, "f", 3, "w") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD + [(100 + k, t) for k, t in enumerate(BASE)])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# 1


def brute_contamination(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[j : j + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for m in {len(x) for x in wins}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in wins:
                    hit |= set(range(p, p + m))
                    found |= wins[k]
        out.append((i, len(w), len(hit), len(found), longest_match(w, [words(x) for _, x in items], window)))
    return sorted(out, key=str)


def longest_match(w, items, window):
    best = 0
    for iw in filter(None, items):
        m = min(window, len(iw))
        at = {}
        for j in range(len(iw) - m + 1):
            at.setdefault(tuple(iw[j : j + m]), []).append(j)
        run = {}
        for p in range(len(w) - m + 1):
            run = {j: run.get(j - 1, m - 1) + 1 for j in at.get(tuple(w[p : p + m]), [])}
            best = max([best, *run.values()])
    return best


@pytest.mark.parametrize("block_bytes", [1 << 25, 1500])
def test_contamination(spark, odd, block_bytes):
    b = BASE[4].split()
    items = [(1, " ".join(b[10:40]).upper().replace("ÜBER", "Über")), (2, " ".join(b[30:45])), (3, "alpha Beta"), (None, BASE[1]), (5, None), (6, ""), (7, " ".join(b[12:17])), (2, " ".join(b[30:45]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_contamination(odd, bench, block_bytes=block_bytes).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], max([0, *(m["n_words"] for m in r["matches"])])) for r in got), key=str) == brute_contamination(rows, items)
    best = {m["item_id"]: m["n_words"] for r in got if r["doc_id"] == 104 for m in r["matches"]}
    assert best["1"] == 30 and best["2"] == 15
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r["contaminated"] for r in got)


@pytest.mark.parametrize("pairs", [1 << 21, 30])
def test_contamination_shared_passages(spark, monkeypatch, pairs):
    """Items that share a passage, and documents that repeat it; matches are those of brute force however few pairs are joined at a time."""
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rnd = random.Random(4)
    shared = prose(25, rnd)
    items = [(str(k), f"{prose(k % 4, rnd)} {shared} {prose(k % 7, rnd)}") for k in range(30)] + [("short", "alpha beta gamma")]
    rows = [(1, f"x {shared} y {shared} z {items[3][1]}"), (2, " ".join(shared.split()[:12])), (3, items[5][1] + " " + items[6][1]), (4, "alpha beta gamma alpha beta gamma"), (5, shared.split()[0])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(docs(spark, rows), bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], max([0, *(m["n_words"] for m in r["matches"])])) for r in got), key=str) == brute_contamination(rows, items)
    words = {i: t.split() for i, t in items}
    for r in got:
        w = dict(rows)[r["doc_id"]].split()
        assert len(r["matches"]) == r["n_items"]
        for m in r["matches"]:
            piece = words[m["item_id"]][m["item_start"] : m["item_start"] + m["n_words"]]
            assert [x.lower() for x in piece] == [x.lower() for x in w[m["doc_start"] : m["doc_start"] + m["n_words"]]]
            assert m["n_words"] == longest_match([x.lower() for x in w], [[x.lower() for x in words[m["item_id"]]]], 10)


def test_block_size():
    """A block of 8 MB of benchmark text stays small as an object, and blocks keep to the bytes they are given."""
    rnd = random.Random(6)
    lexicon = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9))) for _ in range(60_000)]
    items = [(k, " ".join(rnd.choices(lexicon, k=1000)).encode()) for k in range(1150)]
    assert sum(len(t) for _, t in items) > 7_500_000
    size = [len(pickle.dumps(b)) for b in decontaminate.build_blocks(items, 10, 1 << 30)]
    assert len(size) == 1 and size[0] < 40_000_000
    cut = [len(pickle.dumps(b)) for b in decontaminate.build_blocks(items, 10, 10_000_000)]
    assert len(cut) > 2 and max(cut) <= 10_000_000


def test_contamination_empty(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(odd, bench).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0


# 2


def test_packing(spark, odd, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(odd, sequence=64, keep_ids=True).collect()
    want = Counter()
    for r in odd.collect():
        want[(r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]))] += 1
    by = {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= 64 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by.setdefault((r["sequence_id"]), []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(k[1]) * n for k, n in want.items())
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    single = {k: v for k, v in want.items() if sum(n for (i, _), n in want.items() if i == k[0]) == 1}
    for (i, ids), _ in single.items():
        mine = sorted((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in got if r["doc_id"] == i)
        assert [x for _, p in mine for x in p] == list(ids)
    assert packing.pack(empty).count() == 0


def test_histogram_packing():
    rnd = random.Random(1)
    for _ in range(20):
        h = {rnd.randint(1, 64): rnd.randint(1, 500) for _ in range(rnd.randint(1, 30))}
        assert packing.check_patterns(packing.pack_histogram(h, 64), h, 64)


def test_word_ids():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    parts = ["a", "É", "Σ", "ß", "İ", "Å", "e\u0301", " ", "\n", "\t", " ", ".", ",", "'s", "12", "ǅ", "the", "!!", "一", "é", "$$", "&", ":'", "#"]
    assert words.plain
    for _ in range(2000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(words.of(t), "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


# 3


def test_chain_marginals():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(toxicity.BUCKETS), 0.0, rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(3))
    score, first = rng.normal(size=17), np.zeros(17, bool)
    first[[0, 5, 6]] = True
    p, _ = field.marginals(score, first)
    for a, b in ((0, 5), (5, 6), (6, 17)):
        z, m = 0.0, np.zeros(b - a)
        for y in itertools.product([0, 1], repeat=b - a):
            w = np.exp(field.start[y[0]] + sum(score[a + k] * v for k, v in enumerate(y)) + sum(field.trans[i, j] for i, j in itertools.pairwise(y)))
            z, m = z + w, m + w * np.array(y)
        assert np.allclose(p[a:b], m / z)


def test_toxicity(spark, odd, empty):
    rnd = random.Random(3)
    clean = [w for w in VOCAB if w not in ("idiot", "loser")]
    rows, labels = [], []
    for k in range(500):
        text = [rnd.choice(clean) + rnd.choice(["", "a", "o"]) for _ in range(40)]
        if k % 4 == 0:
            for at in rnd.sample(range(40), 3):
                text[at] = rnd.choice(["idiot", "loser"])
        rows.append((1000 + k, " ".join(text)))
        labels.append((1000 + k, int(k % 4 == 0)))
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = toxicity.score_toxicity(docs(spark, rows), lab).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    text = dict(rows)
    spans = [text[r["doc_id"]][s["start"] : s["end"]] for r in held for s in r["spans"]]
    assert spans and np.mean([set(s.split()) <= {"idiot", "loser"} for s in spans]) > 0.95
    strange = toxicity.score_toxicity(odd, lab).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    none = toxicity.score_toxicity(odd, lab.limit(0)).select("score").distinct().collect()
    assert len(none) == 1
    assert toxicity.score_toxicity(empty, lab).count() == 0


# 4


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), seed=42) for j in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd, empty):
    got = Counter((r["doc_id"], r["fp"] % 2**64) for r in simhash.fingerprints(odd).collect())
    assert got == Counter((r["doc_id"], brute_print(r["text"])) for r in odd.collect())
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, block):
    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(150)]
    for base in list(prints[:20]):
        for _ in range(8):
            prints.append(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))))
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.linked(df, block=block).collect()
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        a, b = r["a"] % 2**64, r["b"] % 2**64
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {p: find(p) for p in prints}
    root = {p: p for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {p: find(p) for p in prints}


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert kept.count() == len(set(label))
    ids = {}
    for (i, _), v in zip(rows, label, strict=True):
        if i is not None:
            ids[v] = min(ids.get(v, i), i)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(ids.values())
    named = simhash.keep_one(odd.withColumns({"_text_h": F.lit("mine"), "_ID": F.lit(1)}))
    assert named.columns == [*odd.columns, "_text_h", "_ID"] and {r["_text_h"] for r in named.collect()} == {"mine"} and named.count() == kept.count()


# 5


def test_base_spans():
    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    rnd = random.Random(6)
    for _ in range(4000):
        t = "".join(rnd.choice(["a", "b.", "@", "@c", ".d", "1", "23", "4.5", "-", " ", "+", "(", "4111111111111111", "+1 (202) 555-0101", "1.2.3.4", "é"]) for _ in range(rnd.randint(1, 14)))
        want = []
        for k, p in enumerate(patterns):
            for m in p.finditer(t):
                d = personal_data.digits_of(m.group())
                ok = [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and personal_data.luhn(d), 9 <= len(d) <= 15][k]
                if ok:
                    want.append((m.start(), m.end(), k))
        assert personal_data.base_spans(t) == sorted(want, key=lambda s: (s[0], s[2]))


def test_segment_sums_and_decoder():
    rng = np.random.default_rng(1)
    for _ in range(20):
        segments = sorted({tuple(sorted(rng.choice(8, 2, replace=False).tolist())) for _ in range(7)})
        score = rng.normal(size=(len(segments), 4))
        z, best = [], (-np.inf, None)
        for n in range(len(segments) + 1):
            for pick in itertools.combinations(range(len(segments)), n):
                if all(segments[a][1] <= segments[b][0] or segments[b][1] <= segments[a][0] for a, b in itertools.combinations(pick, 2)):
                    for kinds in itertools.product(range(4), repeat=n):
                        s = sum(score[p, k] for p, k in zip(pick, kinds, strict=True))
                        z.append(s)
                        best = max(best, (s, sorted((*segments[p], k) for p, k in zip(pick, kinds, strict=True))), key=lambda x: x[0])
        ahead, back, _ = personal_data.lattice(segments, score)
        assert np.isclose(ahead[-1], np.logaddexp.reduce(z)) and np.isclose(back[0], ahead[-1])
        assert [x[:3] for x in personal_data.decode(segments, score)] == [tuple(x) for x in best[1]]


def test_personal_data(spark, odd, empty):
    rows = [(k, f"Write to u{k}@mail.example.com or +1 (202) 555-01{k % 90 + 10} now, é 10.0.{k % 200}.7 and 4111111111111111.") for k in range(80)]
    rows.append((99, "cards 4111111111111111 5500000000000004 here"))
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(docs(spark, rows)).collect()}
    assert all(got[k]["n_email"] == got[k]["n_ip"] == got[k]["n_card"] == got[k]["n_phone"] == 1 for k in range(80))
    assert got[99]["n_card"] == 0 and got[99]["spans"] == "card:6:22,card:23:39"  # the field parts what the pattern runs together
    clean = personal_data.redact_personal_data(docs(spark, rows))
    text = {r["doc_id"]: r for r in clean.collect()}
    assert text[3]["text"] == "Write to <email> or <phone> now, é <ip> and <card>." and text[3]["n_chars"] == len(text[3]["text"])
    assert personal_data.find_personal_data(odd).count() == odd.count()
    assert personal_data.redact_personal_data(odd).where("text is null").count() == 2
    assert personal_data.find_personal_data(empty).count() == 0


# 6


def test_quality(spark, odd, empty):
    rnd = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        w = prose(40, rnd).split()
        rows.append((k, " ".join(x + "***" if bad else x for x in w)))
        if k % 2 == 0:
            labels.append((k, int(not bad)))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in quality.resample(d, lab).collect()}
    assert all(got[k]["selected"] == (k % 5 != 0) for k in range(400))
    assert {r["doc_id"] for r in quality.keep_good(d, lab).collect()} == {k for k in range(400) if k % 5}
    few = {r["doc_id"]: r for r in quality.resample(d, lab, k=117).collect()}
    assert sum(r["selected"] for r in few.values()) == 117
    # weights, keys and the choice, from plain counts
    buckets = {k: quality.ngrams(t.encode(), quality.Hashes()).tolist() for k, t in rows}
    fit = {r["doc_id"] for r in quality.label_rows(lab).where("good").collect()} & set(buckets)
    raw, target = Counter(b for k in buckets for b in buckets[k]), Counter(b for k in fit for b in buckets[k])
    n_raw, n_target = sum(raw.values()) + 1e-3 * quality.BUCKETS, sum(target.values())
    p_raw = lambda b: (raw[b] + 1e-3) / n_raw
    ratio = {b: (target[b] + quality.PRIOR) / (n_target * p_raw(b) + quality.PRIOR) for b in range(quality.BUCKETS)}
    total = sum(ratio[b] * p_raw(b) for b in ratio)
    weight = {k: sum(math.log(ratio[b] / total) for b in bs) for k, bs in buckets.items()}
    key = {k: weight[k] + quality.gumbel(k, t.encode(), quality.SEED) for k, t in rows}
    assert fit and all(abs(few[k]["weight"] - weight[k]) < 1e-6 and abs(few[k]["key"] - key[k]) < 1e-6 for k in key)
    best = lambda by: set(sorted(by, key=by.get)[-117:])
    assert {k for k, r in few.items() if r["selected"]} == best(key) != best(weight)
    assert quality.resample(odd, lab).count() == odd.count()
    assert quality.resample(odd, lab.limit(0)).where("selected").count() == odd.count()
    assert quality.keep_good(odd, lab.limit(0)).columns == odd.columns
    assert quality.resample(empty, lab).count() == 0


def test_draws_in_proportion():
    weight = np.array([0.5, 1.0, 2.0, 4.0])
    texts = [(k, prose(5 + k).encode()) for k in range(4)]
    draws = [int(np.argmax([np.log(w) + quality.gumbel(k, t, seed) for w, (k, t) in zip(weight, texts, strict=True)])) for seed in range(20_000)]
    assert np.allclose(np.bincount(draws) / 20_000, weight / weight.sum(), atol=0.012)


def test_quality_clashing_names(spark, odd, empty):
    lab = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    d = odd.withColumns({"_weight": F.lit("w"), "_key": F.lit(1), "Selected": F.lit(2)})
    out = quality.keep_good(d, lab)
    assert out.columns == d.columns
    assert quality.keep_good(d, lab, k=5).count() >= 5 and quality.keep_good(d, lab, k=0).count() == 0
    assert quality.keep_good(empty, lab).count() == 0


def test_kth_largest(spark):
    rnd = random.Random(8)
    values = [rnd.choice([rnd.random(), 0.5, rnd.random() * 1e-9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").cache()
    for k in (1, 2, 700, 1500, 3000):
        assert quality.kth_largest(df, "x", k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]


# 7


def test_forward_and_expected_counts():
    rng = np.random.default_rng(2)
    m = language_model.Model(np.array([0.2, 0.8]), np.array([[0.7, 0.3], [0.1, 0.9]]), rng.random((6, 2)))
    seqs = [rng.integers(0, 6, n) for n in (1, 4, 6, 2)]
    want, start, trans, emit = [], np.zeros(2), np.zeros((2, 2)), np.zeros((6, 2))
    for s in seqs:
        paths = {}
        for y in itertools.product([0, 1], repeat=len(s)):
            paths[y] = m.pi[y[0]] * np.prod([m.emit[o, k] for o, k in zip(s, y, strict=True)]) * np.prod([m.trans[a, b] for a, b in itertools.pairwise(y)])
        z = sum(paths.values())
        want.append(np.log(z))
        for y, w in paths.items():
            start[y[0]] += w / z
            for a, b in itertools.pairwise(y):
                trans[a, b] += w / z
            for o, k in zip(s, y, strict=True):
                emit[o, k] += w / z
    for size in (1, 2, 3, 1024):  # cuts change nothing
        assert np.allclose(m.log_probability(seqs, size), want)
        a, b, (at, c), total = m.expected(seqs, size)
        full = np.zeros((6, 2))
        full[at] = c
        assert np.allclose(a, start) and np.allclose(b, trans) and np.allclose(full, emit) and np.isclose(total, sum(want))


def test_spelling_mass():
    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(1, 6)).tolist()) for _ in range(200)]
    a, b, first = language_model.Spelling.steps(words)
    counts = np.zeros((257, 257))
    np.add.at(counts, (a, b), 1e6)
    sp = language_model.Spelling(counts)
    every = [bytes(w) for n in range(1, 12) for w in itertools.product(b"abc", repeat=n)]
    got = np.bincount([language_model.word_class(w, 4) for w in every], weights=10 ** sp.log10(every), minlength=4)
    mass = sp.mass(4)
    assert np.isclose(mass.sum(), 1) and (got <= mass + 1e-9).all() and got.sum() > 0.8
    one = float(np.prod([sp.p[x, y] for x, y in ((256, 97), (97, 98), (98, 256))]))
    assert np.isclose(10 ** sp.log10([b"ab"])[0], one)


def test_language_model(spark, odd, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(200 + k, prose(50) + f" rare{k % 40} once{k}") for k in range(60)]
    models = []
    maximise = language_model.maximise
    monkeypatch.setattr(language_model, "maximise", lambda *a: models.append(maximise(*a)) or models[-1])
    got = language_model.score_texts(docs(spark, rows), head=8, least=2, classes=4).collect()
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)))
    want = sorted(((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(base(t), 6)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    # the score, from the final model and counts, one step at a time
    m = models[-1]
    ordered = sorted(c, key=lambda w: (-c[w], w))
    (head,) = {tuple(h) for f in set(c.values()) if len(h := [w for w in ordered if c[w] >= f or w == b""]) + 4 == len(m.emit)}
    assert len(head) <= 9
    tail = [w for w in c if w not in head]
    a, b, _ = language_model.Spelling.steps(tail)
    counts = np.zeros((257, 257))
    np.add.at(counts, (a, b), 1)
    sp = language_model.Spelling(counts)
    z = sp.mass(4)

    def within(w):
        k = language_model.word_class(w, 4)
        mine = [c[x] for x in tail if language_model.word_class(x, 4) == k]
        q = 10 ** float(sp.log10([w])[0]) / z[k]
        if not mine:
            return q
        n1, n2 = mine.count(1), mine.count(2)
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        free = d * len(mine) / sum(mine) * q
        return (c[w] - d) / sum(mine) + free if c[w] else min(free, (1 - d) / sum(mine))

    def brute(t):
        x, log = None, 0.0
        for w in tok(t):
            k = head.index(w) if w in head else len(head) + language_model.word_class(w, 4)
            x = (m.pi if x is None else x @ m.trans) * m.emit[k]
            log += np.log10(x.sum()) + (0.0 if w in head else np.log10(within(w)))
            x = x / x.sum()
        return log

    few = [(i, t) for i, t in rows if len(t or "") < 2000]
    want = sorted((str(i), round(brute(t), 4)) for i, t in few)
    ids = {i for i, _ in few}
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got if r["doc_id"] in ids and r["n_tokens"] < 500 and (r["doc_id"] != 9)) == want
    assert language_model.score_texts(empty).count() == 0


def test_unknown_words_cost_more(spark):
    """Random strings score below held-out prose, held-out prose not above training prose, and an unseen word below a rare one."""
    rng = random.Random(5)
    syllables = ["ba", "ne", "ti", "ro", "su", "la", "mi", "ko", "de", "ran", "tel", "sor"]
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    weights = [1 / (k + 1) for k in range(len(lexicon))]
    text = lambda: " ".join(rng.choices(lexicon, weights, k=80))
    rows = [(k, text()) for k in range(400)]
    held = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 7 == 2][:12]
    noise = lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(80))
    rows += [(i, noise()) for i in held[:6]]
    got = {r["doc_id"]: r for r in language_model.score_texts(docs(spark, rows)).collect()}
    per = lambda keep: float(np.mean([r["score"] / r["n_tokens"] for r in got.values() if keep(r)]))
    train, prose_out = per(lambda r: not r["held_out"]), per(lambda r: r["held_out"] and r["doc_id"] < 1000)
    assert max(got[i]["score"] / got[i]["n_tokens"] for i in held[:6]) < prose_out - 1 and prose_out <= train


# 8


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4)], 0) for k in range(150)]
    rows += [(200 + k, [0.5, 0.5, 0.5, 0.5], 1) for k in range(60)]
    rows += [(1000, None, 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (1020, [float("nan"), 1.0, 1.0, 1.0], 1), (1040, [1.0, None, 1.0, 1.0], 1), (1060, [1.0, 2.0], 1), (1080, [3.0, 1.0], 1), rows[20], (40, [9.0, 9.0, 9.0, 9.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.top_k(df, k=7).collect())
    ok = {(i, tuple(int(np.floor(np.float64(np.float32(x)) * 64)) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i and len(x) == len(q))
            want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s[:7])]
    assert got == sorted(want)
    assert neighbours.top_k(df.limit(0)).count() == 0
    assert neighbours.scores(np.array([[2**40]]), np.array([[2**40]])).tolist() == [[neighbours.LIMIT]]


def test_neighbours_prune_clusters(spark, monkeypatch):
    """On clustered vectors most pairs of groups and cells go; the result is that of brute force."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 8)) * 5
    v = np.concatenate([c + rng.normal(size=(40, 8)) * 0.05 for c in centre])
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    out, plan = neighbours.search(df, k=5)
    q = np.floor(v * 64).astype(np.int64)
    want = []
    for i in range(0, len(q), 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(q)), -s)).tolist() if j != i][:5]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()) == want
    pairs = plan.collect()
    asked, dealt = sum(r["asked"] * r["points"] for r in pairs), sum(r["points"] for r in pairs)
    groups = {r["g"] for r in pairs}
    assert len(groups) > 3 and len({r["b"] for r in pairs}) > 20
    assert asked < 0.3 * 60 * len(v) and dealt < 0.7 * len(groups) * len(v)  # pairs that are solved, and vectors that are replicated


# 9


def test_trees():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd = random.Random(9)
    parts = ["a", "bc", " ", "  ", "\n", "'s", "'", "'re", "12", "!?", " !", "é", "\t", "日本", "the ", " ", "l", "'l"]
    for _ in range(400):
        t = "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 5, 30, 300, 1500])))
        tree = token_counts.Tree(t, counter)
        for _ in range(4):
            a = rnd.randint(0, len(t))
            b = min(len(t), a + rnd.choice([0, 1, 5, 40, 400]))
            new = "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 2, 10, 200])))
            t = t[:a] + new + t[b:]
            tree.edit(a, b, new)
            assert tree.text == t and tree.tokens == counter.whole(t)
    long = token_counts.Tree("word and " * 5000, counter)
    long.edit(20_000, 20_004, "other")
    assert long.encoded < 200 and long.tokens == counter.whole(long.text)
    node, begin = long.find(20_000)
    assert begin <= 20_000 < begin + long.levels[0][node, 0]
    assert long.count_until(node) == sum(int(b.sum()) for _, b in long.leaves[:node])


def test_token_counts(odd, empty):
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = Counter((r["doc_id"], r["n_tokens"], r["edited_tokens"]) for r in token_counts.count_tokens(odd).collect())
    want = Counter()
    for r in odd.collect():
        t = r["text"] or ""
        n = counter.whole(t)
        for a, b, new in token_counts.planned_edits(r["doc_id"], t):
            t = t[:a] + new + t[b:]
        want[(r["doc_id"], n, counter.whole(t))] += 1
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


# 10


@pytest.mark.parametrize("block", [4096, 2])
def test_chat(spark, block):
    rnd = random.Random(10)
    rows = []
    turns = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", None), (None, "bye"), ("user", "")]
    for c in range(40):
        rows += [(c, t, *turns[(t * 7 + c % 3) % 5]) for t in range(rnd.randint(1, 6))]
    rows += [(50, None, "user", "hi"), (50, 3, "user", "hi"), (None, 0, "user", "alone"), (51, 0, "user", "hi"), (51, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    got = {}
    for r in sorted(chat.render(df, block).collect(), key=lambda r: (str(r["conv_id"]), r["part"])):
        old = got.get(r["conv_id"], ("", 0, 0))
        got[r["conv_id"]] = (old[0] + r["rendered"], r["n_turns"], r["n_copies"])
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is None, t or 0, role or "unknown", text or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, s in seqs.items():
        whole.setdefault(tuple(s), []).append(c)
    prefixes = {tuple(s[:k]) for s in seqs.values() for k in range(1, len(s))}
    clean = lambda x: x.replace("<|", "< |")
    want = {min((c for c in ids if c is not None), default=None): ("".join(f"<|im_start|>{clean(r)}\n{clean(x)}<|im_end|>\n" for r, x in s), len(s), len(ids)) for s, ids in whole.items() if s not in prefixes}
    assert got == want
    assert chat.render(df.limit(0)).count() == 0
