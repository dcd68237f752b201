"""Toxic spans by a linear-chain conditional random field.

Labels stand on documents, so tokens are labelled first: a token of a toxic training document is toxic if its word, or
a beginning of it, is tied to toxic documents far beyond chance (log-likelihood ratio over groups of near copies, not
over documents). The field learns from those labelled tokens with the words' beginnings as features, so that unseen
forms of a stem are found. Scoring runs forward-backward over every whole text; marginals add up to the document's
score and name the offending offsets.

Fitting uses a bounded sample of labelled training rows (SAMPLE); scoring covers every row, where it is read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import crc_mod, id_crc32, map_rows, raw_texts, table
from tidegraph.llm.decontaminate import words_of

#: Labelled rows of each class, and bytes of each text, that the field is fitted on.
SAMPLE, SAMPLE_BYTES = 2500, 20_000
#: Tokens of a training window, and how many are chosen: all with a toxic token, the rest (as many as those at least) clean.
WINDOW, WINDOWS = 48, 5000
#: Log-likelihood ratio, and how many times as frequent in toxic texts, from which a word or a beginning counts as tied to them.
EVIDENCE, LIFT = 20.0, 8
BUCKETS = 1 << 18
#: Lengths of the beginnings that are features, in bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
CACHE = 300_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def features(word: bytes) -> list[bytes]:
    return [b"=" + word] + [word[:k] for k in BEGINNINGS if len(word) >= k]


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


def pass_chain(e: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Normalised forward messages of many two-state chains that stand one after another.

    e: potentials [N, 2]; first: True where a chain begins; start, trans: potentials. The tokens are cut into rows of
    equal length: every row is run from both states at once, the rows are joined one by one, and a second run fills in
    all tokens. The result is exact, and the time does not depend on how long single chains are.
    """
    n = len(e)
    t = max(1, int(np.sqrt(n)))
    r = -(-n // t)
    pad = r * t - n
    e = np.concatenate([e, np.ones((pad, 2))]).reshape(r, t, 2).transpose(1, 0, 2).copy()
    first = np.concatenate([first, np.zeros(pad, dtype=bool)]).reshape(r, t).T.copy()
    x = np.repeat(np.eye(2)[None], r, axis=0)
    for k in range(t):
        y = x @ trans
        if first[k].any():
            y[first[k]] = x[first[k]].sum(-1, keepdims=True) * start
        x = y * e[k][:, None]
        x /= x.sum((1, 2), keepdims=True)
    a = np.empty((r, 2))
    now = np.array([0.5, 0.5])
    for k in range(r):
        a[k] = now
        now = now @ x[k]
        now = now / now.sum()
    out = np.empty((t, r, 2))
    for k in range(t):
        y = a @ trans
        if first[k].any():
            y[first[k]] = start
        a = y * e[k]
        a /= a.sum(1, keepdims=True)
        out[k] = a
    return out.transpose(1, 0, 2).reshape(r * t, 2)[:n]


class Field:
    """Weights of the field, and the line from marginals to a document's score."""

    def __init__(self, weight: np.ndarray, bias: float, start: np.ndarray, trans: np.ndarray, line: np.ndarray):
        self.weight, self.bias, self.start, self.trans, self.line = weight, bias, start, trans, line
        self.cache: dict[bytes, float] = {}

    def __getstate__(self):
        at = np.flatnonzero(self.weight)
        return at, self.weight[at], self.bias, self.start, self.trans, self.line

    def __setstate__(self, s):
        weight = np.zeros(BUCKETS)
        weight[s[0]] = s[1]
        self.__init__(weight, *s[2:])

    def score_word(self, word: bytes) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[word] = self.bias + float(sum(self.weight[bucket(f)] for f in features(word)))
        return got

    def marginals(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the toxic tag of every token, and forward messages; chains begin where first is True."""
        if not len(score):
            return np.zeros(0), np.zeros((0, 2))
        e = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
        trans = np.exp(self.trans)
        alpha = pass_chain(e, first, np.exp(self.start), trans)
        last = np.concatenate([first[1:], [True]])[::-1]
        back = pass_chain(e[::-1], last, np.ones(2), trans.T)[::-1]  # holds the token's own potential once more
        p = alpha * back / e
        return p[:, 1] / p.sum(1), alpha

    def tag(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        flat = [w for d in docs for w in d]
        one = self.cache.get
        score = np.fromiter((s if (s := one(w)) is not None else self.score_word(w) for w in flat), dtype=np.float64, count=len(flat))
        first = np.zeros(len(flat), dtype=bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        p, _ = self.marginals(score, first)
        return np.split(p, ends[:-1]) if len(docs) else []


def summary(p: np.ndarray) -> np.ndarray:
    """What the score of a document looks at: its most toxic token and the toxic tokens that it expects."""
    top = float(p.max()) if len(p) else 0.0
    top = min(max(top, 1e-6), 1 - 1e-6)
    return np.array([1.0, np.log(top / (1 - top)), np.log1p(float(p[p > 0.05].sum()))])


def groups_of_copies(docs: list[list[bytes]]) -> np.ndarray:
    """A group number for each text: those that share one of four least five-word shingle hashes."""
    group = np.arange(len(docs))
    seen: dict[tuple[int, int], int] = {}

    def root(k):
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for k, words in enumerate(docs):
        shingles = [zlib.crc32(b" ".join(words[j : j + 5])) for j in range(max(1, len(words) - 4))]
        h = np.array(shingles, dtype=np.uint64)
        for salt, mult in enumerate((2654435761, 2246822519, 3266489917, 668265263)):
            least = int(((h * np.uint64(mult)) & np.uint64(0xFFFFFFFF)).min())
            a, b = root(k), root(seen.setdefault((salt, least), k))
            group[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(docs))])


def toxic_features(docs: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words and beginnings whose groups of texts are tied to the label far beyond chance."""
    group = groups_of_copies(docs)
    label = {g: max(toxic[group == g]) for g in np.unique(group).tolist()}
    n1 = sum(1 for v in label.values() if v)
    n0 = len(label) - n1
    members: dict[int, list[int]] = defaultdict(list)
    for k, g in enumerate(group.tolist()):
        members[g].append(k)
    of_group = lambda g: {f for w in {w for k in members[g] for w in docs[k]} for f in features(w)}
    c1: Counter = Counter()
    for g, v in label.items():
        if v:
            c1.update(of_group(g))
    c1 = Counter({f: n for f, n in c1.items() if n >= 3})
    c0: Counter = Counter()
    for g, v in label.items():
        if not v:
            c0.update(of_group(g) & c1.keys())
    out = set()
    for f, a in c1.items():
        b = c0.get(f, 0)
        if a * n0 < LIFT * b * n1:
            continue
        c, d, n = n1 - a, n0 - b, n1 + n0
        g2 = 2 * sum(x * np.log(x * n / (r * s)) for x, r, s in ((a, a + b, n1), (b, a + b, n0), (c, c + d, n1), (d, c + d, n0)) if x)
        if g2 >= EVIDENCE:
            out.add(f)
    return out


def fit(texts: list[bytes], toxic: list[int], rounds: int = 60) -> Field:
    """Fit the field and its score on labelled texts."""
    docs, y = [words_of(t) for t in texts], np.array(toxic, dtype=np.int64)
    trans, start = np.zeros((2, 2)), np.zeros(2)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of toxic rows is the score of all
        rate = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return Field(np.zeros(BUCKETS), -20.0, start, trans, np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    found = toxic_features(docs, y)
    tags = [np.array([t and any(f in found for f in features(w)) for w in d], dtype=bool) for d, t in zip(docs, y.tolist(), strict=True)]
    windows = [(k, at) for k, d in enumerate(docs) for at in range(0, len(d), WINDOW)]
    marked = [(k, at) for k, at in windows if tags[k][at : at + WINDOW].any()]
    plain = [(k, at) for k, at in windows if not y[k]]
    plain = plain[:: max(1, len(plain) // max(1, WINDOWS - len(marked), len(marked)))]
    chosen = marked + plain
    words = [w for k, at in chosen for w in docs[k][at : at + WINDOW]]
    tag = np.concatenate([tags[k][at : at + WINDOW] for k, at in chosen]).astype(np.float64)
    first = np.zeros(len(words), dtype=bool)
    first[np.cumsum([0] + [min(WINDOW, len(docs[k]) - at) for k, at in chosen[:-1]])] = True
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    word = np.array([distinct[w] for w in words])
    f_of = [[bucket(f) for f in features(w)] for w in distinct]
    owner, flat = np.repeat(np.arange(len(f_of)), [len(f) for f in f_of]), np.array([b for f in f_of for b in f])
    field = Field(np.zeros(BUCKETS), -3.0, start, trans, np.zeros(3))
    both = ~first[1:]
    moment = np.zeros(BUCKETS)
    for _ in range(rounds):
        score = (field.bias + np.bincount(owner, weights=field.weight[flat], minlength=len(distinct)))[word]
        p, alpha = field.marginals(score, first)
        # pair marginals of neighbours, from the forward message of one and the backward message of the next
        e = np.exp(np.clip(score, -30, 30))
        t = np.exp(field.trans)
        to = alpha @ t
        q1 = p / np.maximum(to[np.r_[0, : len(p) - 1], 1] * e, 1e-300)
        q0 = (1 - p) / np.maximum(to[np.r_[0, : len(p) - 1], 0], 1e-300)
        want, have = np.zeros((2, 2)), np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                pair = alpha[:-1, i] * t[i, j] * ((q1 * e) if j else q0)[1:]
                have[i, j] = pair[both].sum()
                want[i, j] = ((tag[:-1] == i) & (tag[1:] == j) & both).sum()
        grad = np.bincount(flat, weights=np.bincount(word, weights=tag - p, minlength=len(distinct))[owner], minlength=BUCKETS) - 0.01 * field.weight
        moment += grad**2
        field.weight += np.where(moment > 0, 0.5 * grad / np.sqrt(moment + 1e-9), 0)
        field.bias += 0.2 * np.sign((tag - p).sum()) * min(1.0, abs((tag - p).sum()) / max(1.0, tag.sum()))
        field.trans = np.clip(field.trans + 0.5 * (want - have) / max(1.0, tag.sum()), -5, 5)
    x = np.stack([summary(p) for p in field.tag(docs)])
    line = np.zeros(3)
    for _ in range(50):  # logistic regression by Newton's method, with a little shrinkage
        s = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        h = (x * (s * (1 - s) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(3)
        line = line + np.linalg.solve(h, x.T @ (y - s) - 0.05 * line)
    field.line = line
    field.cache.clear()
    return field


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: int, held: int, rows: int = SAMPLE) -> tuple[list[bytes], list[int]]:
    """At most `rows` texts of each class, of labelled rows outside the held-out fold: those with the smallest hashes. Of several texts of an id the least counts."""
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", fold) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = [known.where(F.col("toxic") > 0), known.where(F.col("toxic") <= 0)]
    ids = picked[0].orderBy(order).limit(rows).union(picked[1].orderBy(order).limit(rows))
    got = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    out = sorted((r["doc_id"], r["text"].encode(), int(r["toxic"] > 0)) for r in got.collect())
    return [t for _, t, _ in out], [y for _, _, y in out]


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row of `docs`.

    spans: (start, end, p) of runs of tokens tagged toxic, in characters of the text. Labels of rows whose
    crc32(doc_id) modulo `fold` is `held` are never read; a score depends on its row's text alone. Null and empty
    texts score as texts without toxic tokens. Null labels teach nothing; of several labels of one id the highest
    counts. Without labels of both kinds every row gets the share of toxic ones. Repeated rows and null ids are
    scored like any other; an empty table gives no rows; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, fold, held, sample)))

    def work(part: pa.RecordBatch) -> dict:
        f, texts, ids = field.value, raw_texts(part), part.column("doc_id").to_pylist()
        tagged = f.tag([words_of(t) for t in texts])
        score = [1 / (1 + np.exp(-np.clip(summary(p) @ f.line, -30, 30))) for p in tagged]
        return {
            "doc_id": part.column("doc_id").cast(pa.int64()),
            "held_out": [id_crc32(i) % fold == held for i in ids],
            "score": pa.array(score, pa.float64()),
            "predicted": pa.array([int(s >= THRESHOLD) for s in score], pa.int32()),
            "spans": pa.array([offsets(t, p) for t, p in zip(texts, tagged, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))),
        }

    return map_rows(docs, ["doc_id", "text"], "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:bigint,end:bigint,p:double>>", work)


def offsets(text: bytes, p: np.ndarray) -> list[dict]:
    """Neighbouring toxic tokens as one span of characters."""
    if not len(p) or p.max() < 0.5:
        return []
    out: list[dict] = []
    before = -2
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] < 0.5:
            continue
        a, b = m.span()
        if before == k - 1:
            out[-1]["end"] += len(text[out[-1]["at"] : b].decode(errors="replace"))
            out[-1]["p"] = max(out[-1]["p"], float(p[k]))
        else:
            start = len(text[:a].decode(errors="replace"))
            out.append({"start": start, "end": start + len(text[a:b].decode(errors="replace")), "p": float(p[k])})
        out[-1]["at"] = b
        before = k
    return [{k: x[k] for k in ("start", "end", "p")} for x in out]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    span = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return got.select("doc_id", "held_out", "score", "predicted", F.array_join(F.transform("spans", span), ",").alias("spans"))
