"""Personal data: patterns, and a semi-Markov conditional random field over candidate segments.

The patterns' matches always stand. The field looks wider: around digits and at-signs every run of adjacent pieces up to a
bounded length is a candidate segment, scored as a whole (digits, groups, separators, checksum, the words before it).
It is trained on the patterns' own matches in a bounded sample, against all other candidates of the same texts. Its
decoder is a dynamic program over positions that picks, among all sets of non-overlapping segments, the best
boundaries and kinds at once; what it finds outside the patterns' matches is added.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import map_rows, table

KINDS = ("email", "ip", "card", "phone")
#: Rows and bytes per text of the sample that the field is trained on.
SAMPLE, SAMPLE_BYTES = 600, 20_000
#: Pieces that one candidate segment joins at most.
PIECES = 6
ROUNDS = 60
#: Score a segment needs beyond the field's own choice to be added: precision over recall.
MARGIN = 2.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' matches by start, then kind. Each is leftmost, non-overlapping within its kind, and linear in the text."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), 0))
                done = m.end()
                at = m.end() - 1
        at += 1
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


#: Where candidates can stand: a stretch around an at-sign, or digits with what may separate their groups.
STRETCH = re.compile(r"[^\s@]{1,80}+[ ]?@[ ]?[^\s@]{1,80}+|(?:\+|\()?[0-9][0-9 ().+-]{4,160}+")
PIECE = re.compile(r"[0-9]+|[A-Za-z_%]+|.", re.S)

NAMES = ["bias", "digits<9", "digits9-11", "digits12-15", "digits16", "digits17+", "luhn", "plus", "paren", "dots", "spaces", "hyphens", "letters", "at", "domain", "tld", "octets", "groups1", "groups4", "edge-left", "edge-right", "ends-mark"]
N = len(NAMES)


def segment_features(text: str, start: int, end: int) -> np.ndarray:
    """Features of a whole span; one weight vector for each kind."""
    s = text[start:end]
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    octets = len(groups) == 4 and all(_octet(g) for g in groups) and s.count(".") == 3
    domain = s.partition("@")[2].strip()
    x = np.zeros(N)
    x[0] = 1
    x[1 + (len(d) >= 9) + (len(d) >= 12) + (len(d) >= 16) + (len(d) >= 17)] = 1
    x[6] = len(d) >= 12 and luhn(d)
    x[7], x[8], x[9] = s[0] == "+", "(" in s and ")" in s, "." in s
    x[10], x[11], x[12] = " " in s, "-" in s, any(c.isalpha() for c in s)
    x[13], x[14], x[15] = s.count("@") == 1, "." in domain, bool(re.search(r"\.[A-Za-z]{2,}$", domain))
    x[16], x[17], x[18] = octets, len(groups) == 1, len(groups) == 4
    x[19] = start > 0 and (text[start - 1].isalnum() or text[start - 1] in "+@")
    x[20] = end < len(text) and (text[end].isalnum() or text[end] == "@")
    x[21] = not s[-1].isalnum() or s[0] in " .-)"
    return x


def candidates(text: str) -> list[list[tuple[int, int]]]:
    """Candidate segments by stretch: all runs of up to PIECES alphanumeric pieces with the marks between them.

    Stretches are disjoint, so each is decoded for itself. A stretch's length is bounded, and so are its segments.
    """
    out = []
    for m in STRETCH.finditer(text):
        if len(digits_of(m.group())) < 7 and "@" not in m.group():
            continue
        base, end = m.start(), m.end()
        parts = [(base + p.start(), base + p.end(), p.group()) for p in PIECE.finditer(text[base:end])]
        solid = [k for k, p in enumerate(parts) if p[2][0].isalnum()]
        segments = []
        for i, a in enumerate(solid):
            begin = parts[a][0]
            begins = [begin] + ([begin - 1] if begin > base and text[begin - 1] in "+(" else []) + ([begin - 2] if begin > base + 1 and text[begin - 2 : begin] == "+(" else [])
            for b in solid[i : i + (PIECES if "@" not in m.group() else 3 * PIECES)]:
                s = text[begin : parts[b][1]]
                if len(digits_of(s)) >= 7 or "@" in s:
                    segments += [(x, parts[b][1]) for x in begins]
        if segments:
            out.append(segments)
    return out


def lattice(segments: list[tuple[int, int]], score: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Positions of a stretch, and the log sums of all segmentations up to and from each. score: [segments, kinds]."""
    at = {p: k for k, p in enumerate(sorted({x for s in segments for x in s}))}
    n = len(at)
    total = np.logaddexp.reduce(score, axis=1)
    ahead, back = np.full(n, -np.inf), np.full(n, -np.inf)
    ahead[0] = back[-1] = 0
    ends: list[list[int]] = [[] for _ in range(n)]
    starts: list[list[int]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(segments):
        ends[at[b]].append(k)
        starts[at[a]].append(k)
    for p in range(1, n):
        ahead[p] = np.logaddexp.reduce([ahead[p - 1], *(ahead[at[segments[k][0]]] + total[k] for k in ends[p])])
    for p in range(n - 2, -1, -1):
        back[p] = np.logaddexp.reduce([back[p + 1], *(total[k] + back[at[segments[k][1]]] for k in starts[p])])
    return ahead, back, at


def decode(segments: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best set of non-overlapping segments with their kinds (semi-Markov Viterbi): (start, end, kind, score)."""
    at = {p: k for k, p in enumerate(sorted({x for s in segments for x in s}))}
    kind, top = score.argmax(1), score.max(1)
    by_end: dict[int, list[int]] = {}
    for k, (_, b) in enumerate(segments):
        by_end.setdefault(at[b], []).append(k)
    best, choice = [0.0], [-1]
    for p in range(1, len(at)):
        best.append(best[p - 1])
        choice.append(-1)
        for k in by_end.get(p, ()):
            if (v := best[at[segments[k][0]]] + top[k]) > best[p]:
                best[p], choice[p] = v, k
    out, p = [], len(at) - 1
    while p > 0:
        if (k := choice[p]) < 0:
            p -= 1
        else:
            out.append((*segments[k], int(kind[k]), float(top[k])))
            p = at[segments[k][0]]
    return out[::-1]


def train(texts: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Weights [kinds, features] by gradient ascent on the likelihood of the patterns' matches as segmentation."""
    stretches = []
    for text in texts:
        truth = {(a, b): k for a, b, k in base_spans(text)}
        for segments in candidates(text):
            x = np.stack([segment_features(text, a, b) for a, b in segments])
            gold, reach = [], -1
            for j in sorted((j for j, s in enumerate(segments) if s in truth), key=lambda j: segments[j]):
                if segments[j][0] >= reach:  # of matches of two kinds that overlap, the first
                    gold.append(j)
                    reach = segments[j][1]
            stretches.append((segments, x, [(j, truth[segments[j]]) for j in gold]))
    w = np.zeros((len(KINDS), N))
    w[:, 0] = -3.0
    moment = np.zeros_like(w)
    for _ in range(rounds if stretches else 0):
        grad = -0.02 * w
        for segments, x, gold in stretches:
            score = x @ w.T
            ahead, back, at = lattice(segments, score)
            z = ahead[-1]
            a = np.array([ahead[at[s]] for s, _ in segments])
            b = np.array([back[at[e]] for _, e in segments])
            p = np.exp(np.clip(a[:, None] + score + b[:, None] - z, -700, 0))
            grad -= p.T @ x
            for j, k in gold:
                grad[k] += x[j]
        moment += grad**2
        w += 0.6 * grad / np.sqrt(moment + 1e-9)
    return w


def find_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> tuple[list[Span], list[Span]]:
    """(base, all): the patterns' matches, and those with what the field adds outside them."""
    base = base_spans(text)
    more = []
    for segments in candidates(text) if "@" in text or any(c in text for c in "0123456789") else ():
        x = np.stack([segment_features(text, a, b) for a, b in segments])
        for a, b, kind, score in decode(segments, x @ weights.T):
            if score >= margin and not any(s < b and a < e for s, e, _ in base):
                more.append((a, b, kind))
    return base, sorted([*base, *more], key=lambda s: (s[0], s[2], s[1]))


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def fit(docs: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """Train on at most `rows` texts that hold a digit or an at-sign: those with the smallest hashes of id, then text."""
    some = docs.select("doc_id", "text").where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike("[0-9]{7}|@|[0-9] [0-9]|[0-9]\\.[0-9]"))
    picked = some.select(F.xxhash64(F.lit("sample"), "doc_id").alias("h"), "text").orderBy("h", "text").limit(rows).select("text").collect()
    return train(list(dict.fromkeys(sorted(r["text"] for r in picked))))


def find_personal_data(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Counts and digest are those of the patterns' matches; spans holds all, as kind:start:end in code points. Null and
    empty texts have none. Rows that repeat and null ids are searched like any other. An empty table gives no rows.
    Without any match to learn from the field adds nothing. Columns other than doc_id and text are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))

    def work(part: pa.RecordBatch) -> dict:
        found = [find_spans(t or "", weights.value) for t in part.column("text").to_pylist()]
        return {
            "doc_id": part.column("doc_id").cast(pa.int64()),
            **{f"n_{name}": pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k, name in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(show(base).encode()).hexdigest() for base, _ in found],
            "spans": [show(every) for _, every in found],
        }

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", work)


def redact(text: str, spans: list[Span]) -> str:
    """Replace every span by its kind in angle brackets; of spans that overlap the outermost stretch is replaced once."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def redact_personal_data(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """`docs` with all its columns and rows, the personal data in `text` replaced; null texts stay null.

    Empty texts, null ids, very long texts and repeated rows stay as rows; an empty table stays empty. A column n_chars, if there is one, is the number of characters of the new text.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t, weights.value)[1]) for t in batch.column("text").to_pylist()]
            cols = [pa.array(texts, f.type) if f.name == "text" else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
