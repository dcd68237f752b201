"""Benchmark decontamination over suffix arrays of the training text.

Every slice of documents (a shard) becomes one array of word ids, and a suffix array over it orders all word
positions by the words that follow. Every suffix of every benchmark item is then binary-searched in every shard;
runs of neighbouring hits on one diagonal join up to the longest verbatim matches with their locations.

The shards need no shuffle: a document is handled where it is read. The benchmark is cut into blocks whose pickled size
is measured; each block is one broadcast, and a worker holds one block at a time.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import keep_rows, map_rows, raw_texts, table

WINDOW = 10
#: Most bytes of one pickled block of the benchmark (a longer item stands alone), and of the text that is tried as one.
BLOCK_BYTES, BLOCK_TEXT = 32 << 20, 8 << 20
#: Pairs of a hit and a place in the benchmark that are joined at a time.
PAIRS = 1 << 21

#: Bytes of words, lower-cased; all others become a space. UTF-8 bytes of characters past ASCII belong to words.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Block:
    """Some benchmark items as one array of word ids of a vocabulary of their own, and their distinct windows.

    Equal texts stand once, with the names of all their items. `flat` holds the words, a zero after each text. Windows
    are numbered by length, then content: `rep` is a place of each, and `places[begin[w]:begin[w + 1]]` are all of them.
    """

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        vocab: dict[bytes, int] = {}
        texts: dict[bytes, list[str]] = {}
        for item, text in items:
            ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)], dtype=np.int32).tobytes()
            if ids:
                texts.setdefault(ids, []).append("" if item is None else str(item))
        self.vocab, self.names = vocab, list(texts.values())
        rows = [np.frombuffer(t, dtype=np.int32) for t in texts]
        size = np.array([len(r) for r in rows], dtype=np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.flat = np.zeros(int(size.sum()) + len(rows) + window, dtype=np.int32)
        for at, r in zip(self.start.tolist(), rows, strict=True):
            self.flat[at : at + len(r)] = r
        self.bits = max(1, math.ceil(math.log2(len(vocab) + 2)))
        self.pack = min(62 // self.bits, window)
        length = np.minimum(size, window)
        reps, begins, places, sizes, at = [np.zeros(0, np.int32)], [], [np.zeros(0, np.int32)], [], 0
        self.groups: list[tuple[int, int, int]] = []  # length, first window, windows
        for m in np.unique(length).tolist():
            mine = np.flatnonzero(length == m)
            n = size[mine] - m + 1
            pos = np.repeat(self.start[mine], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            rank = self.ranks(m)[pos]
            order = np.lexsort((pos, rank))
            first = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0]))
            reps.append(pos[order][first].astype(np.int32))
            begins.append(first + sum(map(len, places)))
            places.append(pos[order].astype(np.int32))
            sizes.append(np.full(len(first), m, dtype=np.int32))
            self.groups.append((m, at, len(first)))
            at += len(first)
        self.rep, self.places = np.concatenate(reps), np.concatenate(places)
        self.begin = np.concatenate([*begins, [len(self.places)]]).astype(np.int64)
        self.sizes = np.concatenate([np.zeros(0, np.int32), *sizes])

    def ranks(self, m: int) -> np.ndarray:
        """A number for the m words from each place of `flat`, the same for the same words."""
        number = lambda k: np.unique(k, return_inverse=True)[1].astype(np.int64)
        key = self.key(self.flat)
        if m <= self.pack:
            return number(key >> (self.bits * (self.pack - m)))
        r, depth = number(key), self.pack
        while depth < m:
            step = min(depth, m - depth)
            r = number(r * (len(r) + 1) + np.concatenate([r[step:], np.zeros(step, np.int64)]))
            depth += step
        return r

    def key(self, ids: np.ndarray) -> np.ndarray:
        """The first `pack` words from every position as one integer."""
        out = np.zeros(len(ids), dtype=np.int64)
        for k in range(self.pack):
            out <<= self.bits
            out[: max(0, len(ids) - k)] |= ids[k:]
        return out

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence in a shard, found by binary search in the shard's suffix array."""
        n = len(ids)
        at = np.flatnonzero(ids)  # a suffix that starts outside the benchmark's words matches nothing
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(at) or not self.groups:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = self.key(ids)
        order = np.argsort(first[at], kind="stable")
        sa, keys = at[order], first[at][order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        uniq = keys[new]
        rank = np.zeros(n + self.window + 1, dtype=np.int64)  # 0: past the end, or outside the words
        rank[sa] = np.cumsum(new)
        of = lambda k: np.where((p := np.searchsorted(uniq, k)) < len(uniq), np.where(uniq[np.minimum(p, len(uniq) - 1)] == k, p + 1, -1), -1)
        mine = self.key(self.flat)  # every suffix of the benchmark, searched by its first words, then by doubling
        found_mine = of(mine)
        far = np.concatenate([found_mine, np.zeros(self.window, np.int64)])
        for m, base, count in self.groups:
            rep = self.rep[base : base + count]
            if m <= self.pack:
                shift = self.bits * (self.pack - m)
                q, array, low = mine[rep] >> shift, sa, keys >> shift
            else:  # order by m words: doubling, the last step overlapping
                r, want, depth = rank, far, self.pack
                while depth < m:
                    step = min(depth, m - depth)
                    pair = r[at] * (n + 2) + r[at + step]
                    order = np.argsort(pair, kind="stable")
                    array, low = at[order], pair[order]
                    ahead = want[step : step + len(mine)]
                    q = np.where((want[: len(mine)] > 0) & (ahead > 0), want[: len(mine)] * (n + 2) + ahead, -1)
                    depth += step
                    if depth < m:
                        new = np.concatenate([[True], low[1:] != low[:-1]])
                        values = low[new]
                        r = np.zeros(n + self.window + 1, dtype=np.int64)
                        r[array] = np.cumsum(new)
                        p = np.searchsorted(values, q)
                        want = np.concatenate([np.where((p < len(values)) & (values[np.minimum(p, len(values) - 1)] == q), p + 1, -1), np.zeros(self.window, np.int64)])
                q = q[rep]
            left, right = np.searchsorted(low, q, "left"), np.searchsorted(low, q, "right")
            times = np.where(q < 0, 0, right - left)
            hit = np.flatnonzero(times)
            total = int(times[hit].sum())
            inner = np.arange(total) - np.repeat(np.cumsum(times[hit]) - times[hit], times[hit])
            found.append((array[np.repeat(left[hit], times[hit]) + inner], base + np.repeat(hit, times[hit])))
        return np.concatenate([p for p, _ in found]), np.concatenate([w for _, w in found])

    def all_places(self, win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into win, place) of every place of the given windows."""
        n = self.begin[win + 1] - self.begin[win]
        k = np.repeat(np.arange(len(win)), n)
        return k, self.places[np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + self.begin[win][k]].astype(np.int64)

    def texts_of(self, win: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        win = np.unique(win)
        for part in self.parts(win):
            out.append(np.unique(np.searchsorted(self.start, self.all_places(part)[1], "right") - 1))
        return np.unique(np.concatenate(out))

    def parts(self, win: np.ndarray) -> list[np.ndarray]:
        """Runs of `win` with about PAIRS places each."""
        if not len(win):
            return []
        load = np.cumsum(self.begin[win + 1] - self.begin[win])
        return np.split(win, np.flatnonzero(np.diff(load // PAIRS)) + 1)

    def longest(self, pos: np.ndarray, win: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The longest match of each text (then the earliest): windows that follow each other on one diagonal.

        pos, win: the hits of one document, by position. A stretch of hits that comes again is looked at once.
        """
        best: dict[int, tuple[int, int, int]] = {}
        seen = set()
        for p, w in zip(*(np.split(x, np.flatnonzero(np.diff(pos) > 1) + 1) for x in (pos, win)), strict=True):
            mark = (p - p[0]).tobytes() + w.tobytes()
            if mark in seen:
                continue
            seen.add(mark)
            step = len(self.start) if (self.begin[w + 1] - self.begin[w]).sum() <= PAIRS else max(1, PAIRS // len(w) // self.window)
            for lo in range(0, len(self.start), step):  # some texts at a time where a stretch has very many places
                self.runs(p, w, lo, lo + step, best)
        return best

    def runs(self, p: np.ndarray, w: np.ndarray, lo: int, hi: int, best: dict[int, tuple[int, int, int]]) -> None:
        """Take into `best` the runs of one stretch in the texts lo .. hi."""
        if lo == 0 and hi >= len(self.start):
            k, place = self.all_places(w)
        else:
            a, b = self.start[lo], self.start[hi] if hi < len(self.start) else len(self.flat)
            got = [(q := self.places[self.begin[x] : self.begin[x + 1]])[np.searchsorted(q, a) : np.searchsorted(q, b)] for x in w.tolist()]
            k, place = np.repeat(np.arange(len(w)), [len(q) for q in got]), np.concatenate(got).astype(np.int64)
        if not len(k):
            return
        order = np.lexsort((p[k], p[k] - place))
        k, place = k[order], place[order]
        at = p[k]
        new = np.concatenate([[True], (np.diff(at - place) != 0) | (np.diff(at) != 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(k) - 1]])
        size = at[last] - at[first] + self.sizes[w[k[last]]]
        text = np.searchsorted(self.start, place[first], "right") - 1
        order = np.lexsort((at[first], -size, text))
        order = order[np.concatenate([[True], np.diff(text[order]) != 0])]
        for t, n, f, d in zip(text[order].tolist(), size[order].tolist(), place[first][order].tolist(), at[first][order].tolist(), strict=True):
            if t not in best or (n, -d) > (best[t][0], -best[t][2]):
                best[t] = (n, f - int(self.start[t]), d)


class Finder:
    """Scores slices of documents against all blocks; made anew from the broadcasts in each worker."""

    def __init__(self, blocks):
        self.blocks = blocks

    def each(self) -> Iterator[Block]:
        for b in self.blocks:
            yield b.value
            if len(self.blocks) > 1 and hasattr(b, "_value"):
                del b._value  # one block in memory at a time

    def score(self, texts: list[bytes], matches: bool = True) -> list[tuple[int, int, set[str], dict[str, tuple[int, int, int]]]]:
        """(words, hit words, items, longest match by item) of each text; the last two are empty without `matches`."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a gap after each document stops matches
        edges = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in texts]
        best: list[dict[str, tuple[int, int, int]]] = [{} for _ in texts]
        for block in self.each():
            ids = np.zeros(int(starts[-1]), dtype=np.int64)
            for s, w in zip(starts[:-1].tolist(), words, strict=True):
                ids[s : s + len(w)] = np.fromiter(map(block.vocab.get, w, repeat(0)), dtype=np.int64, count=len(w))
            pos, win = block.occurrences(ids)
            if not len(pos):
                continue
            order = np.lexsort((win, pos))
            pos, win = pos[order], win[order]
            edges += np.bincount(pos, minlength=len(edges)) - np.bincount(pos + block.sizes[win], minlength=len(edges))
            if not matches:
                continue
            doc = np.searchsorted(starts, pos, "right") - 1
            cut = np.flatnonzero(np.diff(doc)) + 1
            for d, p, w in zip(doc[np.concatenate([[0], cut])].tolist(), np.split(pos, cut), np.split(win, cut), strict=True):
                for t in block.texts_of(w).tolist():
                    items[d].update(block.names[t])
                for t, m in block.longest(p - starts[d], w).items():
                    for name in block.names[t]:
                        if name not in best[d] or (m[0], -m[2]) > (best[d][name][0], -best[d][name][2]):
                            best[d][name] = m
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
        n_hit = hit[starts[1:] - 1] - hit[starts[:-1]]
        return list(zip(sizes.tolist(), n_hit.tolist(), items, best, strict=True))


def build_blocks(items: list[tuple[object, bytes]], window: int, block_bytes: int) -> Iterator[Block]:
    """Blocks of at most `block_bytes` when pickled; what is larger is halved, down to single items."""
    block = Block(items, window)
    if len(items) < 2 or len(pickle.dumps(block, protocol=5)) <= block_bytes:
        yield block
        return
    del block
    for half in (items[: len(items) // 2], items[len(items) // 2 :]):
        yield from build_blocks(half, window, block_bytes)


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark in blocks of measured size; the driver holds about BLOCK_TEXT of it at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_TEXT))
    blocks = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        items = sorted(((r[0], r[1].encode()) for r in part.toLocalIterator()), key=str)
        blocks += [spark.sparkContext.broadcast(b) for b in build_blocks(items, window, block_bytes)]
    return blocks


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: counts, the digest of the items found, and each item's longest verbatim match.

    A word is hit where any occurrence of a benchmark window (`window` consecutive words of an item; all words of a
    shorter item) covers it. Null and empty texts have no words and no hits. A null item text is no item; a null
    item_id counts as an item named by the empty string. Rows that repeat are each reported; null ids stay null.
    An empty benchmark hits nothing. Columns other than doc_id, item_id and text are ignored. Positions count words.
    """
    finder = Finder(benchmark_blocks(benchmark, window, block_bytes))

    def work(part: pa.RecordBatch) -> dict:
        got = finder.score(raw_texts(part))
        return {
            "doc_id": part.column("doc_id").cast(pa.int64()),
            "n_words": [g[0] for g in got],
            "n_hit": [g[1] for g in got],
            "n_items": [len(g[2]) for g in got],
            "items_sha256": [hashlib.sha256(",".join(sorted(g[2])).encode()).hexdigest() for g in got],
            "contaminated": [g[1] > 0 for g in got],
            "matches": pa.array([[{"item_id": i, "item_start": m[1], "doc_start": m[2], "n_words": m[0]} for i, m in sorted(g[3].items())] for g in got], type=pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))),
        }

    return map_rows(docs, ["doc_id", "text"], SCHEMA, work)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any hit word, with all their columns, whatever their names.

    Null and empty texts, null ids and repeated rows stay; an empty benchmark removes nothing; an empty table stays empty.
    """
    finder = Finder(benchmark_blocks(benchmark, window))
    return keep_rows(docs, lambda part: [g[1] == 0 for g in finder.score(raw_texts(part), matches=False)])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match")
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", longest)


#: Words as the query defines them, for the SQL below.
_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH b AS (SELECT row_number() OVER () AS bid, item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
places AS (
  SELECT bid, item_id, j, least(len(w), {WINDOW}) AS m, array_to_string(w[j:j + {WINDOW - 1}], ' ') AS s
  FROM (SELECT bid, item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, m, s FROM places),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
grams AS (
  SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT rid, p, g.m, item_id FROM grams g JOIN win USING (m, s)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT rid, p, m FROM occ)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS i FROM occ) GROUP BY rid),
runs AS (
  SELECT rid, m - 1 + count(*) AS n
  FROM (SELECT rid, bid, g.m, p - j AS diagonal, p - row_number() OVER (PARTITION BY rid, bid, g.m, p - j ORDER BY p) AS run FROM grams g JOIN places USING (m, s))
  GROUP BY rid, bid, m, diagonal, run),
longest AS (SELECT rid, max(n) AS n FROM runs GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)
"""
