"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of its pre-tokens' counts. The leaves of
a document's tree are its pre-tokens (length in characters, tokens), and every inner node holds the sums of its
children. An edit finds its leaves by descending the tree, re-encodes what it touches with the pre-tokens around it,
moves on until the new pre-tokens meet an old boundary again, and updates the sums above; the rest of the text is
neither split nor encoded again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm.common import map_rows, table

#: Pre-tokens that a bottom node of the tree sums; an edit rewrites whole bottom nodes.
LEAF = 64
#: Pre-tokens that a worker remembers the counts of.
CACHE = 200_000
EDITS = 3


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n

    def whole(self, text: str) -> int:
        """The count of a text encoded at once, without the tree."""
        return len(self.encoding.encode_ordinary(text))


class Tree:
    """Pre-tokens of one text and the sums above them."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = counter.split.findall(text)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        tokens = np.fromiter(map(counter.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        self.leaves = [(lengths[at : at + LEAF], tokens[at : at + LEAF]) for at in range(0, len(pieces), LEAF)] or [(lengths, tokens)]
        self.encoded = 0  # pre-tokens that edits have encoded
        self._build()

    def _build(self) -> None:
        """Sums bottom up: levels[0] holds (characters, tokens) of the bottom nodes, levels[-1] those of the text."""
        self.levels = [np.array([(a.sum(), b.sum()) for a, b in self.leaves], dtype=np.int64).reshape(-1, 2)]
        while len(self.levels[-1]) > 1:
            down = self.levels[-1]
            self.levels.append(np.add.reduceat(down, np.arange(0, len(down), 2), axis=0))

    def _update(self, node: int) -> None:
        a, b = self.leaves[node]
        self.levels[0][node] = a.sum(), b.sum()
        for low, up in zip(self.levels, self.levels[1:], strict=False):
            node //= 2
            up[node] = low[2 * node : 2 * node + 2].sum(axis=0)

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    @property
    def nodes(self) -> int:
        return sum(len(x) for x in self.levels)

    def find(self, at: int) -> tuple[int, int]:
        """(bottom node, its first character) of the character `at`, from the root down."""
        node, before = 0, 0
        for level in self.levels[-2::-1]:
            node *= 2
            if node + 1 < len(level) and at >= before + level[node, 0]:
                before += int(level[node, 0])
                node += 1
        return node, before

    def count_until(self, node: int) -> int:
        """Tokens of the bottom nodes before `node`: sums of the left siblings on its path."""
        total = 0
        for level in self.levels[:-1]:
            if node & 1:
                total += int(level[node - 1, 1])
            node //= 2
        return total

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start .. end (exclusive) by `new` and count again what that can have changed.

        The split is rescanned from a boundary two pre-tokens before the edit: one that white space or an
        apostrophe can join to the edit, and one more for the white space before it, which looks ahead. It stops at
        an old boundary past the edit that the new split meets twice in a row.
        """
        old = len(self.text)
        start, end = max(0, min(start, old)), max(0, min(max(start, end), old))
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(self.text) - old
        first, begin = self.find(max(0, start - 1))
        last = first
        lengths, tokens = self.leaves[first]
        ends = begin + np.cumsum(lengths)
        k = int(np.searchsorted(ends, start, "left"))  # pre-tokens that end before the edit
        back = 2
        while k - back < 0 and first:  # the context may stand in the node before
            first -= 1
            a, b = self.leaves[first]
            lengths, tokens = np.concatenate([a, lengths]), np.concatenate([b, tokens])
            begin -= int(a.sum())
            k += len(a)
        k = max(0, k - back)
        scan = begin + int(lengths[:k].sum())
        kept = (lengths[:k], tokens[:k])
        while last + 1 < len(self.leaves) and begin + int(lengths.sum()) <= end:
            last += 1
            lengths, tokens = np.concatenate([lengths, self.leaves[last][0]]), np.concatenate([tokens, self.leaves[last][1]])
        # only nodes taken in so far are known; more are taken in until the splits meet
        bounds = begin + np.concatenate([[0], np.cumsum(lengths)])
        new_l: list[int] = []
        new_t: list[int] = []
        met = False
        at = scan
        for m in self.counter.split.finditer(self.text, scan):
            new_l.append(m.end() - m.start())
            new_t.append(self.counter[m.group()])
            at = m.end()
            was = at - shift
            while was > bounds[-1] and last + 1 < len(self.leaves):
                last += 1
                a, b = self.leaves[last]
                lengths, tokens = np.concatenate([lengths, a]), np.concatenate([tokens, b])
                bounds = np.concatenate([bounds, bounds[-1] + np.cumsum(a)])
            j = int(np.searchsorted(bounds, was))
            hit = was > end and j < len(bounds) and bounds[j] == was
            if hit and met:
                break
            met = hit
        else:
            j = len(bounds) - 1
            while last + 1 < len(self.leaves):
                last += 1
                lengths, tokens = np.concatenate([lengths, self.leaves[last][0]]), np.concatenate([tokens, self.leaves[last][1]])
            j = len(lengths)
        self.encoded += len(new_l)
        lengths = np.concatenate([kept[0], np.array(new_l, np.int64), lengths[j:]])
        tokens = np.concatenate([kept[1], np.array(new_t, np.int64), tokens[j:]])
        n = last - first + 1
        if n <= len(lengths) <= 2 * LEAF * n:  # the same nodes take the new leaves; only their paths are summed again
            for node, a, b in zip(range(first, last + 1), np.array_split(lengths, n), np.array_split(tokens, n), strict=True):
                self.leaves[node] = (a, b)
                self._update(node)
        else:
            parts = max(1, -(-len(lengths) // LEAF))
            self.leaves[first : last + 1] = list(zip(np.array_split(lengths, parts), np.array_split(tokens, parts), strict=True))
            self._build()


def planned_edits(doc_id, text: str, edits: int = EDITS) -> list[tuple[int, int, str]]:
    """Edits that follow from the row alone: (start, end, new), each on the text that the one before left."""
    out = []
    size = len(text)
    for k in range(edits):
        h = zlib.crc32(f"{doc_id}:{k}".encode())
        start = h % (size + 1)
        cut = min(size - start, (h >> 8) % 24)
        new = ("", " revised", "'s ", "  \n", "123", ", and then")[(h >> 16) % 6]
        out.append((start, start + cut, new))
        size += len(new) - cut
    return out


def count_tokens(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, edits: int = EDITS) -> DataFrame:
    """Counts of every row's text before and after its planned edits, from one tree that the edits update.

    Returns doc_id, n_tokens, n_pretokens, n_nodes (tree nodes), n_edits, n_encoded (pre-tokens encoded again),
    edited_chars and edited_tokens. Null and empty texts have no tokens; edits can still insert into them. Rows that
    repeat and null ids are counted like any other. An empty table gives no rows. Other columns are ignored.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    held: list[Counter] = []  # one per worker

    def work(part: pa.RecordBatch) -> dict:
        if not held:
            held.append(Counter(ranks, pattern))
        rows = {k: [] for k in ("n_tokens", "n_pretokens", "n_nodes", "n_edits", "n_encoded", "edited_chars", "edited_tokens")}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            tree = Tree(text or "", held[0])
            rows["n_tokens"].append(tree.tokens)
            rows["n_pretokens"].append(sum(len(a) for a, _ in tree.leaves))
            rows["n_nodes"].append(tree.nodes)
            plan = planned_edits(doc_id, text or "", edits)
            for start, end, new in plan:
                tree.edit(start, end, new)
            rows["n_edits"].append(len(plan))
            rows["n_encoded"].append(tree.encoded)
            rows["edited_chars"].append(len(tree.text))
            rows["edited_tokens"].append(tree.tokens)
        return {"doc_id": part.column("doc_id").cast(pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in rows.items()}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, n_pretokens long, n_nodes long, n_edits long, n_encoded long, edited_chars long, edited_tokens long", work)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
