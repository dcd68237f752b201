"""Packing of documents into sequences of a fixed length: shortest-pack-first over the histogram of lengths.

Documents are tokenized once, where they are read; what moves after that is one small row per piece. A document
longer than a sequence is cut into full sequences and a rest. The histogram of piece lengths has at most one entry
per possible length, so the placement runs on the driver on a bounded table whatever the corpus holds: lengths go
longest first, each into the emptiest packing pattern that has room, and a pattern's count says how many sequences
share it. Patterns come back to pieces by rank: a piece's rank among those of its length picks pattern, copy and slot.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.common import materialise, parts_for, slices, table

SEQUENCE = 2048
END_ID = 1
#: Rows that one (length, salt) group of the ranking holds, about.
RANK_ROWS = 200_000
#: Words whose ids a worker remembers in each of two generations.
CACHE = 250_000
#: Marks that may close a word; a run of them is one pre-token. An apostrophe can open one with letters, so it is none.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Letters up to here keep their count and form when lower-cased one by one, and none of them composes with another.
LATIN = "\u024f"

#: Byte-level vocabularies write printable bytes of Latin-1 as they are, and the others as characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """Token ids (as little-endian unsigned 32-bit bytes) of what stands between blanks.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its parts in a row.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        self.plain = self._is_plain()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.pop(part, None)
        if ids is None:
            ids = self._new(part)
        if len(self) >= CACHE:  # words that are met again move on; the others go with their generation
            self.old = dict(self)
            self.clear()
        if len(part) <= 64:
            self[part] = ids
        return ids

    def _new(self, part: str) -> bytes:
        """Ids of a word not met before. Words of Latin letters go to the tokenizer's model without its text steps."""
        if self.plain and len(part) > 1:
            body = part.rstrip(MARKS)
            if len(body) < len(part):
                if body.isalpha() and max(body) <= LATIN and len(body.lower()) == len(body):
                    return self[body] + self[part[len(body) :]]
            elif part.isalpha() and max(part) <= LATIN and len(low := part.lower()) == len(part):
                return self._letters(part) if low == part else self[low]
        return self._encode(part)

    def _encode(self, part: str) -> bytes:
        return _bytes(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        """Ids of a word of lower-case Latin letters: one pre-token, its UTF-8 bytes as the model's characters."""
        return _bytes([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARACTERS))])

    def _is_plain(self) -> bool:
        """True if the tokenizer treats Latin words as _new does, for words that hold every letter and some long ones."""
        letters = [c for c in map(chr, range(ord(LATIN) + 1)) if c.isalpha() and c.lower() == c]
        words = [a + b + "ing" for a, b in zip(letters, letters[7:] + letters[:7], strict=True)] + ["thing", "straße", "développement", "señorita" * 4]
        return all(
            self._letters(w) == self._encode(w) == (self._encode(w.upper()) if len(w.upper()) == len(w) and w.upper().lower() == w else self._encode(w)) and all(self._encode(w + m) == self._encode(w) + self._encode(m) for m in (",", "$$$", ".!?", MARKS))
            for w in words
        )

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's own: tasks that follow in one process know the words of those before."""
    return WordIds(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most `sequence` ids; every document ends with `end_id`. keep_ids adds the ids as bytes."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids = [words.of(t) + end for t in part.column("text").to_pylist()]
                cuts = [(k, at) for k, x in enumerate(ids) for at in range(0, len(x), 4 * sequence)]
                cols = {
                    "doc_id": pc.take(part.column("doc_id").cast(pa.int64()), pa.array([k for k, _ in cuts], pa.int64())),
                    "start": pa.array([at // 4 for _, at in cuts], pa.int64()),
                    "length": pa.array([min(sequence, (len(ids[k]) - at) // 4) for k, at in cuts], pa.int32()),
                    "ids_crc32": pa.array([zlib.crc32(memoryview(ids[k])[at : at + 4 * sequence]) for k, at in cuts], pa.int64()),
                    "doc_tokens": pa.array([len(ids[k]) // 4 for k, _ in cuts], pa.int64()),
                }
                if keep_ids:
                    cols["ids"] = pa.array([ids[k][at : at + 4 * sequence] for k, at in cuts], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def pack_histogram(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(copies, lengths) of each packing pattern. Shortest pack first: the emptiest pattern takes the next length."""
    open_packs: list[tuple[int, int]] = []  # (tokens in it, its number): a heap, the shortest on top
    counts: list[int] = []
    lengths: list[tuple | None] = []  # chains: (length, rest of the chain)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if open_packs and open_packs[0][0] + size <= sequence:
                full, k = heapq.heappop(open_packs)
                fits = (sequence - full) // size
                chain, put = lengths[k], min(left, counts[k])
                if put < counts[k]:  # the rest of its copies stay as they are
                    counts.append(counts[k] - put)
                    lengths.append(chain)
                    heapq.heappush(open_packs, (full, len(counts) - 1))
                counts[k], lengths[k] = put, (size, chain)
                left -= put
                if fits:
                    heapq.heappush(open_packs, (full + size, k))
            else:
                counts.append(left)
                lengths.append((size, None))
                heapq.heappush(open_packs, (size, len(counts) - 1))
                left = 0
    out = []
    for n, chain in zip(counts, lengths, strict=True):
        row = []
        while chain:
            row.append(chain[0])
            chain = chain[1]
        out.append((n, row[::-1]))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence, offset and copies of each slot of a pattern."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for n, row in patterns:
        offset = 0
        for size in row:
            by.setdefault(size, []).append((first, offset, n))
            offset += size
        first += n
    out = {}
    for size, rows in by.items():
        seq, offset, n = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        out[size] = (np.cumsum(n) - n, seq, offset, n)
    return out


def assign(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to materialised pieces. A length that most pieces share is ranked in salted groups."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `sequence` rows
    placed = spark.sparkContext.broadcast(slots(pack_histogram(histogram, sequence)))
    salts = parts_for(sum(histogram.values()), RANK_ROWS, least=64)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    group = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = group.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    keep = [c for c in pieces.columns]

    def run(batches):
        by = placed.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            seq, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                start, first, off, _ = by[s]
                k = np.searchsorted(start, rank[at], "right") - 1
                seq[at], offset[at] = first[k] + rank[at] - start[k], off[k]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.select(*keep, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document (start, length, doc_tokens) and in a sequence (sequence_id, offset).

    Every id lies in exactly one piece; a sequence's pieces follow each other without gaps from offset 0. Only the
    rest of a document that is longer than a sequence shares its sequence with others. Null and empty texts are the
    end id alone. Rows that repeat and null ids are packed like any other. An empty table gives no rows. Columns
    other than doc_id and text are ignored.
    """
    pieces = tokenize_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), sequence, end_id, keep_ids)
    return assign(materialise(pieces, "pieces"), sequence)


def padding(pieces: DataFrame, sequence: int = SEQUENCE) -> float:
    """Share of padding: sequences are filled up to `sequence`, except those whose length is a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    is_power = F.bit_count("n") == 1
    row = filled.agg(F.sum(F.when(is_power, F.col("n")).otherwise(sequence)), F.sum("n")).first()
    return 1 - row[1] / row[0] if row[0] else 0.0


def check_patterns(patterns: list[tuple[int, list[int]]], histogram: dict[int, int], sequence: int) -> bool:
    """True if the patterns hold exactly the histogram and none is too long."""
    got: Counter = Counter()
    for n, row in patterns:
        for size in row:
            got[size] += n
    return dict(got) == {k: v for k, v in histogram.items() if v} and all(sum(r) <= sequence for _, r in patterns)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"))
    return got.withColumn("length", F.col("length").cast("long"))
