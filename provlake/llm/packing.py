"""Operator 8, packing: sequences balanced by linear plus quadratic attention cost.

A document becomes token ids plus one end id. What exceeds whole sequences is cut off as
full sequences; remainders gather in a bounded buffer of a task. The buffer opens as many
sequences as its tokens need and deals pieces, longest first, each to the sequence of
least cost with room for it. A piece that fits nowhere whole is cut over the sequences
with most room, so that a buffer leaves less than one sequence of padding. There is no
shuffle: every task packs what it reads, whatever the sizes of sources or copies.

Defined results: a null text is an empty one and gives just the end id; a null doc_id and
repeated rows are packed like any other row; an empty table gives no rows; other columns
of the input are ignored. Very long texts become many full sequences. Ties: of pieces of
one length the one read first is dealt first, and of sequences of one cost the first
opened takes it, so that equal tasks give equal sequences.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import bounded_batches
from provlake.llm._text import LOWER, SAME, Tokens, batches_of, text_buffers

MAX_TOKENS = 2048
END_ID = 1
BUFFER_SEQUENCES = 256
#: words whose ids a worker keeps, over all the tasks it runs
CACHE_WORDS = 500_000
ENCODED_AT_ONCE = 5_000
#: letters and digits of ASCII, and its signs but for the apostrophe, which can belong to a word, and those of special tokens
_ALNUM, _SIGN = (np.array([x < 128 and f(chr(x)) for x in range(256)]) for f in (str.isalnum, lambda c: "!" <= c <= "~" and not c.isalnum() and c not in "'<|>"))
#: cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
MAX_VOCABULARY_BYTES = 64 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


class Encoder:
    """Token ids by words. The tokenizer drops white space, lower-cases, and parts letters from
    signs before its model sees them, so that a text's ids are the ids of its words and runs
    of signs in order; each distinct one is encoded once."""

    kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """The encoder of this worker, with what it has learnt in earlier tasks."""
        key = hashlib.sha256(vocabulary.encode()).hexdigest()
        if key not in cls.kept:
            cls.kept = {key: cls(vocabulary)}
        return cls.kept[key]

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.clear()

    def clear(self) -> None:
        #: ids of all words on end; place 0 is the end of a text
        self.flat, self.start, self.length = array("I", [END_ID]), array("q", [0]), array("q", [1])
        #: two sorted tables, of most words and of the latest: fingerprints, and places in start and length
        self.most = self.latest = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], prints: np.ndarray) -> np.ndarray:
        """The place of each fingerprint, -1 where it is not in the table."""
        known, place = table
        if not len(known):
            return np.full(len(prints), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
        return np.where(known[at] == prints, place[at], -1)

    @staticmethod
    def union(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        known, place = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(known)
        return known[order], place[order]

    def learn(self, prints: np.ndarray, words: list[str]) -> np.ndarray:
        """Encodes new words; their places."""
        places = np.arange(len(self.start), len(self.start) + len(words))
        for at in range(0, len(words), ENCODED_AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(words[at : at + ENCODED_AT_ONCE], add_special_tokens=False):
                ids = e.ids
                self.start.append(len(self.flat))
                self.length.append(len(ids))
                self.flat.extend(ids)
        self.latest = self.union(self.latest, (prints, places))
        if len(self.latest[0]) > CACHE_WORDS // 10:
            self.most, self.latest = self.union(self.most, self.latest), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        return places

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows on end, offsets of the rows)."""
        special = b"<|" in text_buffers(column)[0].tobytes()  # special tokens are not lower-cased
        t = Tokens(column, fold=SAME if special else LOWER, apart=(_ALNUM, _SIGN))
        distinct, first, place = np.unique(t.h, return_index=True, return_inverse=True)
        if len(self.start) + len(distinct) > CACHE_WORDS:
            self.clear()
        found = self.find(self.most, distinct)
        found = np.where(found < 0, self.find(self.latest, distinct), found)
        new = np.flatnonzero(found < 0)
        begin, end = t.start[first[new]].tolist(), t.end[first[new]].tolist()
        found[new] = self.learn(distinct[new], [t.raw[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)])
        words = np.insert(found[place], t.first[1:], 0)
        start, length = np.frombuffer(self.start, dtype=np.int64)[words], np.frombuffer(self.length, dtype=np.int64)[words]  # copies: no view is kept
        ends = np.cumsum(length)
        ids = np.frombuffer(self.flat, dtype=np.uint32)[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends[np.cumsum(t.n + 1) - 1]))


def deal(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) and nothing lost: see the module's text."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    room, cost = np.full(n, capacity, dtype=np.int64), np.zeros(n)
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        at, left = 0, int(lengths[i])
        while left:
            fits = np.flatnonzero(room >= left)
            if len(fits):
                s, take = int(fits[np.argmin(cost[fits])]), left
            else:
                s = int(np.argmax(room))
                take = int(room[s])
            out.append((int(i), at, take, s, int(capacity - room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            at, left = at + take, left - take
    return out


def pack(docs: DataFrame, vocabulary_path: str, max_tokens: int = MAX_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, buffer_sequences: int = BUFFER_SEQUENCES) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence."""
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary exceeds the broadcast bound")
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder, task, made = Encoder.of(vocabulary.value), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held: list[tuple] = []
        tokens = 0

        def row(doc, start, ids, total, sequence, offset, cost):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, (task << 36) + sequence, offset, cost))

        def flush():
            nonlocal made, tokens
            if held:
                dealt = deal(np.array([len(x[2]) for x in held], dtype=np.int64), max_tokens, linear, quadratic)
                cost: dict[int, float] = {}
                for _, _, n, s, _ in dealt:
                    cost[s] = cost.get(s, 0.0) + linear * n + quadratic * n * n
                for i, at, n, s, offset in dealt:
                    doc, start, ids, total = held[i]
                    row(doc, start + at, ids[at : at + n], total, made + s, offset, cost[s])
                made += len(cost)
                held.clear()
                tokens = 0

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.float64() if k == 7 else pa.int64()) for k in range(8)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        for part in batches_of(batches, "text"):
            every, at = encoder.ids(part.column(1))
            for k, doc in enumerate(part.column(0).to_pylist()):
                ids = every[at[k] : at[k + 1]]
                full = len(ids) // max_tokens
                for j in range(full):
                    row(doc, j * max_tokens, ids[j * max_tokens : (j + 1) * max_tokens], len(ids), made, 0, linear * max_tokens + quadratic * max_tokens**2)
                    made += 1
                if len(ids) > full * max_tokens:
                    held.append((doc, full * max_tokens, ids[full * max_tokens :], len(ids)))
                    tokens += len(held[-1][2])
                    if tokens >= buffer_sequences * max_tokens:
                        flush()
            if rows:
                yield batch()
        flush()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
