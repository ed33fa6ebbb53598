"""Vector bin packing of token sequences.

Examples are placed under simultaneous limits on tokens, segments and
loss-bearing tokens. The next example of a sequence is the one among the pool
that fits and has the largest dot product of its demand with the sequence's
residual capacity, each dimension weighed by the pool's mean demand. If none
fits whole, the best one is cut to fill the sequence; its rest stays in the pool.
Where loss is limited below the tokens, examples longer than a sequence come in
pieces of half of one, so that a piece that bears loss finds one that does not.

Every task packs the documents it reads, with a pool of at most ``pool``
examples, so nothing is shuffled and memory is bounded. What a task has left
over at its end is cut into sequences with a power of two of tokens, which need
no padding; with a binding segment or loss limit some padding can remain.

Defined cases: a null or empty text is its end id alone; rows that repeat a
doc_id are packed as separate documents, as are rows with a null doc_id, whose
pieces have a null doc_id; equal examples tie, and the one in the pool's first
place goes first; an empty table gives no pieces. Other columns of the input are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.store import documents, ship
from tabsmith.llm.textbatch import tidy
from tabsmith.llm.units import CACHE_UNITS, text_groups, word_encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@dataclass
class Piece:
    """``length`` ids of an example from ``start`` on; ``bears``: running counts of its loss-bearing ids."""
    key: object
    ids: np.ndarray
    start: int
    length: int
    total: int
    bears: np.ndarray | None

    def loss(self, length: int | None = None) -> int:
        n = self.length if length is None else length
        if self.bears is None:
            return max(0, n - 1)            # a piece's first id has nothing before it to learn from
        return int(self.bears[self.start + n] - self.bears[self.start])

    def fit(self, tokens: int, loss: int) -> int:
        """The longest start of this piece within the limits."""
        n = min(tokens, self.length)
        if self.bears is None:
            return min(n, loss + 1)
        return int(np.searchsorted(self.bears[self.start:self.start + n + 1], self.bears[self.start] + loss, "right")) - 1

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.key, self.ids, self.start, n, self.total, self.bears),
                Piece(self.key, self.ids, self.start + n, self.length - n, self.total, self.bears))


class VectorPacker:
    """Packs a stream of examples; yields sequences as lists of pieces."""

    def __init__(self, limits: Limits, pool: int = 512):
        self.limits, self.size = limits, pool
        self.pool: list[Piece | None] = [None] * (pool + 1)
        self.need = np.zeros((pool + 1, 3))          # shares of the limits
        self.free = list(range(pool, -1, -1))
        self.cap = np.array([limits.tokens, limits.segments, max(1, limits.loss)], float)

    def _put(self, piece: Piece) -> None:
        k = self.free.pop()
        self.pool[k] = piece
        self.need[k] = piece.length / self.cap[0], 1 / self.cap[1], piece.loss() / self.cap[2]

    def _take(self, k: int) -> Piece:
        piece, self.pool[k] = self.pool[k], None
        self.need[k] = 0
        self.free.append(k)
        return piece

    def add(self, key, ids: np.ndarray, mask: np.ndarray | None = None, bears: np.ndarray | None = None) -> Iterator[list[Piece]]:
        """``bears``: the running counts of ``mask``, where the caller has them."""
        if mask is not None:
            bears = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        rest = Piece(key, ids, 0, len(ids), len(ids), bears)
        # with a loss limit below the tokens, pieces of half a sequence: one that bears loss finds one that doesn't
        most = self.limits.tokens if bears is None or self.limits.loss >= self.limits.tokens else self.limits.tokens // 2
        while rest.length > self.limits.tokens:
            n = max(1, rest.fit(most, self.limits.loss))
            head, rest = rest.cut(n)
            if n == self.limits.tokens:
                yield [head]
            else:                                   # it shares a sequence
                yield from self._store(head)
        yield from self._store(rest)

    def _store(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece.loss() > self.limits.loss:
            n = max(1, piece.fit(piece.length, self.limits.loss))
            head, piece = piece.cut(n)
            self._put(head)
            if not self.free:
                yield self._sequence()
        self._put(piece)
        while not self.free:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        out: list[Piece] = []
        left = np.ones(3)
        weight = self.need.mean(axis=0)
        used = np.flatnonzero(self.need[:, 1])
        while len(used):
            need = self.need[used]
            fits = (need <= left + 1e-9).all(axis=1)
            score = need @ (left * weight)
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1.0)))
                left = left - need[at]
                out.append(self._take(int(used[at])))
                used = np.delete(used, at)
                if left[0] < 0.5 / self.cap[0]:
                    break
                continue
            tokens = round(left[0] * self.cap[0])
            if tokens <= 0 or left[1] * self.cap[1] < 0.5:
                break
            at = int(np.argmax(score))
            n = self.pool[used[at]].fit(tokens, max(0, round(left[2] * self.cap[2])))
            if n > 0:
                head, rest = self._take(int(used[at])).cut(n)
                out.append(head)
                if rest.length:
                    self._put(rest)
            break
        return out

    def flush(self) -> Iterator[list[Piece]]:
        while len(self.free) <= self.size:
            pieces = self._sequence()
            total = sum(p.length for p in pieces)
            for bit in range(total.bit_length() - 1, -1, -1):      # binary parts of the length
                if not total & (1 << bit):
                    continue
                part, want = [], 1 << bit
                while want:
                    if pieces[0].length > want:
                        head, pieces[0] = pieces[0].cut(want)
                    else:
                        head = pieces.pop(0)
                    part.append(head)
                    want -= head.length
                yield part


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("padded", pa.int64()), ("loss_tokens", pa.int64())])
PIECES_DDL = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
              "offset long, padded long, loss_tokens long")


def _padded(length: int, tokens: int) -> int:
    return length if length & (length - 1) == 0 else tokens


def pack_stream(examples: Iterable, limits: Limits, pool: int, task: int) -> Iterator[pa.RecordBatch]:
    """Record batches of pieces for the examples of one task: (key, ids, mask) or (key, ids, None, running counts)."""
    packer = VectorPacker(limits, pool)
    rows: list[tuple] = []
    made = 0

    def write(pieces: list[Piece]) -> None:
        nonlocal made
        number, offset = (task << 33) + made, 0
        made += 1
        padded = _padded(sum(p.length for p in pieces), limits.tokens)
        for p in pieces:
            ids = p.ids[p.start:p.start + p.length].astype("<u4").tobytes()
            rows.append((p.key, p.start, p.length, ids, p.total, number, offset, padded, p.loss()))
            offset += p.length

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
        rows.clear()
        return out

    for key, *example in examples:
        for pieces in packer.add(key, *example):
            write(pieces)
            if len(rows) >= 1024:
                yield batch()
    for pieces in packer.flush():
        write(pieces)
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 1, limits: Limits = Limits(), prompt: float = 0.0, pool: int = 512,
                   cache_units: int = CACHE_UNITS, keep_cache: bool = True) -> DataFrame:
    """Pieces of all documents (``PIECES_DDL``), tokenized by a word-BPE file and ended by ``end_id``.

    The first ``prompt`` of a document's ids bear no loss. A worker keeps the ids of
    ``cache_units`` units (some 150 bytes each), for its next tasks too if ``keep_cache``."""
    ship(docs.sparkSession)

    def examples(batches):
        encoder = word_encoder(tokenizer)
        encoder.limit = cache_units
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in batches:
            for keys, texts in text_groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for key, ids in zip(keys, encoder.encode(texts)):
                    ids = np.frombuffer(ids + end, encoder.dtype)
                    bears = np.maximum(np.arange(len(ids) + 1, dtype=np.int32) - int(prompt * len(ids)), 0) if prompt else None
                    yield key, ids, None, bears
        if not keep_cache:
            encoder.cache.clear()

    def run(batches):
        yield from pack_stream(examples(batches), limits, pool, TaskContext.get().partitionId())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run if keep_cache else tidy(run), PIECES_DDL)


def pack_examples(examples: DataFrame, *, id_col: str = "id", ids_col: str = "ids", mask_col: str = "loss_mask",
                  limits: Limits = Limits(), pool: int = 512) -> DataFrame:
    """Pieces of instruction examples: ``ids`` array<int>, ``loss_mask`` array<boolean> of equal
    length (null: all but a piece's first id bear loss). A null or empty ``ids`` gives no piece."""
    ship(examples.sparkSession)

    def rows(batches):
        for b in batches:
            for key, ids, mask in zip(*(b.column(i).to_pylist() for i in range(3))):
                if ids:
                    yield key, np.array(ids, "<u4"), None if mask is None else np.array([bool(x) for x in mask])

    def run(batches):
        yield from pack_stream(rows(batches), limits, pool, TaskContext.get().partitionId())

    return examples.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>"),
                           F.col(mask_col).cast("array<boolean>")).mapInArrow(run, PIECES_DDL)


def piece_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


#: The query's documents are read as instruction data: the first half is the prompt, the second bears loss.
PROMPT = 0.5
LIMITS = Limits(tokens=2048, segments=10, loss=1536)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return piece_digest(pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                                       limits=LIMITS, prompt=PROMPT))
