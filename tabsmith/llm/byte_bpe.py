"""Byte-level BPE with a rank queue under a hierarchical bitmap.

The pre-tokens of a batch lie end to end as one doubly linked list of pieces.
Every pair of neighbours that has a merge rank is put into that rank's bucket;
a bitmap over the ranks, with a bitmap over its words and one over those, gives
the lowest rank with a bucket by three find-first-set steps. Taking a bucket
merges all its pairs at once; entries whose pair has changed since are stale and
skipped; the new neighbours' pairs go into their buckets. So the work follows
the number of merges, not length times merges, however long a pre-token is.

The merges equal taking the lowest rank, leftmost first, in each pre-token
alone. Merging all pairs of a rank together could differ only where the merged
piece forms a pair of a still lower rank; such ranks are found from the
vocabulary, and of those only the leftmost pair of each pre-token is merged.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows and extra columns are kept; a clash with a result name is solved
by renaming the input's column (an underscore in front).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.store import documents, free_name, ship
from tabsmith.llm.units import UnitCache, byte_units, text_groups

#: Rows that are handled, and handed on, together; units a worker caches (some 100 MB).
OUT_ROWS, CACHE = 1000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteDecoder:
    """The bytes of each id of a rank file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = bytearray(int(self.offsets[-1]))
        for token, rank in ranks.items():
            flat[self.offsets[rank]:self.offsets[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        a = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(a):
            return b""
        sizes = self.lengths[a]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.offsets[a] - (ends - sizes), sizes)
        return self.flat[at].tobytes()


class RankQueue:
    """Buckets of list positions by merge rank."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        words = -(-ranks // 64)
        self.low = [0] * words
        self.mid = [0] * -(-words // 64)
        self.top = 0

    def push(self, rank: int, positions) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = [0, *cut.tolist(), len(ranks)]
        firsts = ranks[at[:-1]].tolist()
        for k, rank in enumerate(firsts):
            self.push(rank, positions[at[k]:at[k + 1]])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with a bucket, and the bucket's positions."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = (a << 6) | ((m & -m).bit_length() - 1)
        w = self.low[b]
        rank = (b << 6) | ((w & -w).bit_length() - 1)
        self.low[b] = w & (w - 1)
        if not self.low[b]:
            self.mid[a] &= m - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


class ByteBpe(UnitCache):
    """Encoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        super().__init__(byte_units, CACHE)
        ranks = read_ranks(path)
        self.matches = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs, early = {}, set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
                    if rank < max(a, b):
                        early.add(max(a, b))
        #: Ranks whose merged piece can be in a pair of a lower rank.
        self.early = early
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # an open table of the pairs: a few probes, all vectorized
        self.bits = max(4, (4 * len(self.keys)).bit_length())
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_rank = np.full(1 << self.bits, -1, np.int64)
        self._fill()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self) -> None:
        todo, slot = np.arange(len(self.keys)), self._slot(self.keys)
        mask = (1 << self.bits) - 1
        self.probes = 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.table_key[at] < 0
            chosen = todo[free]
            self.table_key[slot[chosen]] = self.keys[chosen]      # of several for one slot the last wins
            won = self.table_key[slot[todo]] == self.keys[todo]
            self.table_rank[slot[todo[won]]] = self.values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 for none."""
        keys = a << 32 | b
        slot = self._slot(keys)
        found = self.table_key[slot]
        out = np.where(found == keys, self.table_rank[slot], -1)
        go = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(go):
                break
            slot[go] = (slot[go] + 1) & ((1 << self.bits) - 1)
            found = self.table_key[slot[go]]
            hit = found == keys[go]
            out[go[hit]] = self.table_rank[slot[go[hit]]]
            go = go[~hit & (found >= 0)]
        return out

    def encode_pretokens(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        if not tokens:
            return []
        sizes = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        n = len(raw)
        ids = np.append(self.byte[raw], -1)                 # the last place stands for "no neighbour"
        word = np.append(np.repeat(np.arange(len(tokens)), sizes), -1)
        right = np.append(np.arange(1, n + 1), n)
        left = np.append(np.arange(-1, n - 1), n)
        left[0] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        queue = RankQueue(self.size)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank = self.ranks(ids[at], ids[at + 1])
        ok = rank >= 0
        if ok.any():
            queue.push_all(rank[ok], at[ok])
        while (item := queue.pop()) is not None:
            rank, at = item
            if len(at) > 1:
                at = np.unique(at)
            nxt = right[at]
            # a position whose pair is no longer of this rank is stale
            ok = alive[at] & (word[nxt] == word[at])
            at, nxt = at[ok], nxt[ok]
            ok = self.ranks(ids[at], ids[nxt]) == rank
            at, nxt = at[ok], nxt[ok]
            if not len(at):
                continue
            if len(at) > 1:
                if rank in self.early:                      # the leftmost of each pre-token, then look again
                    first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                    if not first.all():
                        queue.push(rank, at[~first])
                    at, nxt = at[first], nxt[first]
                else:
                    chained = np.concatenate([[False], nxt[:-1] == at[1:]])
                    if chained.any():                       # a a a: every second of a run, from its left end
                        start = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
                        take = (np.arange(len(at)) - start) % 2 == 0
                        at, nxt = at[take], nxt[take]
            ids[at] = rank
            alive[nxt] = False
            far = right[nxt]
            right[at] = far
            inner = far < n
            left[far[inner]] = at[inner]
            before = left[at]
            a = np.concatenate([before, at])
            b = np.concatenate([at, far])
            ok = (a < n) & (b < n)
            a, b = a[ok], b[ok]
            ok = word[a] == word[b]
            a, b = a[ok], b[ok]
            if len(a):
                new = self.ranks(ids[a], ids[b])
                ok = new >= 0
                if ok.any():
                    queue.push_all(new[ok], a[ok])
        alive = alive[:n]
        kept = ids[:n][alive]
        ends = np.cumsum(np.bincount(word[:n][alive], minlength=len(tokens)))
        return np.split(kept, ends[:-1])

    def find(self, units: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each unit, from those of its pattern matches."""
        matches = [self.matches(u) for u in units]
        known = self.cache
        distinct = list({m for ms in matches for m in ms if m not in known})
        ids = self.encode_pretokens([m.encode("utf-8", "surrogatepass") for m in distinct])
        new = dict(zip(distinct, (x.astype("<u4").tobytes() for x in ids)))
        value = lambda m: new[m] if m in new else known[m]
        return [value(ms[0]) if len(ms) == 1 else b"".join(map(value, ms)) for ms in matches]


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder; its cache serves all tasks the worker runs."""
    return ByteBpe(path, pattern)


@lru_cache(maxsize=4)
def byte_decoder(path: str) -> ByteDecoder:
    return ByteDecoder(path)


def _with_column(docs: DataFrame, source: str, name: str, kind: T.DataType, convert) -> DataFrame:
    if name in docs.columns:
        docs = docs.withColumnRenamed(name, free_name(docs.columns, name))
    at = docs.columns.index(source)
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, OUT_ROWS):
                b = batch.slice(i, OUT_ROWS)
                made = pa.array(convert(b.column(at)), arrow)
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, ranks: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` plus the ids of its texts (binary, little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)

    def convert(col):
        bpe = byte_bpe(ranks, pattern)
        texts = col.to_pylist()
        return [ids for _, group in text_groups(texts, texts) for ids in bpe.encode(group)]

    return _with_column(docs, text_col, ids_col, T.BinaryType(), convert)


def decode(tokens: DataFrame, ranks: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``tokens`` plus the bytes its ids stand for."""
    ship(tokens.sparkSession)

    def convert(col):
        decoder = byte_decoder(ranks)
        return [decoder.decode(x or b"") for x in col.to_pylist()]

    return _with_column(tokens, ids_col, bytes_col, T.BinaryType(), convert)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern).drop("text")
    return decode(ids, ranks).select(
        "doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
