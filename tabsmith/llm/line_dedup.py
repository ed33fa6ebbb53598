"""Line deduplication over a sharded minimal perfect hash.

1. Each document emits the distinct 128-bit hashes of its long line keys; one
   aggregate counts the documents of every key and finds its largest doc_id.
2. The repeated keys are dealt into shards by hash. Each shard becomes a minimal
   perfect hash (a cascade of bit arrays with rank counts) that indexes compact
   arrays: fingerprint, document count, keeper. A shard holds about SHARD_KEYS
   keys whatever the corpus, since hashes deal evenly.
3. Documents probe the arrays. An index of at most ``broadcast_bytes`` goes to
   every executor; a larger one stays distributed, and the documents' line
   hashes visit the shards instead. Both ways drop the same lines.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased. Keys with at least ``min_chars`` code points in at least
``min_docs`` different documents lose all their lines except in the largest
doc_id that holds them (there every copy stays).

Defined cases: a null or empty text is one empty line and stays as an empty
text; an empty table gives an empty result; rows that repeat a doc_id count as
one document; a null doc_id counts as smaller than any other. Columns of the
input are kept as they are; a clash with a result name is solved by renaming
the input's column (an underscore in front).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.store import documents, free_name, save, ship
from tabsmith.llm.textbatch import tidy

SHARD_KEYS = 50_000
#: Bytes an index entry takes: fingerprint 8, count 4, keeper 8, and under 6 bits of hash.
ENTRY_BYTES = 21
BLANK = b" \t\n\x0b\x0c\r"
NO_DOC = -(1 << 63)
U = np.uint64


# ---------------------------------------------------------------- keys of lines

def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(BLANK)
    if len(key) < min_chars or not (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())      # bytes.lower() folds A-Z only


def _texts(col: pa.Array) -> list[bytes]:
    return [t or b"" for t in col.cast(pa.large_binary()).to_pylist()]


def _emit_keys(min_chars: int):
    def run(batches):
        for b in batches:
            ids, digests = [], []
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                seen = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                digests.extend(seen)
                ids.extend([doc] * len(seen))
            a = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(ids, pa.int64())], names=["h1", "h2", "doc"])
    return run


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n, keeper) of the keys found in at least ``min_docs`` documents."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("doc"))
    keys = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("doc"), F.col(text_col).alias("text"))
    rows = keys.mapInArrow(tidy(_emit_keys(min_chars)), "h1 long, h2 long, doc long")
    # ids alone: rows that repeat an id need a distinct count, which costs another shuffle
    if ids.groupBy("doc").count().where("count > 1").limit(1).count():
        rows = rows.distinct()
    return (rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
            .where(F.col("n") >= min_docs))


# ---------------------------------------------------------- minimal perfect hash

def _level_slots(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h ^ U((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> U(33))) % U(size)).astype(np.int64)


class ShardIndex:
    """A minimal perfect hash over distinct 64-bit numbers, and the arrays it indexes.

    Level i has two slots per key still unplaced; a key alone in its slot is
    placed there, the others go on. A key's place is the rank of its slot among
    all set bits, so n keys have the places 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray], fingerprint, count, keeper):
        self.levels, self.fingerprint, self.count, self.keeper = levels, fingerprint, count, keeper
        # rank of the first bit of each 512-bit block, over all levels
        self.ranks, base = [], 0
        for bits in levels:
            per = np.bitwise_count(bits).astype(np.int64)
            pad = -len(per) % 64
            blocks = np.concatenate([per, np.zeros(pad, np.int64)]).reshape(-1, 64).sum(axis=1)
            at = base + np.concatenate([[0], np.cumsum(blocks)])
            self.ranks.append(at)
            base = int(at[-1])

    @classmethod
    def build(cls, h: np.ndarray, fingerprint, count, keeper) -> ShardIndex:
        levels, left = [], h
        while len(left):
            size = max(64, 2 * len(left))
            slots = _level_slots(left, len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[slots]]
        index = cls(levels, fingerprint, count, keeper)
        place = index.places(h)
        order = np.empty(len(h), np.int64)
        order[place] = np.arange(len(h))
        index.fingerprint, index.count, index.keeper = fingerprint[order], count[order], keeper[order]
        return index

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each number; -1 for some (not all) numbers that are no keys."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        n = len(self.fingerprint)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            left = n if level == 0 else n - int(ranks[0])
            slots = _level_slots(h[todo], level, max(64, 2 * left))
            hit = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
            s = slots[hit]
            first = (s >> 9) << 6
            # count the set bits from the block's start up to the slot
            inside = np.zeros(len(s), np.int64)
            byte = s >> 3
            for k in range(64):
                at = first + k
                whole = at < byte
                if not whole.any():
                    break
                inside += np.where(whole, np.bitwise_count(bits[np.minimum(at, len(bits) - 1)]), 0)
            below = bits[byte] & ((1 << (s & 7)) - 1).astype(np.uint8)
            out[todo[hit]] = ranks[s >> 9] + inside + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't in the index."""
        place = self.places(h1.view(np.uint64))
        ok = place >= 0
        ok[ok] = self.fingerprint[place[ok]] == h2[ok]
        return np.where(ok, place, -1)

    def to_bytes(self) -> bytes:
        head = struct.pack("<qq", len(self.fingerprint), len(self.levels))
        sizes = struct.pack(f"<{len(self.levels)}q", *map(len, self.levels))
        return b"".join([head, sizes, *(x.tobytes() for x in self.levels), self.fingerprint.astype("<i8").tobytes(),
                         self.count.astype("<i4").tobytes(), self.keeper.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, blob: bytes) -> ShardIndex:
        n, k = struct.unpack_from("<qq", blob)
        sizes = struct.unpack_from(f"<{k}q", blob, 16)
        at, levels = 16 + 8 * k, []
        for size in sizes:
            levels.append(np.frombuffer(blob, np.uint8, size, at))
            at += size
        arrays = []
        for kind in ("<i8", "<i4", "<i8"):
            arrays.append(np.frombuffer(blob, kind, n, at))
            at += arrays[-1].nbytes
        return cls(levels, *arrays)


def _shard_of(h1, shards: int):
    return F.pmod(F.col(h1), F.lit(shards)).cast("int")


def build_index(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(shard, blob) rows and the number of shards for (h1, h2, n, keeper) rows."""
    shards = max(1, -(-n_keys // SHARD_KEYS))

    def build(pdf):
        import pandas as pd
        # two keys with the same first half cannot share a slot: the later ones go to an exact overflow list
        pdf = pdf.sort_values(["h1", "h2"])
        twin = pdf.duplicated("h1", keep="first")
        main, rest = pdf[~twin], pdf[twin]
        index = ShardIndex.build(main.h1.to_numpy().view(np.uint64), main.h2.to_numpy(),
                                 np.minimum(main.n.to_numpy(), 2**31 - 1).astype(np.int32), main.keeper.to_numpy())
        over = rest[["h1", "h2", "keeper"]].to_numpy(np.int64).tobytes()
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "blob": [index.to_bytes()], "over": [over]})

    dealt = keys.withColumn("shard", _shard_of("h1", shards))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, blob binary, over binary"), shards


class LineIndex:
    """Some shards of an index, ready to be probed."""

    def __init__(self, rows, shards: int):
        self.shards = shards
        self.index = {s: ShardIndex.from_bytes(blob) for s, blob, _ in rows}
        self.over = {(a, b): k for _, _, over in rows
                     for a, b, k in np.frombuffer(over, "<i8").reshape(-1, 3).tolist()}

    def keepers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For (n, 2) keys: whether each is in the index, and its keeper."""
        found, keeper = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        shard = np.mod(keys[:, 0], self.shards)
        for s in np.unique(shard).tolist():
            if s not in self.index:
                continue
            at = np.flatnonzero(shard == s)
            index = self.index[s]
            place = index.probe(np.ascontiguousarray(keys[at, 0]), keys[at, 1])
            hit = place >= 0
            found[at[hit]] = True
            keeper[at[hit]] = index.keeper[place[hit]]
        if self.over:
            for i, key in enumerate(map(tuple, keys.tolist())):
                if key in self.over:
                    found[i], keeper[i] = True, self.over[key]
        return found, keeper


# -------------------------------------------------------------------- documents

def _drop_lines(min_chars: int, lines_at: int, text_at: int, id_at: int, verdict):
    """A mapInArrow function that drops the lines ``verdict`` names.

    verdict(batch, keys, docs) has True for each (key, document) to drop."""
    def run(batches):
        for b in batches:
            ids = [NO_DOC if i is None else i for i in b.column(id_at).cast(pa.int64()).to_pylist()]
            split = [t.split(b"\n") for t in _texts(b.column(text_at))]
            where, keys = [], []
            for d, lines in enumerate(split):
                for i, line in enumerate(lines):
                    if k := line_key(line, min_chars):
                        where.append((d, i))
                        keys.append(k)
            dropped = [0] * len(split)
            if keys:
                a = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                docs = np.array([ids[d] for d, _ in where], np.int64)
                for at in np.flatnonzero(verdict(b, a, docs, where)).tolist():
                    d, i = where[at]
                    split[d][i] = None
                    dropped[d] += 1
            kept = pa.array([b"\n".join(x for x in lines if x is not None) for lines in split], pa.binary())
            cols = [b.column(i) for i in range(lines_at)]
            cols[text_at] = kept.cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([len(x) for x in split], pa.int64()), pa.array(dropped, pa.int64())],
                names=[*b.schema.names[:lines_at], "n_lines", "n_dropped"])
    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40,
               min_docs: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with repeated lines dropped from the text, plus n_lines and n_dropped (long)."""
    spark = docs.sparkSession
    ship(spark)
    for name in ("n_lines", "n_dropped"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs.columns, name))
    keys = save(repeated_keys(docs, id_col, text_col, min_chars, min_docs), "line-keys")
    n_keys = keys.count()
    index, shards = build_index(keys, n_keys)
    fields = [*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema),
              T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType(fields)
    at = {"text_at": docs.columns.index(text_col), "id_at": docs.columns.index(id_col), "lines_at": len(docs.columns)}
    if n_keys * ENTRY_BYTES <= broadcast_bytes:
        rows = spark.sparkContext.broadcast([tuple(r) for r in index.collect()])
        ready: dict[str, LineIndex] = {}

        def by_index(batch, keys, docs, where):
            if "index" not in ready:
                ready["index"] = LineIndex(rows.value, shards)
            found, keeper = ready["index"].keepers(keys)
            return found & (keeper != docs)

        return docs.mapInArrow(tidy(_drop_lines(min_chars, verdict=by_index, **at)), schema)
    index = save(index, "line-index")
    return _routed(docs, index, shards, id_col, text_col, min_chars, at, schema)


def _routed(docs, index, shards, id_col, text_col, min_chars, at, schema) -> DataFrame:
    """The same result when the index is too large to go to every executor."""
    lines = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("doc"), F.col(text_col).alias("text"))
             .mapInArrow(tidy(_emit_keys(min_chars)), "h1 long, h2 long, doc long")
             .distinct()
             .withColumn("shard", _shard_of("h1", shards)))

    def probe(lines_pdf, index_pdf):
        import pandas as pd
        if not len(index_pdf) or not len(lines_pdf):
            return pd.DataFrame({"doc": [], "h1": [], "h2": []}).astype("int64")
        part = LineIndex([(r.shard, r.blob, r.over) for r in index_pdf.itertuples()], shards)
        found, keeper = part.keepers(lines_pdf[["h1", "h2"]].to_numpy(np.int64))
        return lines_pdf.loc[found & (keeper != lines_pdf.doc.to_numpy()), ["doc", "h1", "h2"]]

    # a shard's lines come in as many sub-groups as keep each at about a shard's number of keys
    subs = max(1, -(-lines.count() // (shards * 20 * SHARD_KEYS)))
    lines = lines.withColumn("sub", F.pmod(F.col("doc"), F.lit(subs)).cast("int"))
    dealt = index.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    drops = (lines.groupBy("shard", "sub").cogroup(dealt.groupBy("shard", "sub"))
             .applyInPandas(probe, "doc long, h1 long, h2 long")
             .groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("__drops")))
    key = free_name(docs.columns, "doc")
    joined = (docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)))
              .join(drops.withColumnRenamed("doc", key), key, "left")
              .select(*docs.columns, "__drops"))

    def by_list(batch, keys, docs, where):
        drops = [{(x["h1"], x["h2"]) for x in row or ()} for row in batch.column(batch.num_columns - 1).to_pylist()]
        return np.array([tuple(k) in drops[d] for k, (d, _) in zip(keys.tolist(), where)])

    return joined.mapInArrow(tidy(_drop_lines(min_chars, verdict=by_list, **at)), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.i, k.line, (h.key IS NOT NULL AND h.keeper <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
