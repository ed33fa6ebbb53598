"""Language-model scoring by a weighted backoff automaton.

The model has words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end token a
text. Unigrams have additive smoothing over all training tokens. Longer n-grams
(up to ORDER) have absolute discounting: a kept n-gram's probability is
(count - DISCOUNT) / count of its context, and the rest of the context's mass goes
to the next shorter context, so every context sums to one.

As an automaton, each context with kept continuations is a state, numbered; a kept
n-gram is an arc to the longest state that its words end in; every other word takes
the state's failure arc, whose weight is the backoff weight, and tries again there;
the root has all words. A text is read once from left to right: it carries its state
and adds up the weights of its arcs. (All texts of a block are read in step, long ones
in segments of SEGMENT words; a segment finds its state by reading the ORDER - 1 words
before it from the root, which is exact, as no state is longer.)

What is gathered:

* Counts are exact, over all training texts, for every word; an n-gram's key has 20
  bits more than would number all of the corpus's, so two meet with a chance of 2^-20
  each. The texts are dealt into blocks of about BLOCK_BYTES by where they lie in their
  files, the keys into buckets of equal ranges, as many as the texts' bytes ask for. A
  block sends each bucket one message with its distinct n-grams and their counts (one
  from each task that reads some of its rows); the counts meet by bucket, and the totals go back to the blocks that have the n-gram, in
  the order of its keys, which the block makes again, with its context's rank in the bucket. So neither the vocabulary nor the
  model is ever in one place. The traffic is one key for a block's distinct n-gram,
  whatever its frequency; a block's messages are never more than its n-grams.
* Every n-gram seen LEAST times or more is kept, whatever the size of the corpus (its
  parts are seen as often, so they are kept too). For each kept n-gram one of the
  blocks that have it adds to the sums of its context (how many continuations, their
  counts, their counts in the shorter context); these meet by bucket and go back to
  the blocks too. A block thus has the states, arcs and failure weights that its own
  texts can reach: its part of the automaton.

Defined cases: a null or empty text is its end token alone; a null doc_id is
hashed as an empty text; repeated rows are learnt and scored one by one; without
training tokens every word has the probability of an unseen one; an empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.store import documents, save, ship
from tabsmith.llm.textbatch import ODD, Words, mix, tidy, word_slices

ORDER = 3
DISCOUNT = 0.6
ALPHA = 0.1
#: An n-gram seen so often is kept; how many are kept has no bound.
LEAST = 2
#: Bytes of text in a block, and for each bucket of keys.
BLOCK_BYTES, BUCKET_BYTES = 5 << 20, 8 << 20
#: Bits of an n-gram's key at least, and beyond the logarithm of the corpus's words.
KEY_BITS, MORE_BITS = 48, 20
#: Words of a text that are read in one go.
SEGMENT = 256
START = np.uint64(0x9B1A6C3F52D7E845)       # the start's hash
END = np.uint64(0x2545F4914F6CDD1D)         # the end token's hash
U = np.uint64


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def blocked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, doc, held, text) and the texts' bytes; a block is a run of rows of one file, however the file is split."""
    def place(d: DataFrame) -> DataFrame:
        return d.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
                        F.col(id_col).cast("long").alias("doc"), held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    try:
        rows = place(docs)
    except AnalysisException:               # no file beneath: make some
        rows = place(save(docs.select(id_col, text_col), "lm-documents"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    size = sums.size or 0
    run = max(1, min(1 << 16, BLOCK_BYTES * max(1, sums.n) // max(1, size)))
    rows = rows.withColumn("unit", F.floor(F.col("at") / run))
    # runs of long texts are cut again
    heavy = (rows.groupBy("file", "unit").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > 2 * BLOCK_BYTES)
             .select("file", "unit", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts")))
    heavy = save(heavy, "lm-heavy")
    if heavy.limit(1).count():
        rows = rows.join(heavy, ["file", "unit"], "left")
        part = F.coalesce(F.floor((F.col("at") % run) * F.col("parts") / run), F.lit(0))
    else:
        part = F.lit(0)
    return rows.select(F.xxhash64("file", "unit", part).alias("block"), "doc", "held", "text"), size


# ------------------------------------------------------------------------ n-grams

def _sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a slice's words, each text between START and END, and the text of each."""
    n = len(words.counts)
    length = words.counts + 2
    starts = np.cumsum(length) - length
    seq = np.empty(int(length.sum()), U)
    seq[starts] = START
    seq[starts + length - 1] = END
    text = np.repeat(np.arange(n), words.counts)
    seq[np.arange(len(words.hashes)) + 2 * text + 1] = words.hashes
    return seq, np.repeat(np.arange(n), length)


def _longer(shorter: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k-grams that end at each place, from those one shorter."""
    key = np.zeros(len(seq), U)
    key[1:] = mix(shorter[:-1] * ODD + seq[1:] + U(k))
    return key


def _inside(of: np.ndarray, k: int) -> np.ndarray:
    """Whether a k-gram that ends at each place lies in one text."""
    ok = np.zeros(len(of), dtype=bool)
    ok[k - 1:] = of[k - 1:] == of[:len(of) - k + 1]
    return ok


def _numbers_out(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed as eight runs of bytes."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _numbers_in(raw: bytes, kind=np.int64) -> np.ndarray:
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _keys_out(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return _numbers_out(np.diff(keys, prepend=U(0)))


def _keys_in(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers_in(raw, U), dtype=U)


def _places_out(places: np.ndarray) -> bytes:
    """Rising places, by their differences."""
    return _numbers_out(np.diff(places, prepend=0))


def _places_in(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers_in(raw))


def _bits_in(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _cuts(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of the buckets that sorted keys fall into."""
    if not len(keys):
        return
    of = ((keys >> U(32)) * U(buckets)) >> U(32)
    at = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield int(of[lo]), lo, hi


def _runs(block: np.ndarray):
    cut = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
    return list(zip(cut[:-1], cut[1:]))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


#: Words; the contexts that are no words (the start, n-grams short of the longest); the longest n-grams.
WORDS, INNER, LONGEST = KINDS = range(3)


class Block:
    """The n-grams of a block's texts.

    ``keys`` has the sorted distinct keys of each kind, one kind after the other;
    ``place[k - 1]`` where among them the k-gram is that ends at each position, -1 for none."""

    def __init__(self, col, order: int, buckets: int, bits: int):
        parts = [(w.counts + 1, w.first, *_sequence(w)) for w in word_slices(col, fold=True)]
        self.tokens = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        seq = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, U)
        self.of = np.concatenate([p[1] + p[3] for p in parts]) if parts else np.zeros(0, np.int64)
        del parts
        self.starts = ~_inside(self.of, 2)
        self.place = [np.full(len(seq), -1, np.int32) for _ in range(order)]
        longer, key = [], seq
        for k in range(2, order + 1):
            key = _longer(key, seq, k)
            longer.append((k - 1, key, _inside(self.of, k)))
        kinds = [[(0, seq, ~self.starts)], [(0, seq, self.starts), *longer[:-1]], longer[-1:]]
        keys, at, self.cuts, self.words = [], 0, {}, 0
        for kind, members in enumerate(kinds):
            found = np.concatenate([key[ok] for _, key, ok in members] or [np.zeros(0, U)])
            if kind != WORDS:
                found &= ~U((1 << (64 - bits)) - 1)
            found, place = np.unique(found, return_inverse=True)
            lo = 0
            for k, _, ok in members:
                n = int(ok.sum())
                self.place[k][ok] = at + place[lo:lo + n]
                lo += n
            for bucket, lo, hi in _cuts(found, buckets):
                self.cuts.setdefault(bucket, {})[kind] = (at + lo, at + hi)
            keys.append(found)
            at += len(found)
            self.words = self.words or at
        self.keys = np.concatenate(keys)

    def values(self, rows: pa.Table, names: list[str]) -> list[np.ndarray]:
        """Each key's values, 0 for the keys that the mask leaves out."""
        out = [np.zeros(len(self.keys), np.int64) for _ in names]
        for r in _each(rows):
            for kind, (lo, hi) in self.cuts[r["bucket"]].items():
                at = lo + np.flatnonzero(_bits_in(r["mask"][kind], hi - lo))
                for o, name in zip(out, names):
                    if r[name][kind]:
                        o[at] = (_bits_in(r[name][kind], len(at)) if name == "mine"
                                 else _places_in(r[name][kind]) if name == "rank" else _numbers_in(r[name][kind]))
        return out


def _each(rows: pa.Table):
    """The rows of a table, one at a time."""
    for b in rows.to_batches(max_chunksize=16):
        yield from b.to_pylist()


def _message(made: dict, out, empty: bytes = b"") -> list[list[bytes]]:
    """For each of the values that ``out`` makes of a kind's range, the list of all kinds'."""
    cols = [out(*made[kind]) if kind in made else None for kind in KINDS]
    n = len(next(c for c in cols if c is not None))
    return [[empty if c is None else c[i] for c in cols] for i in range(n)]


BLOBS = pa.list_(pa.binary())
SENT = "block long, bucket int, keys array<binary>, n array<binary>"
SENT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", BLOBS), ("n", BLOBS)])


def _count(order: int, buckets: int, bits: int):
    """SENT: the count in training texts of each distinct word and n-gram of a block's texts, a message a bucket."""
    def rows(block: int, texts: list[pa.Array], held: list[np.ndarray]):
        made = Block(pa.chunked_array(texts), order, buckets, bits)
        train = ~np.concatenate(held)[made.of]
        n = sum(np.bincount(p[train & (p >= 0)], minlength=len(made.keys)) for p in made.place)
        out = []
        for bucket, kinds in made.cuts.items():
            out.append((block, bucket, *_message(kinds, lambda lo, hi: (_keys_out(made.keys[lo:hi]), _numbers_out(n[lo:hi])))))
            if len(out) == 64:
                yield from _table(out, SENT_ARROW).to_batches()
                out.clear()
        yield from _table(out, SENT_ARROW).to_batches()

    def run(batches):
        now, texts, held = None, [], []
        for b in batches:
            blocks, out = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in _runs(blocks):
                if now is not None and blocks[lo] != now:
                    yield from rows(now, texts, held)
                    texts, held = [], []
                now = int(blocks[lo])
                texts.append(b.column(2).slice(lo, hi - lo))
                held.append(out[lo:hi])
        if now is not None:
            yield from rows(now, texts, held)
    return run


TOTALS = ("block long, bucket int, mask array<binary>, rank array<binary>, total array<binary>, mine array<binary>, "
          "tokens long, words long")
TOTALS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, BLOBS) for c in ("mask", "rank", "total", "mine")),
                          ("tokens", pa.int64()), ("words", pa.int64())])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a block from its messages: Spark may read its rows in several tasks."""
    if len(parts) == 1:
        return parts[0]
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _total(sent: pa.Table) -> pa.Table:
    """TOTALS of a bucket: for each block which of its keys are kept (or training texts' words), their totals,
    whether the block is the one to add them to their contexts, and the ranks of those that can be contexts among all
    such keys of the bucket; the bucket's sums are in a row without a block."""
    bucket = sent["bucket"][0].as_py()
    rows: dict[int, list[dict]] = {}
    for r in _each(sent):
        rows.setdefault(r["block"], []).append(r)
    made: list[dict] = [{} for _ in rows]
    sums, ranked = (0, 0), 0
    for kind in KINDS:
        parts = [(i, *_joined([(_keys_in(r["keys"][kind]), _numbers_in(r["n"][kind])) for r in of if r["keys"][kind]]))
                 for i, of in enumerate(rows.values()) if any(r["keys"][kind] for r in of)]
        if not parts:
            continue
        n = np.concatenate([p[2] for p in parts])
        seen, first, place = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=n, minlength=len(seen)).astype(np.int64)
        least = 1 if kind == WORDS else LEAST
        rank = ranked - 1 + np.cumsum(total >= least)
        ranked = int(rank[-1]) + 1
        total, rank = total[place], rank[place]
        mine = first[place] == np.arange(len(place))
        if kind == WORDS:
            sums = (int(n.sum()), int((mine & (total > 0)).sum()))
        lo = 0
        for i, keys, _ in parts:
            t, m, p = (x[lo:lo + len(keys)] for x in (total, mine, rank))
            lo += len(keys)
            keep = t >= least
            made[i][kind] = (np.packbits(keep).tobytes(), b"" if kind == LONGEST else _places_out(p[keep]),
                             _numbers_out(t[keep]), np.packbits(m[keep]).tobytes())
    out = [(block, bucket, *_message(m, lambda *blobs: blobs), 0, 0) for block, m in zip(rows, made)]
    out.append((None, bucket, [], [], [], [], *sums))
    return _table(out, TOTALS_ARROW)


SUMS = "bucket int, rank binary, kids binary, counts binary, shorter binary"
SUMS_ARROW = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("rank", "kids", "counts", "shorter")])


def _context_sums(order: int, buckets: int, bits: int):
    """SUMS of the contexts of the kept n-grams that are this block's to add."""
    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(texts["text"], order, buckets, bits)
        total, mine, rank = block.values(totals, ["total", "mine", "rank"])
        sums = [np.zeros(len(block.keys), np.int64) for _ in range(3)]
        where = np.zeros(len(block.keys), np.int64)
        for k in range(1, order):
            place = block.place[k]
            at = np.flatnonzero(place >= 0)
            at = at[(mine[place[at]] > 0) & (total[place[at]] >= LEAST)]
            where[place[at]] = at                       # one position of each key
            at = at[where[place[at]] == at]
            context = block.place[k - 1][at - 1]
            for s, w in zip(sums, (None, total[place[at]], total[block.place[k - 1][at]])):
                s += np.bincount(context, weights=w, minlength=len(s)).astype(np.int64)
        out = []
        for bucket, kinds in block.cuts.items():
            at = np.concatenate([lo + np.flatnonzero(sums[0][lo:hi]) for kind, (lo, hi) in kinds.items() if kind != LONGEST]
                                or [np.zeros(0, np.int64)])
            if len(at):
                out.append((bucket, _places_out(rank[at]), *(_numbers_out(x[at]) for x in sums)))
        return _table(out, SUMS_ARROW)
    return run


STATES = "block long, bucket int, mask array<binary>, total array<binary>, kids array<binary>, counts array<binary>, shorter array<binary>"
STATES_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32())] + [(c, BLOBS) for c in ("mask", "total", "kids", "counts", "shorter")])


def _states(totals: pa.Table, sums: pa.Table) -> pa.Table:
    """STATES: the totals of a bucket's blocks with their contexts' sums."""
    parts, rows = list(_each(sums)), list(_each(totals))
    places = [[_places_in(x) if x else None for x in r["rank"]] for r in rows]
    n = 1 + max((int(p[-1]) for of in places for p in of if p is not None and len(p)), default=-1)
    all_of = [np.zeros(n + 1, np.int64) for _ in range(3)]         # one more, 0, for the keys that are no contexts
    for r in parts:
        at = _places_in(r["rank"])
        for total, c in zip(all_of, ("kids", "counts", "shorter")):
            total[at] += _numbers_in(r[c])
    out = []
    for r, of in zip(rows, places):
        made = {}
        for kind in KINDS:
            if r["total"][kind]:
                at = np.full(len(_numbers_in(r["total"][kind])), n) if of[kind] is None else of[kind]
                made[kind] = tuple(_numbers_out(x[at]) for x in all_of)
        out.append((r["block"], r["bucket"], r["mask"], r["total"], *_message(made, lambda *blobs: blobs)))
    return _table(out, STATES_ARROW)


class Automaton:
    """The states, arcs and failure arcs that one block's texts can reach.

    A state is the number of its context's key; the root comes after all keys. An arc has the number of
    its n-gram: as a state is the last words read, the arc that a word takes from it can only be the
    n-gram that ends there, one word longer than the state, so none is searched for."""

    def __init__(self, block: Block, rows: pa.Table, denominator: float):
        self.block = block
        total, kids, counts, shorter = block.values(rows, ["total", "kids", "counts", "shorter"])
        n = self.root = len(block.keys)
        self.total = total
        self.word = np.log10((total[:block.words] + ALPHA) / denominator)       # the root's arcs
        # a context's longest shorter one, and the state that a word leads to from it
        self.state = np.full(n + 1, n, np.int64)
        self.fail, self.weight = np.full(n + 1, n, np.int64), np.zeros(n + 1)
        self.length = np.zeros(n + 1, np.int8)          # a state's words
        self.arc, self.arc_weight = np.zeros(n, bool), np.zeros(n)
        self.grams = np.stack(block.place)
        where = np.zeros(n, np.int64)
        for k, place in enumerate(block.place):
            # only words, contexts with continuations and kept n-grams have a part in the automaton
            at = np.flatnonzero(place >= 0)
            if k:
                at = at[(total[place[at]] >= LEAST) | (kids[place[at]] > 0)]
            where[place[at]] = at                       # one position of each key
            at = at[where[place[at]] == at]
            keys = place[at].astype(np.int64)
            suffix = np.full(len(keys), n) if not k else block.place[k - 1][at].astype(np.int64)
            live = kids[keys] > 0
            self.state[keys] = np.where(live, keys, self.state[suffix])
            s, below = keys[live], suffix[live]
            self.fail[s], self.length[s] = self.state[below], k + 1
            used = (counts[s] - DISCOUNT * kids[s]) / np.maximum(total[s], 1)
            covered = ((shorter[s] - DISCOUNT * kids[s]) / np.maximum(total[below], 1) if k
                       else (shorter[s] + ALPHA * kids[s]) / denominator)
            self.weight[s] = np.log10(np.maximum(1 - used, 1e-9) / np.maximum(1 - covered, 1e-9))
            if k:
                kept = total[keys] >= LEAST
                g, at = keys[kept], at[kept]
                context = block.place[k - 1][at - 1].astype(np.int64)
                self.arc[g] = True
                self.arc_weight[g] = np.log10((total[g] - DISCOUNT) / total[context])

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of reading the word at a place in each state, and the states it leads to."""
        weight, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        go, s = np.arange(len(state)), state
        while len(go):
            gram = self.grams[self.length[s], at]
            end = s == self.root                        # its arcs are the words
            hit = self.arc[gram] & ~end
            weight[go[hit]] += self.arc_weight[gram[hit]]
            weight[go[end]] += self.word[gram[end]]
            done = hit | end
            after[go[done]] = self.state[gram[done]]
            go, at, s = go[~done], at[~done], s[~done]
            weight[go] += self.weight[s]                # the failure arc
            s = self.fail[s]
        return weight, after

    def read(self, segment: int) -> np.ndarray:
        """The log10 probability of each text, read from left to right."""
        block = self.block
        text = np.arange(len(block.tokens))
        pieces = -(-block.tokens // segment)
        lane = np.repeat(text, pieces)
        number = np.arange(len(lane)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.flatnonzero(block.starts)[lane]
        first = start + 1 + number * segment
        steps = np.minimum(segment, block.tokens[lane] - number * segment)
        before = np.where(number > 0, len(block.place) - 1, 0)          # words read to find the state
        state = np.where(number > 0, self.root, self.state[block.place[0][start]])
        order = np.argsort(-(steps + before), kind="stable")
        lane, first, steps, before, state = (x[order] for x in (lane, first, steps, before, state))
        score = np.zeros(len(lane))
        length = steps + before
        for t in range(int(length.max(initial=0))):
            m = int(np.searchsorted(-length, -t, side="left"))          # the lanes that go on
            weight, state[:m] = self.step(state[:m], first[:m] - before[:m] + t)
            score[:m] += np.where(t >= before[:m], weight, 0.0)
        return np.bincount(lane, weights=score, minlength=len(text))


def _scores(model: Automaton, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known words, and log10 probabilities by words alone and by the model, of each of the block's texts."""
    n = len(model.block.tokens)
    token = np.flatnonzero(~model.block.starts)
    text, word = model.block.of[token], model.block.place[0][token]
    known = np.bincount(text, weights=model.total[word] > 0, minlength=n)
    return known, np.bincount(text, weights=model.word[word], minlength=n), model.read(segment)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """SCORES of every row of ``docs``; the model is learnt from the rows that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    rows, size = blocked(docs, id_col, text_col)
    buckets = 1 + size // BUCKET_BYTES
    bits = min(64, max(KEY_BITS, size.bit_length() + MORE_BITS))
    sent = rows.select("block", "held", "text").mapInArrow(tidy(_count(order, buckets, bits)), SENT)
    totals = save(sent.groupBy("bucket").applyInArrow(_total, TOTALS), "lm-totals", free_shuffle=True)
    sums = totals.where("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words"))).first()
    tokens, vocabulary = sums.tokens, sums.words
    denominator = max(tokens + ALPHA * (vocabulary + 1), ALPHA)
    totals = totals.where("block IS NOT NULL").drop("tokens", "words")
    # written, so that the texts' first shuffle does not lie on disk beside the second
    contexts = save(rows.groupBy("block").cogroup(totals.select("block", "bucket", "mask", "total", "mine", "rank").groupBy("block"))
                    .applyInArrow(_context_sums(order, buckets, bits), SUMS), "lm-contexts", free_shuffle=True)
    states = totals.drop("mine").groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(_states, STATES)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        block = Block(texts["text"], order, buckets, bits)
        n_known, base, scores = _scores(Automaton(block, known, denominator), SEGMENT)
        return pa.table({"doc_id": texts["doc"], "held_out": texts["held"], "n_tokens": block.tokens.astype(np.int64),
                         "n_known": n_known.astype(np.int64), "train_tokens": np.full(len(n_known), tokens, np.int64),
                         "base_score": base, "score": scores})

    return rows.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(score, SCORES)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
