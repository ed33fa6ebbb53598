"""CSV records whose quoted fields hold line breaks, read in parallel.

A file is read as lines in byte ranges (Spark's own splits). Whether a line
begins inside a quoted field depends on everything before it, so each range is
read under both assumptions: one pass gives, for each range, the state it ends
in from either start. A prefix scan over the ranges picks the right start of
each, and a second pass joins lines to records. A record that crosses a border
leaves its pieces on both sides; those pieces, at most two a range, are put
together by file.

A quote opens a field only at its beginning; inside, a doubled quote is a quote;
after the closing quote the field goes on to the separator (pandas' rules, and
those of Spark's own reader).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.session import save_once

#: Ranges whose start states the driver scans and sends to tasks: 24 bytes each, 128 TB at Spark's 128 MB.
MAX_RANGES = 1_000_000

QUOTE = '"'


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted field is still open after ``line``, given whether one is at its start."""
    i = 0
    while True:
        if not inside:
            if line.startswith(QUOTE, i):
                inside, i = True, i + 1
                continue
            i = line.find(sep, i)
            if i < 0:
                return False
            i += len(sep)
            continue
        i = line.find(QUOTE, i)
        if i < 0:
            return True
        if line.startswith(QUOTE, i + 1):
            i += 2
            continue
        inside, i = False, line.find(sep, i + 1)
        if i < 0:
            return False
        i += len(sep)


def _runs(batch):
    """(file, start, first row, end row) of the ranges in a batch."""
    import numpy as np
    if not batch.num_rows:
        return []
    file, start = (batch.column(i).to_numpy() for i in (1, 2))
    cut = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    cut = [0, *cut.tolist(), batch.num_rows]
    return [(int(file[a]), int(start[a]), a, b) for a, b in zip(cut[:-1], cut[1:])]


def _quoted(column) -> list[int]:
    """The rows that have a quote."""
    import numpy as np
    import pyarrow.compute as pc
    return np.flatnonzero(pc.match_substring(column, QUOTE).to_numpy(zero_copy_only=False)).tolist()


def _states(sep: str):
    """(file, start, from_out, from_in): the state each range ends in."""
    def run(batches):
        import pyarrow as pa
        now, out, within = None, False, True

        def row():
            return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "from_out": out, "from_in": within}])

        for b in batches:
            text, marked = b.column(0), _quoted(b.column(0))
            k = 0
            for file, start, first, end in _runs(b):
                if now != (file, start):
                    if now is not None:
                        yield row()
                    now, out, within = (file, start), False, True
                while k < len(marked) and marked[k] < end:
                    line = text[marked[k]].as_py()
                    same = out == within
                    out = ends_inside(line, sep, out)
                    within = out if same else ends_inside(line, sep, within)
                    k += 1
        if now is not None:
            yield row()
    return run


WHOLE, HEAD, TAIL = 0, 1, 2         # a record; the end of one begun before the range; the beginning of one


def _records(sep: str):
    """(text, file, start, kind, first) of records and pieces; ``first`` marks a file's first record."""
    def run(batches):
        import pyarrow as pa
        now, held, kind, fresh = None, None, WHOLE, False       # held: the lines of an open record

        def table(rows):
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            names = ("text", "file", "start", "kind", "first")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

        def piece():
            return ("\n".join(held), *now, HEAD if kind == HEAD else TAIL, fresh)

        for b in batches:
            lines, inside, rows = b.column(0).to_pylist(), b.column(3), []
            marked, k = _quoted(b.column(0)), 0
            for file, start, i, end in _runs(b):
                if now != (file, start):
                    if held is not None:
                        rows.append(piece())
                    now, held, kind, fresh = (file, start), None, WHOLE, start == 0
                    if inside[i].as_py():
                        held, kind = [], HEAD
                while i < end:
                    q = marked[k] if k < len(marked) and marked[k] < end else end       # the next line with a quote
                    if held is not None:
                        held += lines[i:q]
                    elif i < q:
                        rows.append((lines[i], file, start, WHOLE, fresh))
                        fresh = False
                        rows += [(x, file, start, WHOLE, False) for x in lines[i + 1:q]]
                    if q == end:
                        break
                    open_ = ends_inside(lines[q], sep, held is not None)
                    if held is None:
                        held = []
                    held.append(lines[q])
                    if not open_:
                        rows.append(("\n".join(held), file, start, kind, fresh))
                        held, kind, fresh = None, WHOLE, False
                    i, k = q + 1, k + 1
            yield table(rows)
        if held is not None:
            yield table([piece()])
    return run


def quoted_records(spark: SparkSession, path: str, sep: str, charset: str) -> DataFrame | None:
    """(text, first) of all records of a file or folder, blank lines left out; None beyond MAX_RANGES ranges."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if charset == "utf-8" else F.decode(F.col("value").cast("binary"), charset)
    lines = raw.select(value.alias("text"), F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start"))
    ends = lines.mapInArrow(_states(sep), "file long, start long, from_out boolean, from_in boolean")
    ends = ends.orderBy("file", "start").limit(MAX_RANGES + 1).collect()
    if len(ends) > MAX_RANGES:
        return None
    opened, before = [], (None, False)
    for r in ends:                      # the prefix scan: a range ends by what it was started in
        inside = before[1] if before[0] == r.file else False
        if inside:
            opened.append((r.file, r.start, True))
        before = (r.file, r.from_in if inside else r.from_out)
    starts = spark.createDataFrame(opened, "file long, start long, inside boolean")
    # a broadcast join leaves each range's lines in order
    told = (lines.join(F.broadcast(starts), ["file", "start"], "left")
            .select("text", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside")))
    found = told.mapInArrow(_records(sep), "text string, file long, start long, kind int, first boolean")
    return _stitched(save_once(found, "csv-pieces"))


def _stitched(found: DataFrame) -> DataFrame:
    """The records, with the pieces of one record put together."""
    pieces = found.where(F.col("kind") != WHOLE)
    by = Window.partitionBy("file").orderBy("start", "kind")
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == TAIL).cast("long")).over(by))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    joined = (numbered.groupBy("file", "record")
              .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"), F.max("first").alias("first"))
              .select("text", "first"))
    both = found.where(F.col("kind") == WHOLE).select("text", "first").unionByName(joined)
    text = F.when(F.endswith("text", F.lit("\r")), F.substring("text", F.lit(1), F.char_length("text") - 1)).otherwise(F.col("text"))
    return both.select(text.alias("text"), "first").where(F.trim(F.regexp_replace("text", r"[\t\r]", "")) != "")
