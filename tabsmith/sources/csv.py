"""CSV ingestion with pandas-like parsing rules (IO1-IO3), on Spark's CSV reader.

* Every field is read as a string against the header's width plus one extra
  column: a row that fills the extra column is longer than the header and is
  skipped (pandas' ``on_bad_lines="skip"``); a short row keeps NULLs (pandas
  pads). No ``DROPMALFORMED`` (it drops short rows too).
* pandas' NA tokens become NULL; types are inferred in one aggregate that
  counts, per column, the non-missing cells failing ``try_cast`` to bigint,
  double and the boolean spellings: bigint when all pass and nothing is
  missing, double when all pass as numbers (an integer column with a gap is
  float64 in pandas), boolean only for complete True/False columns, string
  otherwise. Dates stay strings, as pandas leaves them.
* Encodings are tried in order; whether the bytes are UTF-8 is asked of the raw
  lines, which also show quoted line breaks. The long-row count and the type
  inference are one aggregate, so a file is read twice before the typed frame.
  Separators are tried in order; the first that splits the header into more
  than one column wins (the last one is accepted anyway).
* A number is what pandas takes for one: ``12f`` and ``7d`` stay text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.sources.quoted_lines import quoted_records

# FIXED VALUES: pandas' default missing-value tokens and boolean spellings
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
TRUE_VALUES = ["True", "TRUE", "true"]
FALSE_VALUES = ["False", "FALSE", "false"]

ENCODINGS = ("utf-8", "latin-1", "cp1252")
# Spark's names for the encodings; cp1252 is not offered by Spark's CSV reader
# (and is unreachable anyway: latin-1 decodes every byte sequence)
SPARK_CHARSETS = {"utf-8": "utf-8", "latin-1": "iso-8859-1", "cp1252": None}
SEPARATORS = (",", ";", "\t")
EXTRA = "__extra_field"
# FIXED VALUES: what pandas takes for numbers (Java's cast would also take 12f, 7d)
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def normalize_labels(names: list[str]) -> list[str]:
    """IO3: labels as text; the 2nd, 3rd copy of ``c`` become ``c_1``, ``c_2``.
    Repeated until unique ignoring case (Spark resolves names
    case-insensitively), so ``[a, a, a_1]`` does not collide."""
    out: list[str] = []
    taken: set[str] = set()
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        c = str(raw) if raw not in (None, "") else f"Unnamed: {i}"
        name = c
        while name.lower() in taken:
            seen[c] = seen.get(c, 0) + 1
            name = f"{c}_{seen[c]}"
        taken.add(name.lower())
        out.append(name)
    return out


def _reader(spark: SparkSession, encoding: str, sep: str, multiline: bool):
    return (spark.read.option("encoding", encoding).option("sep", sep)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline)
            .option("mode", "PERMISSIVE"))


def read_header(spark: SparkSession, path: str, encoding: str, sep: str,
                multiline: bool = False) -> list[str]:
    """The first record of the file (the header), parsed as CSV."""
    first = _reader(spark, encoding, sep, multiline).option("header", False).csv(path).limit(1).collect()
    if not first:
        return []
    return [v if v is not None else "" for v in first[0]]


def _raw(spark, path, encoding, sep, n, multiline):
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)]
                          + [T.StructField(EXTRA, T.StringType())])
    return (_reader(spark, encoding, sep, multiline).option("header", True)
            .option("enforceSchema", True).schema(schema).csv(path))


def _raw_quoted(spark, path, encoding, sep, n) -> DataFrame | None:
    """Like ``_raw`` for files with quoted line breaks, from any number of splits."""
    records = quoted_records(spark, path, sep, encoding)
    if records is None:
        return None
    fields = ", ".join(f"c{i} string" for i in range(n)) + f", {EXTRA} string"
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return records.where(~F.col("first")).select(F.from_csv("text", fields, options).alias("r")).select("r.*")


def _na_cleaned(raw: DataFrame, n: int) -> DataFrame:
    """Rows no longer than the header, pandas' NA tokens as NULL."""
    na = F.array(*[F.lit(t) for t in NA_TOKENS])
    good = raw.filter(F.col(EXTRA).isNull())
    return good.select(*[F.when(F.array_contains(na, F.col(f"c{i}")), F.lit(None))
                          .otherwise(F.col(f"c{i}")).alias(f"c{i}") for i in range(n)])


def _scan(raw: DataFrame, n: int) -> dict:
    """One aggregate over the raw rows: long rows, and per column the missing
    cells and cast failures of the kept rows."""
    na = F.array(*[F.lit(t) for t in NA_TOKENS])
    keep = F.col(EXTRA).isNull()
    aggs = [F.count_if(~keep).alias("long"), F.count_if(keep).alias("rows")]
    for i in range(n):
        raw_v = F.col(f"c{i}")
        v = F.when(keep & ~F.coalesce(F.array_contains(na, raw_v), F.lit(False)), raw_v)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.isNotNull() & (~v.rlike(INTEGER) | v.try_cast("bigint").isNull())).alias(f"bi{i}"),
            F.count_if(v.isNotNull() & ~v.rlike(NUMBER)).alias(f"db{i}"),
            F.count_if(v.isNotNull() & ~v.isin(TRUE_VALUES + FALSE_VALUES)).alias(f"bo{i}"),
        ]
    return raw.agg(*aggs).collect()[0].asDict()


def _types(row: dict, n: int) -> list[str]:
    types = []
    for i in range(n):
        present, rows = row[f"n{i}"], row["rows"]
        if present == 0:
            types.append("double")          # an all-missing column is float64
        elif row[f"bi{i}"] == 0:
            types.append("bigint" if present == rows else "double")
        elif row[f"db{i}"] == 0:
            types.append("double")
        elif row[f"bo{i}"] == 0 and present == rows:
            types.append("boolean")
        else:
            types.append("string")
    return types


def _typed(df: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    out = []
    for i, (name, t) in enumerate(zip(names, types)):
        v = F.col(f"c{i}")
        if t == "boolean":
            e = F.when(v.isin(TRUE_VALUES), True).when(v.isin(FALSE_VALUES), False)
        elif t == "string":
            e = v
        else:
            e = F.trim(v).try_cast(t)
        out.append(e.alias(name))
    return df.select(*out)


def _probe(spark: SparkSession, path: str) -> tuple[bool, bool, bool]:
    """Whether the bytes are UTF-8; whether a line has an odd number of quotes (a
    quoted field goes on in the next line); whether a carriage return stands
    alone (it ends a line for the whole-file reader), from the raw lines."""
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    alone = F.locate("\r", F.regexp_replace(line, "\r$", "")) > 0
    row = spark.read.option("lineSep", "\n").text(path).agg(
        F.count_if(~F.is_valid_utf8(line)).alias("bad"), F.count_if(quotes % 2 == 1).alias("odd"),
        F.count_if(alone).alias("alone")).first()
    return not row["bad"], bool(row["odd"]), bool(row["alone"])


def load_csv(spark: SparkSession, path: str, encodings=ENCODINGS, seps=SEPARATORS,
             on_bad: str = "skip", multiline: bool | None = None) -> DataFrame:
    """IO1 / IO2: read a CSV file or folder into a typed DataFrame.

    ``on_bad="skip"`` drops rows longer than the header; ``"fail"`` raises
    when one exists (the upload endpoint's behaviour). Quoted line breaks are
    found and parsed unless ``multiline`` says otherwise; files that have them
    are split like others (``sources.quoted_lines``). Only files that also use
    lone carriage returns, or have more splits than the scan of their states
    holds, are read by a single task each.
    """
    last_error = None
    is_utf8, breaks, alone = _probe(spark, path)
    if multiline is None:
        multiline = breaks
    for name in encodings:
        enc = SPARK_CHARSETS.get(name.lower(), name)
        if enc is None or (enc.lower() in ("utf-8", "utf8") and not is_utf8):
            continue                        # the bytes do not decode: next encoding
        for k, sep in enumerate(seps):
            try:
                header = read_header(spark, path, enc, sep, multiline)
            except Exception as e:  # noqa: BLE001 - unreadable with this encoding
                last_error = e
                continue
            if not header:
                raise ValueError("CSV is empty or has no valid rows")
            if len(header) < 2 and k < len(seps) - 1:
                continue
            n = len(header)
            raw = _raw_quoted(spark, path, enc, sep, n) if multiline and not alone else None
            if raw is None:
                raw = _raw(spark, path, enc, sep, n, multiline)
            stats = _scan(raw, n)           # the only pass before the typed read
            if on_bad == "fail" and stats["long"]:
                raise ValueError("CSV has rows with more fields than the header")
            return _typed(_na_cleaned(raw, n), normalize_labels(header), _types(stats, n))
    raise ValueError(f"Could not parse CSV with common encodings/separators ({last_error})")


def require_nonempty(df: DataFrame) -> DataFrame:
    """IO4: error on zero columns or zero rows (one ``LIMIT 1`` probe)."""
    if len(df.columns) == 0:
        raise ValueError("CSV has no columns")
    if df.isEmpty():
        raise ValueError("CSV is empty or has no valid rows")
    return df


def write_csv(df: DataFrame, path: str, whole_texts: bool = False) -> str:
    """Write a frame as CSV with a header (used to derive CSV inputs).
    ``whole_texts`` quotes like pandas: doubled quotes, white space and line breaks kept."""
    out = df.write.mode("overwrite").option("header", True)
    if whole_texts:
        out = (out.option("quote", '"').option("escape", '"').option("quoteAll", True)
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    out.csv(path)
    return path


def labels_frame(df: DataFrame) -> DataFrame:
    """Rename a frame's columns with ``normalize_labels``."""
    return df.toDF(*normalize_labels(df.columns))

