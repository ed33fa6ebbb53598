"""Portable SQL for the fixtures and small SQL-text helpers used by the
DuckDB oracle queries (``plans/oracle_sql.py``)."""

from __future__ import annotations

DIRTY_LINEITEM = """dirty AS (
  WITH base AS (
    SELECT l_orderkey, l_linenumber,
      CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
      CASE WHEN l_orderkey % 11 = 0 THEN NULL
           WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 20
           ELSE l_extendedprice END AS l_extendedprice,
      l_discount, l_tax,
      CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
      l_linestatus
    FROM lineitem)
  SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 50 = 0)"""

# (name, spark dtype, class) of the dirty_lineitem columns, in order
DIRTY_COLUMNS = [
    ("l_orderkey", "bigint", "numeric"),
    ("l_linenumber", "int", "numeric"),
    ("l_quantity", "double", "numeric"),
    ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"),
    ("l_tax", "double", "numeric"),
    ("l_returnflag", "string", "categorical"),
    ("l_linestatus", "string", "categorical"),
]

EVENTS_COLUMNS = [
    ("event_id", "bigint", "numeric"),
    ("ts", "timestamp", "other"),
    ("user_id", "bigint", "numeric"),
    ("event_type", "string", "categorical"),
    ("value", "double", "numeric"),
    ("props", "string", "categorical"),
]

TURN_LOG = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS query, a.text AS output
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
    ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn)"""

QUERY_LOG = """qlog AS (
  SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user')"""


def dtype_sql(column: str) -> str:
    """Spark's type name of a DuckDB column, from its runtime type."""
    t = f"typeof(any_value({qi(column)}))"
    return (f"CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
            f"WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' "
            f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' WHEN 'FLOAT' THEN 'float' "
            f"WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' "
            f"ELSE lower({t}) END")


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r4(expr: str, digits: int = 4) -> str:
    return f"round_even(({expr})::DOUBLE, {digits})"


def pct_sql(part: str, whole: str, digits: int) -> str:
    return (f"round_even(CASE WHEN ({whole}) = 0 THEN NULL ELSE "
            f"({part})::DOUBLE * 100.0 / ({whole})::DOUBLE END, {digits})")


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


EMBEDDINGS_COLUMNS = [
    ("vec_id", "bigint", "numeric"),
    ("embedding", "array<float>", "other"),
    ("label", "int", "numeric"),
]

DOCUMENTS_COLUMNS = [
    ("doc_id", "bigint", "numeric"),
    ("text", "string", "categorical"),
    ("lang", "string", "categorical"),
    ("source", "string", "categorical"),
    ("n_chars", "bigint", "numeric"),
]
