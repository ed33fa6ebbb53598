"""DuckDB oracle SQL for the ingestion and dataset queries."""

from __future__ import annotations

from tabsmith.plans.sql_fixtures import DIRTY_COLUMNS, DIRTY_LINEITEM, dtype_sql, lit, qi, r4

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    "l_shipdate"]
LINEITEM_DOUBLES = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def _dirty_rounded(types=None):
    types = types or {}
    out = []
    for c, t, _ in DIRTY_COLUMNS:
        t = types.get(c, t)
        if t == "double":
            out.append(f"{r4(qi(c))} AS {qi(c)}")
        elif t == "bigint":
            out.append(f"{qi(c)}::BIGINT AS {qi(c)}")
        else:
            out.append(qi(c))
    return ", ".join(out)


def load_csv():
    return f"WITH {DIRTY_LINEITEM}\nSELECT {_dirty_rounded({'l_linenumber': 'bigint'})} FROM dirty"


def load_csv_texts():
    na = ", ".join(lit(t) for t in NA_TOKENS)
    cells = ", ".join(f"CASE WHEN {c} IN ({na}) THEN NULL ELSE {c} END AS {c}" for c in ("text", "lang", "source"))
    return f"SELECT doc_id, {cells} FROM documents"


#: FIXED VALUES: pandas' default missing-value tokens (the oracle's own copy)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def normalize_labels():
    return ("SELECT l_orderkey, l_partkey AS l_orderkey_1, l_suppkey AS l_orderkey_2, "
            "l_linenumber FROM lineitem")


def require_nonempty():
    return "SELECT * FROM orders"


def decode_labels():
    return ("SELECT n.*, r.r_name AS region_name FROM nation n "
            "LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")


def preview():
    cols = ", ".join(f"{r4(c)} AS {c}" if c in LINEITEM_DOUBLES else c for c in LINEITEM_COLUMNS)
    return f"SELECT {cols} FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 8"


def column_list():
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", {dtype_sql(c)} AS type "
           f"FROM lineitem" for i, c in enumerate(LINEITEM_COLUMNS)]
    return "\nUNION ALL\n".join(sel)


def save_version():
    return f"WITH {DIRTY_LINEITEM}\nSELECT {_dirty_rounded()} FROM (SELECT DISTINCT * FROM dirty)"


def frames_differ():
    return f"""WITH {DIRTY_LINEITEM},
dd AS (SELECT DISTINCT * FROM dirty),
a AS (SELECT count(*) AS n FROM (SELECT * FROM dirty EXCEPT ALL SELECT * FROM dd)),
b AS (SELECT count(*) AS n FROM (SELECT * FROM dd EXCEPT ALL SELECT * FROM dirty))
SELECT (a.n + b.n > 0) AS differs, (SELECT count(*) FROM dirty)::BIGINT AS rows_a,
       (SELECT count(*) FROM dd)::BIGINT AS rows_b, a.n::BIGINT AS only_in_a,
       b.n::BIGINT AS only_in_b FROM a, b"""


def profile_versions():
    from tabsmith.plans.oracle_sql import dataset_summary, describe_statistics
    return (f"SELECT s.*, d.count AS count, d.mean, d.std, d.min, d.max FROM ({dataset_summary()}) s "
            f"JOIN ({describe_statistics()}) d USING (ordinal) UNION ALL "
            f"SELECT s.*, (n_rows - missing)::BIGINT, NULL, NULL, NULL, NULL FROM ({dataset_summary()}) s "
            f"WHERE ordinal NOT IN (SELECT ordinal FROM ({describe_statistics()}))")


def describe_rollup():
    stats = ", ".join(f"{r4(f'{f}(value)')} AS {n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    return (f"SELECT event_type, 'value' AS \"column\", count(*)::BIGINT AS rows, count(value)::BIGINT AS count, {stats} "
            "FROM events GROUP BY event_type")


def io_sql() -> dict[str, str]:
    return {
        "load_csv": load_csv(),
        "load_csv_strict": load_csv(),
        "load_csv_texts": load_csv_texts(),
        "normalize_labels": normalize_labels(),
        "require_nonempty": require_nonempty(),
        "decode_labels": decode_labels(),
        "preview": preview(),
        "column_list": column_list(),
        "save_version": save_version(),
        "frames_differ": frames_differ(),
        "profile_versions": profile_versions(),
        "describe_rollup": describe_rollup(),
    }
