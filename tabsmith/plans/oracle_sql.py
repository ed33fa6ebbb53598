"""DuckDB oracle SQL, one statement per registered query.

Each statement restates the operator's definition in plain SQL over the
driver's views (lineitem, events, conversations, ...), independent of the
Spark code. Doubles are rounded half-to-even to 4 decimals on both sides.
"""

from __future__ import annotations

from tabsmith.plans.sql_fixtures import (DIRTY_COLUMNS, DIRTY_LINEITEM, DOCUMENTS_COLUMNS,
                                         EMBEDDINGS_COLUMNS, dtype_sql, lit, pct_sql, qi, r4,
                                         union_all)

from tabsmith.plans.oracle_charts import charts_sql  # noqa: E402
from tabsmith.plans.oracle_querylog import querylog_sql  # noqa: E402
from tabsmith.plans.oracle_ml import ml_sql  # noqa: E402
from tabsmith.plans.oracle_io import io_sql  # noqa: E402

NUMERIC_DIRTY = [c for c in DIRTY_COLUMNS if c[2] == "numeric"]
CATEGORICAL_DIRTY = [c for c in DIRTY_COLUMNS if c[2] == "categorical"]


def _ordinal(cols, name):
    return [c[0] for c in cols].index(name) + 1


def _miss_aggs(cols):
    return ", ".join(f"count(*) FILTER (WHERE {qi(n)} IS NULL) AS m{i + 1}, "
                     f"{dtype_sql(n)} AS t{i + 1}" for i, (n, _, _) in enumerate(cols))


DUPS = "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))"


def dataset_summary() -> str:
    n = len(DIRTY_COLUMNS)
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", t{i + 1} AS dtype, "
           f"m{i + 1}::BIGINT AS missing, {pct_sql(f'm{i + 1}', 'n_rows', 1)} AS missing_pct, "
           f"n_rows::BIGINT AS n_rows, {n}::BIGINT AS n_columns, "
           f"dups::BIGINT AS duplicate_rows FROM agg"
           for i, (c, _, _) in enumerate(DIRTY_COLUMNS)]
    return (f"WITH {DIRTY_LINEITEM},\nagg AS (SELECT count(*) AS n_rows, {DUPS} AS dups, "
            f"{_miss_aggs(DIRTY_COLUMNS)} FROM dirty)\n{union_all(sel)}")


def _describe_selects(cols, all_cols, digits=4):
    sel = []
    for c, _, _ in cols:
        o = _ordinal(all_cols, c)
        x = f"{qi(c)}::DOUBLE"
        sel.append(
            f"SELECT {o}::BIGINT AS ordinal, {lit(c)} AS \"column\", count({x})::BIGINT AS count, "
            f"{r4(f'avg({x})', digits)} AS mean, {r4(f'stddev_samp({x})', digits)} AS std, "
            f"{r4(f'min({x})', digits)} AS min, "
            f"{r4(f'quantile_cont({x}, 0.25)', digits)} AS p25, "
            f"{r4(f'quantile_cont({x}, 0.5)', digits)} AS p50, "
            f"{r4(f'quantile_cont({x}, 0.75)', digits)} AS p75, "
            f"{r4(f'max({x})', digits)} AS max FROM dirty")
    return sel


def describe_statistics(digits: int = 4) -> str:
    return (f"WITH {DIRTY_LINEITEM}\n"
            f"{union_all(_describe_selects(NUMERIC_DIRTY, DIRTY_COLUMNS, digits))}")


def _value_counts_cte(cols, all_cols, table="dirty"):
    pairs = union_all([f"SELECT {_ordinal(all_cols, c)}::BIGINT AS ordinal, {lit(c)} AS \"column\", "
                       f"{qi(c)}::VARCHAR AS value FROM {table}" for c, _, _ in cols])
    return (f"pairs AS ({pairs}),\n"
            f"counts AS (SELECT ordinal, \"column\", value, count(*) AS cnt FROM pairs "
            f"WHERE value IS NOT NULL GROUP BY ordinal, \"column\", value)")


def top_values(k: int = 5) -> str:
    return (f"WITH {DIRTY_LINEITEM},\n{_value_counts_cte(CATEGORICAL_DIRTY, DIRTY_COLUMNS)},\n"
            f"ranked AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY cnt DESC, value) "
            f"AS rnk, count(*) OVER (PARTITION BY ordinal) AS nu FROM counts)\n"
            f"SELECT ordinal, \"column\", nu::BIGINT AS nunique, rnk::BIGINT AS rank, value, "
            f"cnt::BIGINT AS count FROM ranked WHERE rnk <= {k}")


def describe_all() -> str:
    num = [f"SELECT ordinal, \"column\", count, NULL::BIGINT AS unique, NULL::VARCHAR AS top, "
           f"NULL::BIGINT AS freq, mean, std, min, p25, p50, p75, max FROM ({s})"
           for s in _describe_selects(NUMERIC_DIRTY, DIRTY_COLUMNS)]
    cat = (f"SELECT ordinal, \"column\", sum(cnt)::BIGINT AS count, count(*)::BIGINT AS unique, "
           f"arg_min(value, (-cnt, value)) AS top, max(cnt)::BIGINT AS freq, "
           + ", ".join(f"NULL::DOUBLE AS {s}" for s in ("mean", "std", "min", "p25", "p50", "p75", "max"))
           + " FROM counts GROUP BY ordinal, \"column\"")
    return (f"WITH {DIRTY_LINEITEM},\n{_value_counts_cte(CATEGORICAL_DIRTY, DIRTY_COLUMNS)}\n"
            f"{union_all(num + [cat])}")


def _corr_pairs_selects(cols, table="dirty", absolute=True):
    sel = []
    for i, (a, _, _) in enumerate(cols):
        for j, (b, _, _) in enumerate(cols):
            if i < j:
                r = f"corr({qi(a)}::DOUBLE, {qi(b)}::DOUBLE)"
                r = f"CASE WHEN isnan({r}) THEN NULL ELSE {r} END"
                sel.append(f"SELECT {i + 1}::BIGINT AS i, {j + 1}::BIGINT AS j, {lit(a)} AS col_x, "
                           f"{lit(b)} AS col_y, {r} AS r FROM {table}")
    return sel


def correlation_pairs(k: int = 10) -> str:
    return (f"WITH {DIRTY_LINEITEM},\npairs AS ({union_all(_corr_pairs_selects(NUMERIC_DIRTY))})\n"
            f"SELECT i, j, col_x, col_y, {r4('r')} AS r, {r4('abs(r)')} AS abs_r FROM pairs "
            f"ORDER BY abs(r) DESC NULLS LAST, i, j LIMIT {k}")


def nunique() -> str:
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", "
           f"count(DISTINCT {qi(c)})::BIGINT AS nunique FROM dirty"
           for i, (c, _, _) in enumerate(DIRTY_COLUMNS)]
    return f"WITH {DIRTY_LINEITEM}\n{union_all(sel)}"


def column_classes() -> str:
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", {dtype_sql(c)} AS dtype, "
           f"{lit(k)} AS class FROM dirty" for i, (c, _, k) in enumerate(DIRTY_COLUMNS)]
    return f"WITH {DIRTY_LINEITEM}\n{union_all(sel)}"


def extract_schema() -> str:
    n = len(DIRTY_COLUMNS)
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", t{i + 1} AS dtype, "
           f"{lit(k)} AS class, m{i + 1}::BIGINT AS missing, n_rows::BIGINT AS n_rows, "
           f"{n}::BIGINT AS n_columns FROM agg" for i, (c, _, k) in enumerate(DIRTY_COLUMNS)]
    return (f"WITH {DIRTY_LINEITEM},\nagg AS (SELECT count(*) AS n_rows, "
            f"{_miss_aggs(DIRTY_COLUMNS)} FROM dirty)\n{union_all(sel)}")


def schema_text() -> str:
    cols = DIRTY_COLUMNS
    names = ", ".join(c for c, _, _ in cols)
    num = ", ".join(c for c, _, k in cols if k == "numeric") or "None"
    cat = ", ".join(c for c, _, k in cols if k == "categorical") or "None"
    head = [f"'Dataset: ' || n_rows || ' rows × {len(cols)} columns'", lit("Columns: " + names),
            lit("Numeric columns: " + num), lit("Categorical columns: " + cat), lit("Data types:")]
    body = [f"'  - {c}: ' || t{i + 1} || ' (missing: ' || m{i + 1} || ')'"
            for i, (c, _, _) in enumerate(cols)]
    sel = [f"SELECT {i + 1}::BIGINT AS line_no, {t} AS text FROM agg"
           for i, t in enumerate(head + body)]
    return (f"WITH {DIRTY_LINEITEM},\nagg AS (SELECT count(*) AS n_rows, "
            f"{_miss_aggs(cols)} FROM dirty)\n{union_all(sel)}")


def rich_schema() -> str:
    names = ", ".join(c for c, _, _ in DIRTY_COLUMNS)
    return (f"WITH {DIRTY_LINEITEM}\nSELECT '\nDATASET DETAILS:\n\nColumns: {names}\n\n"
            f"Total Rows: ' || count(*) || '\nTotal Columns: {len(DIRTY_COLUMNS)}\n\n"
            f"IMPORTANT RULES:\n- Always use ONLY these column names\n"
            f"- Do NOT assume dataset structure\n- Match user query words with column names\n' "
            f"AS text FROM dirty")


def summary_counters() -> str:
    miss = " + ".join(f"count(*) FILTER (WHERE {qi(c)} IS NULL)" for c, _, _ in DIRTY_COLUMNS)
    return (f"WITH {DIRTY_LINEITEM}\nSELECT count(*)::BIGINT AS n_rows, "
            f"{len(DIRTY_COLUMNS)}::BIGINT AS n_columns, ({DUPS})::BIGINT AS duplicate_rows, "
            f"({miss})::BIGINT AS missing_cells FROM dirty")


def dataset_intelligence() -> str:
    n = len(DIRTY_COLUMNS)
    base = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", t{i + 1} AS dtype, "
            f"{lit(k)} AS class, m{i + 1}::BIGINT AS missing, "
            f"{pct_sql(f'm{i + 1}', 'n_rows', 2)} AS missing_pct, n_rows::BIGINT AS n_rows, "
            f"{n}::BIGINT AS n_columns, dups::BIGINT AS duplicate_rows FROM agg"
            for i, (c, _, k) in enumerate(DIRTY_COLUMNS)]
    return (f"WITH {DIRTY_LINEITEM},\n{_value_counts_cte(CATEGORICAL_DIRTY, DIRTY_COLUMNS)},\n"
            f"agg AS (SELECT count(*) AS n_rows, {DUPS} AS dups, {_miss_aggs(DIRTY_COLUMNS)} "
            f"FROM dirty),\nbase AS ({union_all(base)}),\n"
            f"descr AS ({_describe_all_body()})\n"
            f"SELECT base.*, descr.count, descr.unique, descr.top, descr.freq, descr.mean, "
            f"descr.std, descr.min, descr.p25, descr.p50, descr.p75, descr.max "
            f"FROM base LEFT JOIN descr USING (ordinal)")


def _describe_all_body() -> str:
    num = [f"SELECT ordinal, count, NULL::BIGINT AS unique, NULL::VARCHAR AS top, "
           f"NULL::BIGINT AS freq, mean, std, min, p25, p50, p75, max FROM ({s})"
           for s in _describe_selects(NUMERIC_DIRTY, DIRTY_COLUMNS)]
    cat = (f"SELECT ordinal, sum(cnt)::BIGINT AS count, count(*)::BIGINT AS unique, "
           f"arg_min(value, (-cnt, value)) AS top, max(cnt)::BIGINT AS freq, "
           + ", ".join(f"NULL::DOUBLE AS {s}" for s in ("mean", "std", "min", "p25", "p50", "p75", "max"))
           + " FROM counts GROUP BY ordinal")
    return union_all(num + [cat])


def duplicate_count() -> str:
    return (f"WITH {DIRTY_LINEITEM}\nSELECT count(*)::BIGINT AS n_rows, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))::BIGINT AS distinct_rows, "
            f"({DUPS})::BIGINT AS duplicate_rows FROM dirty")


def dataset_summary_for(table: str, cols) -> str:
    """AN1 over a whole driver table."""
    n = len(cols)
    dups = (f"(SELECT count(*) FROM {table}) - "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))")
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", t{i + 1} AS dtype, "
           f"m{i + 1}::BIGINT AS missing, {pct_sql(f'm{i + 1}', 'n_rows', 1)} AS missing_pct, "
           f"n_rows::BIGINT AS n_rows, {n}::BIGINT AS n_columns, "
           f"dups::BIGINT AS duplicate_rows FROM agg" for i, (c, _, _) in enumerate(cols)]
    return (f"WITH agg AS (SELECT count(*) AS n_rows, {dups} AS dups, {_miss_aggs(cols)} "
            f"FROM {table})\n{union_all(sel)}")


def top_values_for(table: str, cols, k: int = 5) -> str:
    cats = [c for c in cols if c[2] == "categorical"]
    return (f"WITH {_value_counts_cte(cats, cols, table)},\n"
            f"ranked AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY cnt DESC, value) "
            f"AS rnk, count(*) OVER (PARTITION BY ordinal) AS nu FROM counts)\n"
            f"SELECT ordinal, \"column\", nu::BIGINT AS nunique, rnk::BIGINT AS rank, value, "
            f"cnt::BIGINT AS count FROM ranked WHERE rnk <= {k}")


def all_sql() -> dict[str, str]:
    return {
        "dataset_summary": dataset_summary(),
        "describe_statistics": describe_statistics(),
        "top_values": top_values(),
        "describe_all": describe_all(),
        "correlation_pairs": correlation_pairs(),
        "nunique": nunique(),
        "column_classes": column_classes(),
        "extract_schema": extract_schema(),
        "schema_text": schema_text(),
        "rich_schema": rich_schema(),
        "summary_counters": summary_counters(),
        "describe_numeric": describe_statistics(3),
        "dataset_intelligence": dataset_intelligence(),
        "duplicate_count": duplicate_count(),
        "dataset_summary_embeddings": dataset_summary_for("embeddings", EMBEDDINGS_COLUMNS),
        "dataset_summary_documents": dataset_summary_for("documents", DOCUMENTS_COLUMNS),
        "top_values_documents": top_values_for("documents", DOCUMENTS_COLUMNS),
        **cleaning_sql(),
        **charts_sql(),
        **querylog_sql(),
        **ml_sql(),
        **io_sql(),
    }


# ------------------------------------------------------------------ cleaning

def _select_rounded(cols, exprs=None, table=""):
    """Select list that rounds double columns; ``exprs`` overrides a column."""
    exprs = exprs or {}
    out = []
    for c, t, _ in cols:
        e = exprs.get(c, f"{table}{qi(c)}")
        out.append(f"{r4(e)} AS {qi(c)}" if t == "double" else f"{e} AS {qi(c)}")
    return ", ".join(out)


def remove_duplicates() -> str:
    return (f"WITH {DIRTY_LINEITEM}\nSELECT {_select_rounded(DIRTY_COLUMNS)} "
            f"FROM (SELECT DISTINCT * FROM dirty)")


def remove_duplicates_maps() -> str:
    return "SELECT DISTINCT l_orderkey % 50 AS k, l_returnflag AS flag, l_linenumber AS number FROM lineitem"


FILLED_NUMERIC = ["l_quantity", "l_extendedprice"]   # dirty columns with missing cells


def fill_missing(stat: str) -> str:
    if stat == "mean":          # as windows over the whole frame: no join
        means = ", ".join(f"avg({qi(c)}::DOUBLE) OVER () AS {qi('s_' + c)}" for c in FILLED_NUMERIC)
        exprs = {c: f"coalesce({qi(c)}, {qi('s_' + c)})" for c in FILLED_NUMERIC}
        return f"WITH {DIRTY_LINEITEM}\nSELECT {_select_rounded(DIRTY_COLUMNS, exprs)} FROM (SELECT *, {means} FROM dirty)"
    st = ", ".join(f"quantile_cont({qi(c)}::DOUBLE, 0.5) AS {qi('s_' + c)}" for c in FILLED_NUMERIC)
    exprs = {c: f"coalesce({qi(c)}, st.{qi('s_' + c)})" for c in FILLED_NUMERIC}
    return (f"WITH {DIRTY_LINEITEM},\nst AS MATERIALIZED (SELECT {st} FROM dirty)\n"
            f"SELECT {_select_rounded(DIRTY_COLUMNS, exprs)} FROM dirty, st")


def fill_missing_mode() -> str:
    modes = ", ".join(
        f"(SELECT {qi(c)} FROM dirty WHERE {qi(c)} IS NOT NULL GROUP BY {qi(c)} "
        f"ORDER BY count(*) DESC, {qi(c)} LIMIT 1) AS {qi('s_' + c)}"
        for c, _, _ in CATEGORICAL_DIRTY)
    exprs = {c: f"coalesce({qi(c)}, st.{qi('s_' + c)})" for c, _, _ in CATEGORICAL_DIRTY}
    return (f"WITH {DIRTY_LINEITEM},\nst AS (SELECT {modes})\n"
            f"SELECT {_select_rounded(DIRTY_COLUMNS, exprs)} FROM dirty, st")


def drop_missing_rows() -> str:
    cond = " AND ".join(f"{qi(c)} IS NOT NULL" for c, _, _ in DIRTY_COLUMNS)
    return f"WITH {DIRTY_LINEITEM}\nSELECT {_select_rounded(DIRTY_COLUMNS)} FROM dirty WHERE {cond}"


def _outlier_chain(cols, source="dirty", z=3):
    """Chained CTEs s0..sk: column i filtered with the mean / std of s(i-1)."""
    nums = [c for c, _, k in cols if k == "numeric"]
    ctes = [f"s0 AS (SELECT * FROM {source})"]
    for i, c in enumerate(nums, start=1):
        x = f"{qi(c)}::DOUBLE"
        ctes.append(f"st{i} AS (SELECT avg({x}) AS m, stddev_samp({x}) AS s FROM s{i - 1})")
        ctes.append(f"s{i} AS (SELECT s{i - 1}.* FROM s{i - 1}, st{i} "
                    f"WHERE st{i}.s = 0 OR abs(({x} - st{i}.m) / st{i}.s) < {z})")
    return ",\n".join(ctes), f"s{len(nums)}"


def remove_outliers() -> str:
    chain, last = _outlier_chain(DIRTY_COLUMNS)
    return (f"WITH {DIRTY_LINEITEM},\n{chain}\n"
            f"SELECT {_select_rounded(DIRTY_COLUMNS)} FROM {last}")


def remove_outliers_events() -> str:
    from tabsmith.plans.sql_fixtures import EVENTS_COLUMNS
    chain, last = _outlier_chain(EVENTS_COLUMNS, source="events")
    return f"WITH {chain}\nSELECT {_select_rounded(EVENTS_COLUMNS)} FROM {last}"


def remove_outliers_once(z: int = 3) -> str:
    nums = [c for c, _, _ in NUMERIC_DIRTY]
    st = ", ".join(f"avg({qi(c)}::DOUBLE) OVER () AS {qi('m_' + c)}, "
                   f"stddev_samp({qi(c)}::DOUBLE) OVER () AS {qi('s_' + c)}" for c in nums)
    cond = " AND ".join(
        f"({qi('s_' + c)} = 0 OR abs(({qi(c)}::DOUBLE - {qi('m_' + c)}) / {qi('s_' + c)}) < {z})" for c in nums)
    return f"WITH {DIRTY_LINEITEM}\nSELECT {_select_rounded(DIRTY_COLUMNS)} FROM (SELECT *, {st} FROM dirty) WHERE {cond}"


def cleaning_report() -> str:
    n = len(DIRTY_COLUMNS)
    total = " + ".join(f"m{i + 1}" for i in range(n))
    sel = [f"SELECT {i + 1}::BIGINT AS ordinal, {lit(c)} AS \"column\", m{i + 1}::BIGINT AS missing, "
           f"{pct_sql(f'm{i + 1}', 'n_rows', 1)} AS missing_pct, "
           f"CASE WHEN m{i + 1} > 0 THEN 'warn' ELSE 'ok' END AS status, n_rows::BIGINT AS n_rows, "
           f"{n}::BIGINT AS n_columns, dups::BIGINT AS duplicate_rows, "
           f"({total})::BIGINT AS missing_cells FROM agg"
           for i, (c, _, _) in enumerate(DIRTY_COLUMNS)]
    return (f"WITH {DIRTY_LINEITEM},\nagg AS (SELECT count(*) AS n_rows, {DUPS} AS dups, "
            f"{_miss_aggs(DIRTY_COLUMNS)} FROM dirty)\n{union_all(sel)}")


def cleaning_counts() -> str:
    nums = [c for c, _, _ in NUMERIC_DIRTY]
    cats = [c for c, _, _ in CATEGORICAL_DIRTY]
    miss = lambda cs: " + ".join(f"count(*) FILTER (WHERE {qi(c)} IS NULL)" for c in cs)
    notnull = " AND ".join(f"{qi(c)} IS NOT NULL" for c, _, _ in DIRTY_COLUMNS)
    chain, last = _outlier_chain(DIRTY_COLUMNS)
    # cells a fill can reach: missing cells of columns that have at least one value
    fillable_num = " + ".join(
        f"CASE WHEN count({qi(c)}) > 0 THEN count(*) - count({qi(c)}) ELSE 0 END" for c in nums)
    fillable_cat = " + ".join(
        f"CASE WHEN count({qi(c)}) > 0 THEN count(*) - count({qi(c)}) ELSE 0 END" for c in cats)
    del miss
    rows = [
        ("remove_duplicates", "n", "(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))", "0"),
        ("fill_missing_mean", "n", "n", "fnum"),
        ("fill_missing_median", "n", "n", "fnum"),
        ("fill_missing_mode", "n", "n", "fcat"),
        ("drop_missing_rows", "n", f"(SELECT count(*) FROM dirty WHERE {notnull})", "0"),
        ("remove_outliers", "n", f"(SELECT count(*) FROM {last})", "0"),
    ]
    sel = [f"SELECT {lit(op)} AS op, ({b})::BIGINT AS rows_before, ({a})::BIGINT AS rows_after, "
           f"(({b}) - ({a}))::BIGINT AS rows_removed, ({f})::BIGINT AS cells_filled FROM agg"
           for op, b, a, f in rows]
    return (f"WITH {DIRTY_LINEITEM},\n{chain},\n"
            f"agg AS (SELECT count(*) AS n, {fillable_num} AS fnum, {fillable_cat} AS fcat FROM dirty)\n"
            f"{union_all(sel)}")


def cleaning_sql() -> dict[str, str]:
    return {
        "remove_duplicates": remove_duplicates(),
        "remove_duplicates_maps": remove_duplicates_maps(),
        "fill_missing_mean": fill_missing("mean"),
        "fill_missing_median": fill_missing("median"),
        "fill_missing_mode": fill_missing_mode(),
        "drop_missing_rows": drop_missing_rows(),
        "remove_outliers": remove_outliers(),
        "remove_outliers_events": remove_outliers_events(),
        "remove_outliers_once": remove_outliers_once(),
        "cleaning_report": cleaning_report(),
        "cleaning_counts": cleaning_counts(),
    }
