"""DuckDB oracle SQL for the SQL-expressible machine-learning queries."""

from __future__ import annotations

from tabsmith.functions import rules as R
from tabsmith.plans.sql_fixtures import DIRTY_COLUMNS, DIRTY_LINEITEM, QUERY_LOG, lit, qi, r4

SPLIT = ("CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729) % 100 < 80 "
         "THEN 'train' ELSE 'test' END")
Y = "3 * l_quantity - 10 * l_discount + 5 + 0.001::DOUBLE * (l_orderkey % 7)"
REG = f"reg AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, {Y} AS y, {SPLIT} AS split FROM lineitem)"
OLS_FEATURES = ["l_quantity", "l_discount"]


def _rounded(cols, exprs=None):
    exprs = exprs or {}
    out = []
    for c, t, _ in cols:
        e = exprs.get(c, qi(c))
        out.append(f"{r4(e)} AS {qi(c)}" if t == "double" else f"{e} AS {qi(c)}")
    return ", ".join(out)


def resolve_target():
    ws = R.PY_WHITESPACE
    raw = f"regexp_extract(lower(query), {lit(f'target:[{ws}]*([^{ws}]+)')}, 1)"
    word = f"rtrim({raw}, '.,;')"
    names = [c for c, _, _ in DIRTY_COLUMNS]
    case = " ".join(f"WHEN {word} = {lit(c.lower())} THEN {lit(c)}" for c in names)
    return (f"WITH {QUERY_LOG}\nSELECT conv_id, turn, CASE {case} ELSE {lit(names[-1])} END "
            f"AS target FROM qlog")


def detect_task_type():
    specs = [("lineitem", "l_returnflag", "string"), ("lineitem", "l_quantity", "double"),
             ("lineitem", "l_linenumber", "int"), ("part", "p_size", "int"),
             ("events", "value", "double")]
    sel = []
    for t, c, dt in specs:
        u = f"count(DISTINCT {qi(c)})"
        if dt == "string":
            task, reason = "'classification'", lit("String/category column → classification")
        else:
            task = f"CASE WHEN {u} <= 20 THEN 'classification' ELSE 'regression' END"
            reason = f"{u} || ' unique numeric values → ' || {task}"
        sel.append(f"SELECT {lit(t)} AS source, {lit(c)} AS target, {lit(dt)} AS dtype, "
                   f"{u}::BIGINT AS unique, {task} AS task, {reason} AS reason FROM {t}")
    return "\nUNION ALL\n".join(sel)


def drop_unlabelled():
    return (f"WITH {DIRTY_LINEITEM}\nSELECT {_rounded(DIRTY_COLUMNS)} FROM dirty "
            f"WHERE l_returnflag IS NOT NULL")


def label_encode():
    ctes, exprs, joins = [], {}, []
    for i, c in enumerate(["l_returnflag", "l_linestatus"]):
        ctes.append(f"c{i} AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code "
                    f"FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM dirty))")
        exprs[c] = f"c{i}.code"
        joins.append(f"JOIN c{i} ON c{i}.v = coalesce(dirty.{c}, 'nan')")
    cols = [(c, "bigint" if c in exprs else t, k) for c, t, k in DIRTY_COLUMNS]
    sel = _rounded(cols, {**{c: f"dirty.{qi(c)}" for c, _, _ in DIRTY_COLUMNS}, **exprs})
    return f"WITH {DIRTY_LINEITEM},\n{', '.join(ctes)}\nSELECT {sel} FROM dirty {' '.join(joins)}"


def _imputed(condition: str = "") -> str:
    """Missing features filled with a mean of the labelled rows, taken as a window (no join)."""
    filled = ["l_quantity", "l_extendedprice"]
    means = ", ".join(f"avg({c}::DOUBLE) {condition} OVER () AS m_{c}" for c in filled)
    exprs = {c: f"coalesce({c}::DOUBLE, m_{c})" for c in filled}
    return (f"WITH {DIRTY_LINEITEM}\nSELECT {_rounded(DIRTY_COLUMNS, exprs)} "
            f"FROM (SELECT *, {means} FROM dirty WHERE l_returnflag IS NOT NULL)")


def impute_features_mean():
    return _imputed()


def impute_features_train_only():
    return _imputed(f"FILTER (WHERE {SPLIT} = 'train')")


def split():
    return f"WITH {REG}\nSELECT l_orderkey, l_linenumber, split FROM reg"


def scale():
    st = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in OLS_FEATURES)
    cols = ", ".join(
        f"{r4(f'({f} - m_{f}) / CASE WHEN s_{f} = 0 OR s_{f} IS NULL THEN 1 ELSE s_{f} END')} AS {f}"
        for f in OLS_FEATURES)
    return (f"WITH {REG},\nst AS (SELECT {st} FROM reg WHERE split = 'train')\n"
            f"SELECT l_orderkey, l_linenumber, split, {cols} FROM reg, st")


def _coef_cte():
    sel = " UNION ALL ".join(
        f"SELECT {lit(f)} AS feature, regr_slope(y, {f}) AS b, regr_intercept(y, {f}) AS a, "
        f"regr_r2(y, {f}) AS r2 FROM reg WHERE split = 'train'" for f in OLS_FEATURES)
    return f"coef AS ({sel})"


def linear_regression():
    return (f"WITH {REG},\n{_coef_cte()}\nSELECT feature, {r4('b')} AS slope, "
            f"{r4('a')} AS intercept, {r4('r2')} AS r2_train FROM coef")


def _metrics_cte():
    preds = " UNION ALL ".join(
        f"SELECT {lit(f)} AS feature, y AS label, coef.a + coef.b * {f} AS prediction "
        f"FROM reg, coef WHERE split = 'test' AND coef.feature = {lit(f)}" for f in OLS_FEATURES)
    return (f"preds AS ({preds}),\nmet AS (SELECT feature, sqrt(avg((prediction - label) * "
            f"(prediction - label))) AS rmse, avg(abs(prediction - label)) AS mae, "
            f"1 - sum((prediction - label) * (prediction - label)) / (var_pop(label) * count(*)) "
            f"AS r2, count(*)::BIGINT AS n FROM preds GROUP BY feature)")


def regression_metrics():
    return (f"WITH {REG},\n{_coef_cte()},\n{_metrics_cte()}\nSELECT feature, {r4('rmse')} AS rmse, "
            f"{r4('mae')} AS mae, {r4('r2')} AS r2, n FROM met")


def interpretation_band():
    whens = " ".join(f"WHEN r2 >= {b} THEN {lit(lbl)}" for b, lbl in R.R2_BANDS if b is not None)
    last = R.R2_BANDS[-1][1]
    return (f"WITH {REG},\n{_coef_cte()},\n{_metrics_cte()}\nSELECT feature, {r4('r2')} AS r2, "
            f"CASE {whens} ELSE {lit(last)} END AS band FROM met")


def cross_validate(k: int = 3):
    alloc = ", ".join(
        f"(floor((s + n - 1 - {i}) / {k}.0) - floor((s - 1 - {i}) / {k}.0))::BIGINT AS a{i}"
        for i in range(k))
    cum = " ".join(f"WHEN p <= {' + '.join(f'a{j}' for j in range(i + 1))} THEN {i}"
                   for i in range(k - 1))
    return f"""WITH tr AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_returnflag AS label
            FROM lineitem WHERE {SPLIT} = 'train'),
cc AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
cs AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) AS s FROM cc),
al AS (SELECT label, {alloc} FROM cs),
pos AS (SELECT tr.*, row_number() OVER (PARTITION BY label ORDER BY k) AS p FROM tr)
SELECT k, label, (CASE {cum} ELSE {k - 1} END)::INTEGER AS fold FROM pos JOIN al USING (label)"""


def auto_train_classes(classes: list[float]) -> str:
    """Both models of a run: scored, the classes' number and range, the split's sizes."""
    return f"""WITH n AS (SELECT count(*) FILTER (WHERE (event_id * 7919) % 100 < 80)::BIGINT AS n_train,
       count(*) FILTER (WHERE (event_id * 7919) % 100 >= 80)::BIGINT AS n_test FROM events),
m(model) AS (VALUES ('Logistic Regression'), ('Random Forest'))
SELECT model, TRUE AS scored, {len(classes)}::BIGINT AS n_classes, {classes[0]}::DOUBLE AS lowest,
       {classes[-1]}::DOUBLE AS highest, n_train, n_test FROM m, n"""


def select_features() -> str:
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    rows = ", ".join(f"({i + 1}::BIGINT, {lit(n)})" for i, n in enumerate(names))
    return f"SELECT * FROM (VALUES {rows}) AS t(ordinal, feature)"


def accuracy_of_rule() -> str:
    return (f"SELECT {r4('avg((floor(value / 10) = floor((value + 3) / 10))::INT)')} AS accuracy, "
            f"count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL")


def best_of_types() -> str:
    return (f"WITH b AS (SELECT event_type AS model, {r4('avg(value)')} AS value, "
            f"dense_rank() OVER (ORDER BY event_type)::BIGINT AS ordinal FROM events GROUP BY event_type)\n"
            f"SELECT ordinal, model, value FROM b ORDER BY value DESC, ordinal LIMIT 1")


def ml_sql() -> dict[str, str]:
    return {
        "auto_train_signs": auto_train_classes([-1.0, 1.0]),
        "auto_train_years": auto_train_classes([2019.0, 2020.0, 2021.0]),
        "auto_train_fractions": auto_train_classes([0.5, 1.5]),
        "select_features": select_features(),
        "accuracy_of_rule": accuracy_of_rule(),
        "best_of_types": best_of_types(),
        "resolve_target": resolve_target(),
        "detect_task_type": detect_task_type(),
        "drop_unlabelled": drop_unlabelled(),
        "label_encode": label_encode(),
        "impute_features_mean": impute_features_mean(),
        "impute_features_train_only": impute_features_train_only(),
        "split": split(),
        "scale": scale(),
        "linear_regression": linear_regression(),
        "regression_metrics": regression_metrics(),
        "interpretation_band": interpretation_band(),
        "cross_validate": cross_validate(),
    }
