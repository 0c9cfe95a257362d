"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

CHANNELS = ["click", "error", "purchase", "signup", "view"]
LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_RANGES = {
    "l_quantity": (5, 45), "l_extendedprice": (1000, 80000), "l_discount": (0.01, 0.09), "l_tax": (0.01, 0.07),
}
WINDOW = 12
MIN15, MIN7, MIN1, DAY = 900_000_000, 420_000_000, 60_000_000, 86_400_000_000


# Added before rounding on both sides: means of cents often lie exactly between
# two rounded values, where the last bit of a sum would decide.
TIE = 3e-10


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr} + {TIE}, {digits}) AS {name}"


def chan(fmt: str, cols=CHANNELS, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c) for c in cols)


def raw(limits: bool = True, extra: str = "") -> str:
    inside = " AND value BETWEEN 1 AND 200" if limits else ""
    vals = ", ".join(f"CASE WHEN event_type = '{c}'{inside} THEN value END AS {c}" for c in CHANNELS)
    return f"raw AS (SELECT ts {extra}, {vals} FROM events)"


def grid(us: int, cols=CHANNELS, limits: bool = True) -> str:
    origin = "0" if DAY % us == 0 else f"(SELECT min(epoch_us(ts)) // {DAY} * {DAY} FROM events)"
    return f"""{raw(limits)},
    buckets AS (SELECT (epoch_us(ts) - {origin}) // {us} AS bucket, {chan('avg({c}) AS {c}', cols)} FROM raw GROUP BY 1),
    axis AS (SELECT unnest(generate_series((SELECT min(bucket) FROM buckets), (SELECT max(bucket) FROM buckets))) AS bucket),
    grid AS (
      SELECT axis.bucket - (SELECT min(bucket) FROM buckets) AS pos,
             make_timestamp(axis.bucket * {us} + {origin}) AS "timestamp", {chan('{c}', cols)},
             CASE WHEN {chan('{c} IS NULL', cols, ' OR ')} THEN 1 ELSE 0 END AS was_missing
      FROM axis LEFT JOIN buckets USING (bucket))"""


def user_grid(cols=CHANNELS) -> str:
    return f"""{raw(False, ', user_id')},
    buckets AS (SELECT user_id, epoch_us(ts) // {DAY} AS bucket, {chan('avg({c}) AS {c}', cols)} FROM raw GROUP BY 1, 2),
    ends AS (SELECT user_id, min(bucket) AS lo, max(bucket) AS hi FROM buckets GROUP BY 1),
    axis AS (SELECT user_id, lo, unnest(generate_series(lo, hi)) AS bucket FROM ends),
    grid AS (
      SELECT user_id, bucket - lo AS pos, make_timestamp(bucket * {DAY}) AS "timestamp", {chan('{c}', cols)},
             CASE WHEN {chan('{c} IS NULL', cols, ' OR ')} THEN 1 ELSE 0 END AS was_missing
      FROM axis LEFT JOIN buckets USING (user_id, bucket))"""


def fill(gap: int, key: str = "", cols=CHANNELS) -> str:
    part = f"PARTITION BY {key} " if key else ""
    before = f"OVER ({part}ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER ({part}ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = ", ".join(
        f"last_value({c} IGNORE NULLS) {before} AS p_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {before} AS pp_{c}, "
        f"first_value({c} IGNORE NULLS) {after} AS q_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {after} AS qp_{c}"
        for c in cols)
    filled = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pos - pp_{c} <= {gap} OR qp_{c} - pos <= {gap} THEN "
        f"coalesce(p_{c} + (q_{c} - p_{c}) * (pos - pp_{c}) / (qp_{c} - pp_{c}), p_{c}, q_{c}) END AS {c}" for c in cols)
    keys = f"{key}, " if key else ""
    return f"""near AS (SELECT *, {near} FROM grid),
    filled AS (SELECT {keys}pos, "timestamp", was_missing, {filled} FROM near)"""


def clean(us: int = MIN15, gap: int = 10, cols=CHANNELS) -> str:
    return f"""{grid(us, cols)}, {fill(gap, cols=cols)},
    clean AS (
      SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, "timestamp", was_missing, {chan('{c}', cols)},
             CASE WHEN {chan('{c} IS NULL', cols, ' OR ')} THEN 1 ELSE 0 END AS still_missing
      FROM filled WHERE {chan('{c} IS NOT NULL', cols, ' OR ')}),
    size AS (SELECT count(*) AS n FROM clean)"""


CLEAN = clean()
BAND = f"""{CLEAN},
    rolled AS (SELECT pos, "timestamp" AS ds, click AS y,
        avg(click) OVER w AS yhat, coalesce(stddev_samp(click) OVER w, 0) AS sd
        FROM clean WINDOW w AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    band AS (SELECT pos, ds, y, yhat, yhat - 1.28 * sd AS yhat_lower, yhat + 1.28 * sd AS yhat_upper FROM rolled),
    flagged AS (SELECT *, y - yhat AS residual,
        CASE WHEN (yhat_upper - yhat_lower) / 2 > 0 THEN abs(y - yhat) / ((yhat_upper - yhat_lower) / 2) ELSE 0 END AS anomaly_score,
        CASE WHEN y < yhat_lower OR y > yhat_upper THEN 1 ELSE 0 END AS anomaly FROM band),
    res AS (SELECT avg(residual) AS m, stddev_samp(residual) AS s FROM flagged),
    band_result AS (SELECT flagged.*, (residual - m) / s AS residual_zscore,
        CASE WHEN abs((residual - m) / s) > 2 THEN 1 ELSE 0 END AS anomaly_residual,
        CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM flagged, res, size)"""


def score_ctes() -> str:
    return f"""scored0 AS (SELECT pos, "timestamp", was_missing, {chan('{c}')}, abs(error - (SELECT avg(error) FROM clean)) AS raw_s,
        CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM clean, size),
    span AS (SELECT min(raw_s) AS lo, max(raw_s) AS hi, quantile_cont(raw_s, 0.95) FILTER (split = 'train') AS cut FROM scored0),
    score_result AS (SELECT pos, "timestamp", was_missing, {chan('{c}')}, split, (raw_s - lo) / (hi - lo + 1e-8) AS anomaly_score,
        CASE WHEN raw_s > cut THEN 1 ELSE 0 END AS anomaly, CASE WHEN raw_s > cut THEN -1 ELSE 1 END AS anomaly_if FROM scored0, span)"""


def window_ctes() -> str:
    return f"""vstat AS (SELECT avg("view") AS m, stddev_pop("view") AS s FROM clean),
    wscores AS (SELECT pos, "timestamp", "view", (("view" - m) / s) * (("view" - m) / s) AS mse,
        CASE WHEN pos - {WINDOW - 1} < floor((n - {WINDOW - 1}) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM clean, vstat, size WHERE pos >= {WINDOW - 1}),
    wtrain AS (SELECT avg(mse) AS mu, stddev_pop(mse) AS sigma, stddev_samp(mse) AS sigma1 FROM wscores WHERE split = 'train'),
    wflags AS (SELECT pos, "timestamp", mse, split, mu + 1.5 * sigma AS threshold,
        CASE WHEN mse > mu + 1.5 * sigma THEN 1 ELSE 0 END AS anomaly FROM wscores, wtrain)"""


SCORE = f"{CLEAN}, {score_ctes()}"
WFLAGS = f"{CLEAN}, {window_ctes()}"
MERGED = f"""{BAND}, {score_ctes()}, {window_ctes()},
    merged AS (SELECT b.ds AS "timestamp", b.split, b.anomaly AS anomaly_prophet, s.anomaly AS anomaly_if, w.anomaly AS anomaly_lstm,
        b.anomaly + s.anomaly + w.anomaly AS vote_count,
        CASE WHEN b.anomaly + s.anomaly + w.anomaly >= 2 THEN 1 ELSE 0 END AS anomaly_ensemble
        FROM band_result b JOIN score_result s ON b.ds = s."timestamp" JOIN wflags w ON b.ds = w."timestamp")"""
MODELS = ["prophet", "if", "lstm"]
LINES = "lines AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS anomaly FROM lineitem)"
LONG_LINES = f"{LINES}, long AS (" + " UNION ALL ".join(
    f"SELECT anomaly, '{c}' AS col, {c}::DOUBLE AS value FROM lines" for c in LINE_COLS) + ")"


def rolling(c: str, w: int, part: str = "") -> str:
    over = f"OVER ({part}ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (f"{r(f'avg({c}) {over}', f'{c}_roll_mean_{w}')}, "
            f"{r(f'coalesce(stddev_samp({c}) {over}, 0)', f'{c}_roll_std_{w}')}")


def lags(c: str, ks: list[int], part: str = "") -> str:
    return ", ".join(r(f"lag({c}, {k}) OVER ({part}ORDER BY pos)", f"{c}_lag_{k}") for k in ks)


def feature_ctes() -> tuple[str, list[str]]:
    made, names = [], list(CHANNELS)
    for c in CHANNELS:
        for w in (5, 15):
            over = f"OVER (ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            made.append(f"avg({c}) {over} AS {c}_roll_mean_{w}")
            made.append(f"coalesce(stddev_samp({c}) {over}, 0) AS {c}_roll_std_{w}")
            names += [f"{c}_roll_mean_{w}", f"{c}_roll_std_{w}"]
        for k in (1, 5):
            made.append(f"lag({c}, {k}) OVER (ORDER BY pos) AS {c}_lag_{k}")
            names.append(f"{c}_lag_{k}")
    minute = '(hour("timestamp") * 60 + minute("timestamp"))'
    made += [f"sin(2 * pi() * {minute} / 1440) AS sin_time", f"cos(2 * pi() * {minute} / 1440) AS cos_time"]
    names += ["sin_time", "cos_time"]
    return f"""{CLEAN}, made AS (SELECT pos, "timestamp", was_missing, {chan('{c}')}, {', '.join(made)} FROM clean),
    features AS (SELECT pos, "timestamp", was_missing, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)} FROM made)""", names


FEATURES, FEATURE_NAMES = feature_ctes()


def windows_sql(cols: list[str], length: int) -> str:
    cells = ", ".join(
        f"round(CAST(CAST(lag({c}, {length - 1 - i}) OVER (ORDER BY pos) AS FLOAT) AS DOUBLE) + {TIE}, 3) AS x{i}_{j}"
        for i in range(length) for j, c in enumerate(cols))
    return f"""WITH {CLEAN} SELECT * FROM (SELECT pos, "timestamp", {cells} FROM clean) WHERE pos >= {length - 1}"""


def quantiles(col: str, source: str, probs: list[float]) -> str:
    return " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS prob, {r(f'quantile_cont({col}, {p})', 'value')} FROM {source}" for p in probs)


def histogram(source: str, col: str, bins: int, by: str, digits: int) -> str:
    keys = f"{by}, " if by else ""
    using = f"USING ({by}, bin)" if by else "USING (bin)"
    join = f"JOIN b USING ({by})" if by else ", b"
    return f"""b AS (SELECT {keys}count({col}) AS total, min({col}) AS lo, max({col}) AS hi FROM {source} {'GROUP BY ' + by if by else ''}),
    c AS (SELECT {keys}least(floor(({col} - lo) / (hi - lo) * {bins}), {bins - 1})::INTEGER AS bin, count(*) AS n FROM {source} {join}
          GROUP BY ALL),
    g AS (SELECT *, unnest(range(0, {bins}))::INTEGER AS bin FROM b)
    SELECT {keys}bin, {r(f'lo + bin * ((hi - lo) / {bins})', '"left"', digits)}, {r(f'lo + (bin + 1) * ((hi - lo) / {bins})', '"right"', digits)},
           coalesce(n, 0) AS n, {r(f'coalesce(n, 0) / (total * ((hi - lo) / {bins}))', 'density', digits)}
    FROM g LEFT JOIN c {using}"""


def describe(source: str, cols: list[str], prefix: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM {source}" for c in cols)
    stats = {"mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "q25": "quantile_cont(v, 0.25)",
             "q50": "quantile_cont(v, 0.5)", "q75": "quantile_cont(v, 0.75)", "max": "max(v)"}
    shown = ", ".join(r(e, f'"{n}"', 2) for n, e in stats.items())
    return f"""WITH {prefix} long AS ({parts}) SELECT "column", count(*) - count(v) AS n_null, count(v) AS "count", {shown} FROM long GROUP BY 1"""


def correlations(source: str, cols: list[str], prefix: str = "") -> str:
    return f"WITH {prefix} one AS (SELECT 1) " + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + (f"{r(f'corr({a}, {b})', 'r')} FROM {source}" if a != b else "1.0::DOUBLE AS r")
        for a in cols for b in cols)


def kpi(split: str) -> str:
    where = "" if split == "all" else f"WHERE split = '{split}'"
    rows = [("prophet", "band_result", "anomaly_residual", "avg(anomaly_score)", "avg(abs(residual))", "NULL::DOUBLE"),
            ("if", "score_result", "anomaly", "avg(anomaly_score)", "NULL::DOUBLE", "NULL::DOUBLE"),
            ("lstm", "wflags", "anomaly", "avg(mse)", "NULL::DOUBLE", "max(threshold)")]
    return f"WITH {MERGED} " + " UNION ALL ".join(
        f"SELECT '{m}' AS model, count(*) AS n_rows, sum({f})::BIGINT AS n_flagged, {r(f'avg({f})', 'rate')}, "
        f"{r(s, 'mean_score')}, {r(mae, 'mae')}, {r(t, 'threshold')} FROM {src} {where}"
        for m, src, f, s, mae, t in rows)


def outside(c: str) -> str:
    lo, hi = LINE_RANGES[c]
    return f"CASE WHEN {c} < {lo}::DOUBLE OR {c} > {hi}::DOUBLE THEN 1 ELSE 0 END"


N_OUTSIDE = " + ".join(outside(c) for c in LINE_COLS)
GRID = grid(MIN15)
TOP = f'{chan("{c}")}'
CH6 = ", ".join(r(c, f'"{c}"') for c in CHANNELS)
PAIRS = [("prophet", "if"), ("prophet", "lstm"), ("if", "lstm")]

ORACLES = {
    "csv_roundtrip": f"SELECT event_id, ts, user_id, event_type, {r('value', 'value')} FROM events",
    "parquet_timestamps": f"SELECT o_orderkey, o_orderdate, {r('o_totalprice', 'o_totalprice')} FROM orders",
    "stored_windows": windows_sql(["click", '"view"'], 3),
    "stored_scaler": f"WITH {FEATURES} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 'standard' AS kind, {r(f'avg({c})', 'center')}, {r(f'stddev_pop({c})', 'scale')} FROM features"
        for c in CHANNELS),
    "stored_results": f"""WITH {MERGED} SELECT 'prophet' AS model, ds AS "timestamp", anomaly_residual AS anomaly, split FROM band_result
        UNION ALL SELECT 'if', "timestamp", anomaly, split FROM score_result""",
    "rename_mapped": f"SELECT l_orderkey, l_linenumber, {r('l_quantity', 'quantity')}, {r('l_extendedprice', 'price')}, 'not_there' AS absent FROM lineitem",
    "parse_text_timestamps": "SELECT event_id, date_trunc('second', ts) AS \"timestamp\" FROM events",
    "single_stream_key": "SELECT event_id, ts, 1 AS patient_id FROM events",
    "limits_to_null": f"WITH {raw(True, ', event_id')} SELECT event_id, ts AS \"timestamp\", {CH6} FROM raw",
    "limit_counts": f"WITH {raw(False)} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 1.0::DOUBLE AS lo, 200.0::DOUBLE AS hi, count(*) FILTER ({c} < 1 OR {c} > 200) AS n_clipped FROM raw"
        for c in CHANNELS),
    "target_rows": f"WITH {GRID} SELECT \"timestamp\" AS ds, {r('view', 'y')} FROM grid WHERE view IS NOT NULL",
    "complete_rows": f"WITH {GRID} SELECT pos, {r('click', 'click')}, {r('view', 'view')} FROM grid WHERE click IS NOT NULL AND view IS NOT NULL",
    "zero_fill": f"WITH {GRID} SELECT pos, " + ", ".join(r(f"coalesce({c}, 0)", c) for c in CHANNELS) + " FROM grid",
    "zero_fill_total": f"WITH {GRID} SELECT " + " + ".join(f"count(*) - count({c})" for c in CHANNELS) + " AS n_filled FROM grid",
    "fill_or_drop": f"WITH {GRID} SELECT pos, " + ", ".join(r(f"coalesce({c}, 0)", c) for c in CHANNELS)
        + " FROM grid WHERE click IS NOT NULL AND view IS NOT NULL",
    "discovered_features": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n FROM lineitem" for c in ["l_partkey", "l_suppkey", *LINE_COLS]),
    "split_filter": f"WITH {BAND} SELECT ds, {r('y', 'y')}, split FROM band_result WHERE split = 'test'",
    "flag_labels": f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE anomaly WHEN 1 THEN 'anomaly' ELSE 'normal' END AS label FROM lines",
    "result_projection": f"WITH {SCORE} SELECT pos, \"timestamp\", was_missing, {CH6}, anomaly_if, anomaly, {r('anomaly_score', 'anomaly_score')}, split FROM score_result",
    "flags_identical": f"WITH {BAND} SELECT bool_and(anomaly = anomaly_residual) AS identical FROM band_result",
    "external_forecast": f"""WITH {BAND}, part AS (SELECT band.* FROM band JOIN grid ON band.ds = grid."timestamp" WHERE grid.view IS NOT NULL),
        j AS (SELECT a."timestamp" AS ds, a.click AS y, yhat, yhat_lower, yhat_upper FROM clean a LEFT JOIN part ON a."timestamp" = part.ds WHERE a.click IS NOT NULL)
        SELECT ds, {r('y', 'y')}, {r('yhat', 'yhat')}, {r('yhat_lower', 'yhat_lower')}, {r('yhat_upper', 'yhat_upper')}, {r('y - yhat', 'residual')},
        {r('CASE WHEN (yhat_upper - yhat_lower) / 2 > 0 THEN abs(y - yhat) / ((yhat_upper - yhat_lower) / 2) ELSE 0 END', 'anomaly_score')},
        CASE WHEN y < yhat_lower OR y > yhat_upper THEN 1 ELSE 0 END AS anomaly FROM j""",
    "aligned_window_scores": f"WITH {WFLAGS} SELECT pos, \"timestamp\", {r('view', 'view')}, {r('mse', 'mse')} FROM wscores",
    "aligned_results": f"WITH {MERGED} SELECT \"timestamp\", split, anomaly_prophet, anomaly_if, anomaly_lstm FROM merged",
    "resample_gapless": f"WITH {GRID} SELECT pos, \"timestamp\", {CH6}, was_missing FROM grid",
    "resample_seven_minutes": f"WITH {grid(MIN7, ['click', 'view'], False)} SELECT pos, \"timestamp\", {r('click', 'click')}, {r('view', 'view')}, was_missing FROM grid",
    "resample_per_user": f"WITH {user_grid()} SELECT user_id, pos, \"timestamp\", {CH6}, was_missing FROM grid",
    "dataset_overview": """SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_s, count(DISTINCT user_id) AS n_keys FROM events""",
    "describe_lines": describe("lineitem", LINE_COLS),
    "describe_grid": describe("grid", CHANNELS, f"{GRID},"),
    "rows_per_key": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "distinct_keys": "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_distinct FROM events",
    "correlation_matrix": correlations("lineitem", LINE_COLS),
    "correlation_with_gaps": correlations("grid", CHANNELS, f"{GRID},"),
    "histogram_all": f"WITH {histogram('events', 'value', 50, '', 6)}",
    "histogram_by_flag": f"WITH {LINES}, {histogram('lines', 'l_extendedprice', 60, 'anomaly', 9)}",
    "box_by_flag": f"""WITH {LONG_LINES},
        q AS (SELECT anomaly, col, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL),
        j AS (SELECT long.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM long JOIN q USING (anomaly, col))
        SELECT anomaly, col AS "column", {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')}, count(*) AS n,
        {r('min(value) FILTER (ok)', 'whisker_lo')}, {r('max(value) FILTER (ok)', 'whisker_hi')}, count(*) FILTER (NOT ok) AS n_outliers
        FROM j GROUP BY anomaly, col, q1, j.median, q3""",
    "forecast_metrics": f"WITH {BAND} SELECT split, {r('avg(abs(residual))', 'mae')}, {r('sqrt(avg(residual * residual))', 'rmse')}, {r('avg(anomaly)', 'anomaly_rate')} FROM band_result GROUP BY split",
    "forest_metrics": f"WITH {SCORE} SELECT split, {r('avg(anomaly)', 'anomaly_rate')}, {r('avg(anomaly_score)', 'mean_score')}, count(*) AS n FROM score_result GROUP BY split",
    "window_metrics": f"WITH {WFLAGS} SELECT split, {r('avg(anomaly)', 'anomaly_rate')}, {r('avg(mse)', 'mean_mse')}, {r('max(mse)', 'max_mse')}, count(*) AS n FROM wflags GROUP BY split",
    "kpi_all": kpi("all"),
    "kpi_test": kpi("test"),
    "vote_counts": f"WITH {MERGED} SELECT vote_count, count(*) AS n, {r('count(*) / (SELECT count(*) FROM merged)', 'share')} FROM merged GROUP BY 1",
    "clinical_rows": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {', '.join(r(c, c) for c in LINE_COLS)}, anomaly, "
        + ", ".join(f"{outside(c)} AS {c}_outside" for c in LINE_COLS) + f", {N_OUTSIDE} AS n_vitals_outside_range FROM lines WHERE anomaly = 1",
    "clinical_counts": f"""WITH {LINES}, k AS (SELECT {N_OUTSIDE} AS n_vitals_outside_range FROM lines WHERE anomaly = 1)
        SELECT n_vitals_outside_range, count(*) AS n, {r('count(*) / (SELECT count(*) FROM k)', 'share')} FROM k GROUP BY 1""",
    "pairwise_agreement": f"WITH {MERGED} " + " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, {r(f'avg((anomaly_{a} = anomaly_{b})::INTEGER)', 'agreement')}, "
        f"count(*) FILTER (anomaly_{a} = 1 AND anomaly_{b} = 1) AS both_flag FROM merged" for a, b in PAIRS),
    "rates_by_split": f"WITH {MERGED} " + " UNION ALL ".join(
        f"SELECT coalesce(split, 'all') AS split, count(*) AS n, '{m}' AS model, sum(anomaly_{m})::BIGINT AS n_flagged, {r(f'avg(anomaly_{m})', 'rate')} FROM merged GROUP BY ROLLUP (split)"
        for m in [*MODELS, "ensemble"]),
    "above_median": f"""WITH {LONG_LINES}, m AS (SELECT col, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1)
        SELECT col AS "column", {r('any_value(med)', 'median')}, {r('coalesce(avg((value > med)::INTEGER) FILTER (anomaly = 1), 0)', 'rate')} FROM long JOIN m USING (col) GROUP BY col""",
    "mean_shift": f"""WITH {LONG_LINES} SELECT col AS "column", {r('abs(avg(value) FILTER (anomaly = 1) - avg(value))', 'deviation')} FROM long GROUP BY col""",
    "score_quantiles": quantiles("l_extendedprice", "lineitem", [0.5, 0.9, 0.95, 0.99]),
    "score_quantiles_bracketed": quantiles("l_extendedprice", "lineitem", [0.5, 0.9, 0.95, 0.99]),
    "first_test_time": f"WITH {SCORE} SELECT min(\"timestamp\") FILTER (split = 'test') AS boundary FROM score_result",
    "feature_sanity": f"WITH {FEATURES} " + " UNION ALL ".join([
        *[f"SELECT 'roll_std_variance' AS \"check\", '{n}' AS \"column\", round(var_samp({n}), 4) AS value, round(var_samp({n}), 4) <> 0 AS ok FROM features"
          for n in FEATURE_NAMES if "roll_std" in n],
        "SELECT 'lag_nonzero_rate', 'all', round(" + (lag := "(" + " + ".join(f"avg(({n} <> 0)::INTEGER)" for n in FEATURE_NAMES if "_lag_" in n) + ") / 10")
        + f", 4), {lag} >= 0.9 FROM features",
        "SELECT 'null_count', 'all', (" + " + ".join(f"count(*) - count({n})" for n in FEATURE_NAMES) + ")::DOUBLE, true FROM features",
    ]),
    "interpolate_gap2": f"WITH {GRID}, {fill(2)} SELECT pos, \"timestamp\", {CH6}, was_missing, CASE WHEN {chan('{c} IS NULL', sep=' OR ')} THEN 1 ELSE 0 END AS still_missing FROM filled",
    "interpolate_gap10_small_blocks": f"WITH {GRID}, {fill(10)} SELECT pos, \"timestamp\", {CH6}, was_missing, CASE WHEN {chan('{c} IS NULL', sep=' OR ')} THEN 1 ELSE 0 END AS still_missing FROM filled",
    "interpolate_per_user": f"WITH {user_grid()}, {fill(2, 'user_id')} SELECT user_id, pos, \"timestamp\", {CH6}, was_missing, CASE WHEN {chan('{c} IS NULL', sep=' OR ')} THEN 1 ELSE 0 END AS still_missing FROM filled",
    "clean_minutes": f"WITH {clean(MIN1, 1)} SELECT pos, \"timestamp\", {CH6}, was_missing, still_missing FROM clean",
    "rolling_features": f"WITH {GRID} SELECT pos, {r('click', 'click')}, {r('view', 'view')}, "
        + ", ".join(rolling(c, w) for c in ("click", "view") for w in (5, 15, 60)) + " FROM grid",
    "rolling_features_wide": f"WITH {GRID} SELECT pos, {CH6}, "
        + ", ".join(rolling(c, w) for c in CHANNELS for w in (5, 15, 60)) + " FROM grid",
    "rolling_with_outlier": f"WITH {GRID}, o AS (SELECT pos, CASE WHEN pos % 500 = 3 THEN 1e12 ELSE click END AS click FROM grid) SELECT pos, "
        + ", ".join(r(f"CASE WHEN max(click) {over} >= 1e12 THEN CASE WHEN count(click) {over} > 1 THEN -1.0 ELSE 0.0 END ELSE coalesce(stddev_samp(click) {over}, 0) END", f"click_roll_std_{w}")
                    for w in (5, 15, 60) for over in [f"OVER (ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"]) + " FROM o",
    "lag_features": f"WITH {GRID} SELECT pos, {r('click', 'click')}, {r('view', 'view')}, {lags('click', [1, 5, 15])}, {lags('view', [1, 5, 15])} FROM grid",
    "rolling_per_user": f"WITH {user_grid(['click', 'view'])} SELECT user_id, pos, {r('click', 'click')}, {r('view', 'view')}, "
        + ", ".join(f"{rolling(c, 5, 'PARTITION BY user_id ')}, {lags(c, [1], 'PARTITION BY user_id ')}" for c in ("click", "view")) + " FROM grid",
    "row_positions": "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos FROM orders",
    "split_labels": """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, pos, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM p""",
    "sliding_windows": windows_sql(["click", '"view"'], 4),
    "time_ordered": "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events",
    "quantiles_with_null_group": f"""
        WITH l AS (SELECT nullif(l_returnflag, 'N') AS v, l_extendedprice AS x FROM lineitem),
        p AS (SELECT v, prob, quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b FROM l, (VALUES (0.1), (0.5)) t(prob) GROUP BY ALL)
        SELECT v, prob::DOUBLE AS prob, {r('CASE WHEN prob = 0.1 THEN a ELSE b END', 'value')}, way
        FROM p, (VALUES ('small'), ('large')) w(way)""",
    "histogram_null_group": f"""
        WITH l AS (SELECT nullif(l_returnflag, 'N') AS g, l_quantity AS x FROM lineitem),
        b AS (SELECT g, min(x) AS lo, max(x) AS hi, count(*) AS m, (max(x) - min(x)) / 7 AS step FROM l GROUP BY g),
        e AS (SELECT *, lo + bin * step AS a, lo + (bin + 1) * step AS z FROM b, (SELECT unnest(range(7))::INTEGER AS bin))
        SELECT e.g, bin, {r('a', 'left')}, {r('z', 'right')}, count(x) AS n, {r('count(x) / (any_value(m) * any_value(step))', 'density')}
        FROM e LEFT JOIN l ON l.g IS NOT DISTINCT FROM e.g AND x >= a AND (x < z OR bin = 6) GROUP BY e.g, bin, a, z""",
    "box_null_group": f"""
        WITH l AS (SELECT nullif(l_returnflag, 'N') AS bin, l_quantity AS x FROM lineitem),
        q AS (SELECT bin, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY bin)
        SELECT q.bin, 'l_quantity' AS "column", {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')}, count(*) AS n,
          {r('min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_lo')},
          {r('max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_hi')},
          count(*) FILTER (x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM l JOIN q ON l.bin IS NOT DISTINCT FROM q.bin GROUP BY q.bin, q1, median, q3""",
    "positions_null_key": """
        SELECT event_id, nullif(event_type, 'view') AS block,
          row_number() OVER (PARTITION BY nullif(event_type, 'view') ORDER BY event_id) - 1 AS pos FROM events""",
    "top_unanimous": f"WITH {MERGED} SELECT * FROM merged WHERE vote_count = 3 ORDER BY \"timestamp\" LIMIT 20",
    "unanimous_share": f"WITH {MERGED} SELECT count(*) FILTER (vote_count = 3) AS n_unanimous, {r('avg((vote_count = 3)::INTEGER)', 'share')} FROM merged",
    "top_flagged_scores": f"WITH {SCORE} SELECT \"timestamp\", {r('anomaly_score', 'anomaly_score')}, split, {CH6} FROM score_result WHERE anomaly = 1 ORDER BY score_result.anomaly_score DESC, \"timestamp\" LIMIT 20",
    "top_window_scores": f"WITH {WFLAGS} SELECT \"timestamp\", {r('mse', 'mse')}, split, anomaly FROM wflags ORDER BY wflags.mse DESC, \"timestamp\" LIMIT 20",
    "sampled_rows": "SELECT * FROM (SELECT * FROM events ORDER BY md5(concat_ws('|', event_id, 42)), event_id LIMIT 2000) ORDER BY ts, event_id",
    "first_rows": f"SELECT ts, event_id, {r('value', 'value')} FROM events ORDER BY ts, event_id LIMIT 15",
    "time_of_day": f"""SELECT event_id, ts AS "timestamp", {r('sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)', 'sin_time')} , {r('cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)', 'cos_time')} FROM events""",
    "normalised_scores": f"WITH {SCORE} SELECT pos, {r('anomaly_score', 'anomaly_score')}, anomaly FROM score_result",
    "standard_scaled": "SELECT l_orderkey, l_linenumber, " + ", ".join(
        r(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)", c) for c in LINE_COLS) + " FROM lineitem",
    "minmax_scaled": "SELECT l_orderkey, l_linenumber, " + ", ".join(
        r(f"({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)", c) for c in LINE_COLS) + " FROM lineitem",
    "scaled_feature_table": f"WITH {FEATURES} SELECT pos, \"timestamp\", was_missing, " + ", ".join(
        r(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER ()", n, 5) for n in FEATURE_NAMES) + " FROM features",
    "interval_flags": f"WITH {BAND} SELECT pos, ds, {', '.join(r(c, c) for c in ['y', 'yhat', 'yhat_lower', 'yhat_upper', 'residual', 'anomaly_score'])}, anomaly FROM flagged",
    "residual_zscore": f"WITH {BAND} SELECT ds, {r('residual', 'residual')}, {r('residual_zscore', 'residual_zscore')}, anomaly_residual, split FROM band_result",
    "window_threshold": f"WITH {WFLAGS} SELECT {r('mu', 'mu')}, {r('sigma', 'sigma')}, {r('mu + 3 * sigma', 'threshold')} FROM wtrain",
    "window_flags": f"WITH {WFLAGS} SELECT pos, \"timestamp\", {r('mse', 'mse')}, split, {r('threshold', 'threshold')}, anomaly FROM wflags",
    "threshold_sweep": f"WITH {WFLAGS} " + " UNION ALL ".join(
        f"SELECT {k}::DOUBLE AS multiplier, {r(f'max(mu + {k} * sigma1)', 'threshold')}, count(*) FILTER (mse > mu + {k} * sigma1) AS n_flagged, "
        f"{r(f'count(*) FILTER (mse > mu + {k} * sigma1) / count(*)', 'rate')} FROM wscores, wtrain" for k in (2.0, 2.5, 3.0, 3.5, 4.0)),
    "rethresholded": f"WITH {WFLAGS} SELECT pos, {r('mse', 'mse')}, {r('mu + 2 * sigma1', 'threshold')}, CASE WHEN mse > mu + 2 * sigma1 THEN 1 ELSE 0 END AS anomaly FROM wscores, wtrain",
    "contamination_sweep": f"WITH {SCORE} " + " UNION ALL ".join(
        f"SELECT {c}::DOUBLE AS contamination, {r('any_value(t)', 'threshold')}, count(*) FILTER (anomaly_score >= t) AS n_flagged, "
        f"{r('count(*) FILTER (anomaly_score >= t) / count(*)', 'rate')} FROM score_result, (SELECT quantile_cont(anomaly_score, {q}) AS t FROM score_result)"
        for c, q in ((0.01, 0.99), (0.03, 0.97), (0.05, 0.95), (0.08, 0.92), (0.10, 0.90))),
    "ensemble_votes": f"WITH {MERGED} SELECT * FROM merged",
    "window_error_of_zero": f"""WITH {CLEAN}, sq AS (SELECT pos, {' + '.join(f'coalesce({c}, 0) * coalesce({c}, 0)' for c in CHANNELS)} AS s FROM clean),
        w AS (SELECT pos, sum(s) OVER (ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) / {WINDOW * len(CHANNELS)} AS mse FROM sq)
        SELECT pos, {r('mse', 'mse')} FROM w WHERE pos >= {WINDOW - 1}""",
    "forecast_status": f"WITH {CLEAN} " + " UNION ALL ".join(
        f"SELECT '{c}' AS series, CAST(floor(count({c}) * 0.8::DOUBLE) AS BIGINT) AS n, 'ok' AS status FROM clean" for c in CHANNELS)
        + " UNION ALL SELECT 'not_there', 0, 'failed: no such column'",
}
