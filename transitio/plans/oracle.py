"""Independent DuckDB formulations of the registered queries.

Written from the operator semantics, not from the Spark code: window ``row_number`` in
place of the dense index, range joins in place of slot explosion, correlated filters in
place of systematic-sampling joins. Tables are the driver's pre-registered views.
"""

from __future__ import annotations

# Shared CTEs: the test-table mapping, restated in SQL.
EV = """ev AS (
  SELECT user_id AS uid, CAST(ts AS DATE) AS d, CAST(floor(hour(ts) / 6) AS INTEGER) AS epoch,
         event_type AS et, CAST(value AS DECIMAL(12,2)) AS v,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def _epoch_mean(i: int, alias: str, scale: str = "") -> str:
    return (f"CAST(sum(v) FILTER (WHERE epoch = {i}) AS DOUBLE) / "
            f"nullif(count(v) FILTER (WHERE epoch = {i}), 0){scale} AS {alias}")


BAT = f"""bat AS (
  SELECT uid, d, {_epoch_mean(0, 'b0')}, {_epoch_mean(1, 'b1')}, {_epoch_mean(2, 'b2')}, {_epoch_mean(3, 'b3')},
         CAST(max(v) FILTER (WHERE epoch = 1) - min(v) FILTER (WHERE epoch = 1) AS DOUBLE) AS bstd
  FROM ev WHERE et IN ('view', 'click') GROUP BY uid, d),
bday AS (
  SELECT uid, d,
         CAST(trunc(CASE WHEN s > 0 THEN s / 4.0 ELSE 0.0 END) AS INTEGER) AS bmean,
         CAST(trunc(CASE WHEN bstd * bstd > 0 THEN sqrt(bstd * bstd / 1.0) ELSE 0.0 END) AS INTEGER) AS bstd_i,
         CAST(trunc(b2) AS INTEGER) AS baft
  FROM (SELECT *, coalesce(b0, 0.0) + coalesce(b1, 0.0) + coalesce(b2, 0.0) + coalesce(b3, 0.0) AS s FROM bat))"""

ACC = f"""acc AS (
  SELECT uid, d, {_epoch_mean(0, 'm0', ' / 100.0')}, {_epoch_mean(1, 'm1', ' / 100.0')},
         {_epoch_mean(2, 'm2', ' / 100.0')}, {_epoch_mean(3, 'm3', ' / 100.0')}
  FROM ev GROUP BY uid, d)"""

SCR = """scr AS (
  SELECT uid, d,
         CAST(sum(v) FILTER (WHERE epoch = 0 AND et = 'error') * 60 AS DOUBLE) AS off0,
         CAST(sum(v) FILTER (WHERE epoch = 1 AND et = 'error') * 60 AS DOUBLE) AS off1,
         CAST(sum(v) FILTER (WHERE epoch = 2 AND et = 'error') * 60 AS DOUBLE) AS off2,
         CAST(sum(v) FILTER (WHERE epoch = 3 AND et = 'error') * 60 AS DOUBLE) AS off3,
         CAST(sum(v) FILTER (WHERE epoch = 0 AND et = 'click') * 60 AS DOUBLE) AS use0,
         CAST(sum(v) FILTER (WHERE epoch = 1 AND et = 'click') * 60 AS DOUBLE) AS use1,
         CAST(sum(v) FILTER (WHERE epoch = 2 AND et = 'click') * 60 AS DOUBLE) AS use2,
         CAST(sum(v) FILTER (WHERE epoch = 3 AND et = 'click') * 60 AS DOUBLE) AS use3
  FROM ev WHERE et IN ('error', 'click') GROUP BY uid, d)"""

LOC = """loc AS (
  SELECT uid, d,
         CAST(sum(k) FILTER (WHERE et <> 'error') AS DOUBLE) AS n_static,
         CAST(count(*) FILTER (WHERE et = 'error') AS DOUBLE) AS n_moving,
         CAST(count(DISTINCT et) AS DOUBLE) AS n_bins
  FROM ev GROUP BY uid, d)"""


def npround(expr: str, digits: int = 1) -> str:
    scale = float(10 ** digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def phq_cte(p: int) -> str:
    return f"""users AS (SELECT DISTINCT uid FROM ev),
span AS (SELECT min(d) AS first, datediff('day', min(d), max(d)) // {p} AS n_k FROM ev),
asg AS (SELECT uid, CAST(first + CAST({p} * k AS INTEGER) AS DATE) AS date, CAST(k + 1 AS INTEGER) AS idx, k
        FROM (SELECT uid, first, unnest(range(0, n_k + 1)) AS k FROM users CROSS JOIN span)),
phq AS (
  SELECT a.uid, a.date, a.idx,
         CASE WHEN (a.uid + a.k) % 17 = 0 THEN NULL ELSE CAST(sum(e.k) % 28 AS DOUBLE) END AS phq9
  FROM asg a LEFT JOIN ev e ON e.uid = a.uid AND e.d > a.date - {p} AND e.d <= a.date
  GROUP BY a.uid, a.date, a.idx, a.k),
valid AS (SELECT * FROM phq WHERE NOT (idx IS NOT DISTINCT FROM 1) AND phq9 IS NOT NULL)"""


def records_cte(p: int) -> str:
    """Gate by range join: missing = period - days with a battery row whose mean is not 0."""
    return f"""rec_all AS (
  SELECT v.uid, v.date, v.idx, v.phq9,
         CAST({p} - count(b.d) FILTER (WHERE b.bmean <> 0) AS INTEGER) AS n_missing
  FROM valid v LEFT JOIN bday b ON b.uid = v.uid AND b.d > v.date - {p} AND b.d <= v.date
  GROUP BY v.uid, v.date, v.idx, v.phq9),
rec AS (SELECT * FROM rec_all WHERE n_missing <= {p // 2})"""


def label_sql(cur: str, pre: str, t: float = 3) -> str:
    return (f"CASE WHEN {cur} - {pre} > {t} THEN 'More Depressed' "
            f"WHEN {pre} - {cur} > {t} THEN 'Less Depressed' ELSE 'Remains' END")


def state_sql(score: str, cut: float = 10) -> str:
    return f"CASE WHEN {score} >= {cut} THEN 'in depression' ELSE 'in non-depression' END"


def transition_labels(p: int) -> str:
    return f"""WITH {EV}, {BAT}, {phq_cte(p)}, {records_cte(p)},
lagged AS (
  SELECT *, lag(date) OVER w AS prev_date, lag(phq9) OVER w AS prev_phq9
  FROM rec WINDOW w AS (PARTITION BY uid ORDER BY date, idx))
SELECT uid AS "user", date, prev_date, phq9, prev_phq9, {label_sql('phq9', 'prev_phq9')} AS label
FROM lagged WHERE datediff('day', prev_date, date) = {p}"""


ORACLE: dict[str, str] = {
    "transition_labels": transition_labels(14),
    "transition_labels_p7": transition_labels(7),
}


# ---------------------------------------------------------------- daily sensor functions
from transitio.operators import prompts as _P  # noqa: E402  (fixed wording only)

EPOCH_NAMES = ("night", "morning", "afternoon", "evening")
APP_CATS = ("click", "error", "purchase", "signup", "view")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def app_cte() -> str:
    cols = ", ".join(f"CAST(sum(v) FILTER (WHERE epoch = {i} AND et = '{c}') * 10 AS DOUBLE) AS a_{c}_{i}"
                     for c in APP_CATS for i in range(4))
    return f"app AS (SELECT uid, d, {cols} FROM ev GROUP BY uid, d)"


def per_unit(x: str, unit: float) -> str:
    return npround(f"CASE WHEN {x} = 0 THEN 0.0 ELSE {x} / {unit} END", 1)


MAGMAX = npround("CASE WHEN greatest(m1, m2, m3, m0) > 0 THEN greatest(m1, m2, m3, m0) ELSE 0.0 END", 1)
RATIO = (f"CASE WHEN n_static IS NULL OR n_moving IS NULL THEN NULL "
         f"WHEN n_moving = 0 THEN CAST('Infinity' AS DOUBLE) ELSE {npround('n_static / n_moving', 2)} END")

ORACLE.update({
    "battery_daily": f"""WITH {EV}, {BAT}
SELECT uid AS "user", d AS date, bmean AS battery_mean, baft AS battery_afternoon FROM bday""",
    "quadratic_mean_std": f"""WITH {EV}, {BAT}
SELECT uid AS "user", d AS date, bstd_i AS battery_std FROM bday""",
    "magnitude_max": f"""WITH {EV}, {ACC}
SELECT uid AS "user", d AS date, {MAGMAX} AS magnitude_max FROM acc""",
    "magnitude_afternoon": f"""WITH {EV}, {ACC}
SELECT uid AS "user", d AS date, {npround('m2', 1)} AS magnitude_afternoon FROM acc""",
    "app_minutes": f"""WITH {EV}, {app_cte()}
SELECT uid AS "user", d AS date, """ + ", ".join(
        f"{per_unit(f'a_{c}_{i}', 60.0)} AS app_{c}_{e}_min" for c in APP_CATS for i, e in enumerate(EPOCH_NAMES))
    + " FROM app",
    "screen_hours": f"""WITH {EV}, {SCR}
SELECT uid AS "user", d AS date, """ + ", ".join(
        f"{per_unit(f'{k}{i}', 3600.0)} AS screen_{k}_{e}_hours" for k in ("off", "use") for i, e in enumerate(EPOCH_NAMES))
    + " FROM scr",
    "location_ratio": f"""WITH {EV}, {LOC}
SELECT uid AS "user", d AS date, {RATIO} AS location_ratio FROM loc""",
    "location_bins": f"""WITH {EV}, {LOC}
SELECT uid AS "user", d AS date, n_bins AS location_bins FROM loc""",
})

SURVEY = """sv_all AS (
  SELECT c_custkey AS uid, CAST(c_custkey % 2 AS INTEGER) AS bg_sex,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'mmm-control' ELSE 'patient' END AS grp,
         CAST(18 + c_custkey % 50 AS INTEGER) AS bg_age, 1 AS fo FROM customer
  UNION ALL
  SELECT c_custkey, CAST(c_custkey % 2 AS INTEGER),
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'mmm-control' ELSE 'patient' END,
         CAST(18 + c_custkey % 50 + 1 AS INTEGER), 2 FROM customer WHERE c_custkey % 5 = 0),
sv AS (SELECT uid, bg_sex, grp, bg_age FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY fo) AS rn FROM sv_all) WHERE rn = 1)"""

BASE14 = f"{EV}, {BAT}, {phq_cte(14)}"

ORACLE.update({
    "valid_assessments": f"""WITH {BASE14}
SELECT uid AS "user", date, idx, phq9 FROM valid""",
    "dedupe_first": f"""WITH {SURVEY}
SELECT uid AS "user", bg_sex, grp AS "group", bg_age FROM sv""",
    "date_slots": f"""WITH {BASE14}
SELECT uid AS "user", date AS anchor, idx, CAST(s AS INTEGER) AS slot, CAST(date - 14 + CAST(s AS INTEGER) AS DATE) AS slot_date,
       strftime(date, '%Y-%m-%d') AS anchor_text
FROM valid CROSS JOIN range(1, 15) r(s)""",
    "user_window_filter": f"""WITH {BASE14}
SELECT v.uid AS "user", v.date AS anchor, b.d AS date
FROM valid v JOIN bat b ON b.uid = v.uid AND b.d > v.date - 14 AND b.d <= v.date""",
    "interval_join_sum": f"""WITH {BASE14}
SELECT v.uid AS "user", v.date, v.idx, count(b.d) AS n_days, CAST(coalesce(sum(b.bmean), 0) AS BIGINT) AS sum_battery_mean
FROM valid v LEFT JOIN bday b ON b.uid = v.uid AND b.d > v.date - 14 AND b.d <= v.date
GROUP BY v.uid, v.date, v.idx""",
    "zero_mask": f"""WITH {BASE14}, {SCR}
SELECT v.uid AS "user", v.date, v.idx,
  (SELECT count(*) FROM bday b WHERE b.uid = v.uid AND b.d > v.date - 14 AND b.d <= v.date AND b.bmean = 0) AS n_masked,
  14 - (SELECT count(*) FROM bday b WHERE b.uid = v.uid AND b.d > v.date - 14 AND b.d <= v.date) AS n_absent,
  (SELECT count(*) FROM scr s WHERE s.uid = v.uid AND s.d > v.date - 14 AND s.d <= v.date) AS n_screen_present,
  (SELECT count(*) FROM scr s LEFT JOIN bday b ON b.uid = s.uid AND b.d = s.d
    WHERE s.uid = v.uid AND s.d > v.date - 14 AND s.d <= v.date AND coalesce(b.bmean <> 0, true)) AS n_screen_kept
FROM valid v""",
    "quality_gate": f"""WITH {BASE14}, {records_cte(14)}
SELECT uid AS "user", date, idx, n_missing, n_missing <= 7 AS kept FROM rec_all""",
})


def fmt_int(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS INTEGER) AS VARCHAR), 'NaN')"


def fmt_double(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN 'Inf' "
            f"ELSE CAST({x} AS VARCHAR) END")


FEATURE_SQL = {
    "battery_afternoon": ("baft", "int"),
    "screen_off_night_duration": (per_unit("off0", 3600.0), "double"),
    "screen_use_duration_afternoon": (per_unit("use2", 3600.0), "double"),
    "magnitude_max": (f"CASE WHEN acc_present THEN {MAGMAX} END", "double"),
}
FEATS = list(FEATURE_SQL)  # configuration order
ORDER = ["battery_afternoon", "screen_off_night_duration", "screen_use_duration_afternoon", "magnitude_max"]


def seq_ctes(p: int = 14) -> str:
    """Kept records with their masked per-slot values and one text sequence per feature."""
    masked = ", ".join(f"CASE WHEN masked THEN NULL ELSE {expr} END AS {name}" for name, (expr, _) in FEATURE_SQL.items())
    aggs = ", ".join(
        f"string_agg({fmt_int(n) if k == 'int' else fmt_double(n)}, ', ' ORDER BY slot) AS s_{n}"
        for n, (_, k) in FEATURE_SQL.items())
    return f"""{ACC}, {SCR},
sl AS (SELECT r.uid, r.date, r.idx, r.phq9, CAST(s AS INTEGER) AS slot, CAST(r.date - {p} + CAST(s AS INTEGER) AS DATE) AS d
       FROM rec r CROSS JOIN range(1, {p + 1}) t(s)),
sv_slot AS (SELECT sl.*, coalesce(b.bmean = 0, false) AS masked, b.baft, a.uid IS NOT NULL AS acc_present, a.m0, a.m1, a.m2, a.m3, c.off0, c.use2
       FROM sl LEFT JOIN bday b ON b.uid = sl.uid AND b.d = sl.d
               LEFT JOIN acc a ON a.uid = sl.uid AND a.d = sl.d
               LEFT JOIN scr c ON c.uid = sl.uid AND c.d = sl.d),
fv AS (SELECT uid, date, idx, phq9, slot, {masked} FROM sv_slot),
seq AS (SELECT uid, date, idx, phq9, {aggs} FROM fv GROUP BY uid, date, idx, phq9)"""


def hist_cte() -> str:
    cols = []
    for n in FEATS:
        x = f"f.{n}"
        cols.append(f"CASE WHEN count({x}) > 0 THEN {npround(f'CAST(sum(CAST({x} AS DECIMAL(28,9))) AS DOUBLE) / count({x})', 1)} END AS hist_{n}")
    return f"""hist AS (SELECT r.uid, r.date, r.idx, {', '.join(cols)}
  FROM rec r LEFT JOIN fv f ON f.uid = r.uid AND (f.date < r.date OR (f.date = r.date AND f.idx < r.idx))
  GROUP BY r.uid, r.date, r.idx)"""


def stats_sql(prefix: str, descriptions: dict) -> str:
    parts = [f"{q(descriptions[n] + ': ')} || {prefix}s_{n} || '. '" for n in ORDER]
    return " || ".join(parts)


def hist_text_sql() -> str:
    return " || ".join(f"{q(_P.history_description(n) + ': ')} || coalesce(CAST(hist_{n} AS VARCHAR), 'NaN') || '. '"
                       for n in ORDER)


SEQ14 = f"{BASE14}, {records_cte(14)}, {seq_ctes(14)}"

PAIRS = f"""{SEQ14}, {hist_cte()}, {SURVEY},
lagged AS (
  SELECT s.*, h.*EXCLUDE (uid, date, idx),
         lag(s.date) OVER w AS prev_date, lag(s.phq9) OVER w AS prev_phq9,
         {', '.join(f'lag(s.s_{n}) OVER w AS p_s_{n}' for n in FEATS)}
  FROM seq s JOIN hist h ON h.uid = s.uid AND h.date = s.date AND h.idx = s.idx
  WINDOW w AS (PARTITION BY s.uid ORDER BY s.date, s.idx)),
pairs AS (
  SELECT l.*, sv.bg_sex, sv.grp, sv.bg_age,
         {stats_sql('', _P.CURRENT_DESCRIPTIONS)} AS cur_stats,
         {stats_sql('p_', _P.PREVIOUS_DESCRIPTIONS)} AS pre_stats,
         {hist_text_sql()} AS hist_text,
         {state_sql('prev_phq9')} AS previous_state, {state_sql('phq9')} AS current_state,
         {label_sql('phq9', 'prev_phq9')} AS label
  FROM lagged l LEFT JOIN sv ON sv.uid = l.uid
  WHERE datediff('day', prev_date, date) = 14),
prompts AS (
  SELECT *,
    {q(_P.PRE_DATA_START)} || pre_stats || 'This person was ' || previous_state || ' over the previous two weeks.'
      || {q(_P.CUR_DATA_START)} || cur_stats || {q(_P.CUR_STATE_PREDICTION)} AS basic,
    'The following data comes from a ' || CAST(bg_age AS VARCHAR) || '-year-old '
      || CASE WHEN bg_sex = 1 THEN 'male' ELSE 'female' END || '. ' AS ctx,
    ' This person was ' || CASE WHEN grp = 'mmm-control' THEN 'not depressed' ELSE 'depressed' END
      || ' when they first entered the experiment. ' AS init
  FROM pairs)"""

PROMPT_COLS = f"""basic AS "Basic", {q(_P.PHQ_EXPLAIN)} || basic AS "Health_Informtion",
  {q(_P.HISTORY_START)} || hist_text || basic AS "Statistics",
  {q(_P.PHQ_EXPLAIN)} || ctx || init || {q(_P.HISTORY_START)} || hist_text || basic AS "All\""""

ORACLE.update({
    "align_sequence": f"""WITH {SEQ14}
SELECT uid AS "user", date, s_magnitude_max AS magnitude_max_seq FROM seq""",
    "feature_projection": f"""WITH {SEQ14}
SELECT uid AS "user", date, phq9, s_battery_afternoon AS battery_afternoon_seq,
       s_screen_off_night_duration AS screen_off_night_duration_seq FROM seq""",
    "survey_join": f"""WITH {BASE14}, {records_cte(14)}, {SURVEY}
SELECT r.uid AS "user", r.date, r.phq9, sv.bg_sex AS gender, sv.grp AS "group", sv.bg_age AS age
FROM rec r LEFT JOIN sv ON sv.uid = r.uid""",
    "nest_user_records": f"""WITH {BASE14}, {records_cte(14)}, {SURVEY}
SELECT r.uid AS "user", sv.bg_sex AS gender, sv.grp AS "group", sv.bg_age AS age, count(*) AS n_records,
       strftime(min(r.date), '%Y-%m-%d') AS first_date, strftime(max(r.date), '%Y-%m-%d') AS last_date,
       sum(r.phq9) AS phq_total
FROM rec r LEFT JOIN sv ON sv.uid = r.uid GROUP BY r.uid, sv.bg_sex, sv.grp, sv.bg_age""",
    "adjacent_pairs": f"""WITH {PAIRS}
SELECT uid AS "user", date, prev_date, previous_state, current_state, label,
       s_magnitude_max AS cur_seq, p_s_magnitude_max AS prev_seq FROM pairs""",
    "forecast_pairs": f"""WITH {BASE14}, {records_cte(14)},
led AS (SELECT *, lead(date) OVER w AS next_date, lead(phq9) OVER w AS next_phq9
        FROM rec WINDOW w AS (PARTITION BY uid ORDER BY date, idx))
SELECT uid AS "user", date, phq9, next_phq9 AS future_phq9, {label_sql('next_phq9', 'phq9')} AS label
FROM led WHERE datediff('day', date, next_date) = 14 AND next_phq9 IS NOT NULL""",
    "history_average": f"""WITH {SEQ14}, {hist_cte()}
SELECT uid AS "user", date, {', '.join(f'hist_{n}' for n in FEATS)} FROM hist""",
    "severity_state": f"""WITH {BASE14}, {records_cte(14)}
SELECT uid AS "user", date, phq9, {state_sql('phq9')} AS state FROM rec""",
    "demographic_context": f"""WITH {EV}, {SURVEY}
SELECT uid AS "user",
  'The following data comes from a ' || CAST(bg_age AS VARCHAR) || '-year-old '
    || CASE WHEN bg_sex = 1 THEN 'male' ELSE 'female' END || '. ' AS context,
  ' This person was ' || CASE WHEN grp = 'mmm-control' THEN 'not depressed' ELSE 'depressed' END
    || ' when they first entered the experiment. ' AS initial
FROM sv WHERE uid IN (SELECT uid FROM ev)""",
    "label_code": f"""SELECT "user", date, label,
  CASE label WHEN 'Remains' THEN 0 WHEN 'More Depressed' THEN 1 WHEN 'Less Depressed' THEN 2 END AS code
FROM ({transition_labels(14)})""",
    "statistics_text": f"""WITH {SEQ14}
SELECT uid AS "user", date, {stats_sql('', _P.CURRENT_DESCRIPTIONS)} AS statistics FROM seq""",
    "history_text": f"""WITH {SEQ14}, {hist_cte()}
SELECT uid AS "user", date, {hist_text_sql()} AS history FROM hist""",
    "prompt_table": f"""WITH {PAIRS}
SELECT uid AS "user", date, phq9 AS current_phq, prev_phq9 AS previous_phq, previous_state, current_state, label,
  {PROMPT_COLS} FROM prompts""",
    "prompt_variants": f"""WITH {PAIRS}, pv AS (SELECT uid, date, {PROMPT_COLS} FROM prompts)
SELECT uid AS "user", date, """ + ", ".join(
        f'length("{n}") AS {n.lower()}_len, md5("{n}") AS {n.lower()}_md5'
        for n in ("Basic", "Health_Informtion", "Statistics", "All")) + " FROM pv",
})


# ---------------------------------------------------------------- evaluation and sampling
CT = """ct AS (
  SELECT d.doc_id, d.source, d.lang, d.text AS data, l.quality, l.toxic,
         CASE WHEN l.toxic = 1 THEN 'More Depressed' WHEN l.quality = 0 THEN 'Less Depressed' ELSE 'Remains' END AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def h60(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


def split_cte(seed: str = "'1'", name: str = "split") -> str:
    return f"""gs AS (SELECT source, row_number() OVER (ORDER BY md5({seed} || ':' || source), source) - 1 AS pos,
              count(*) OVER () AS g FROM (SELECT DISTINCT source FROM ct)),
{name} AS (SELECT ct.*, CASE WHEN gs.pos < ceil(CAST(gs.g AS DOUBLE) * 0.4) THEN 'test' ELSE 'train' END AS side
          FROM ct JOIN gs ON gs.source = ct.source)"""


def metric_ctes(src: str, keys: list[str], y: str, yh: str) -> str:
    """Per-label counts by correlated sums over the confusion cells."""
    kc = ", ".join(keys)
    kk = "".join(f" AND c.{k} = l.{k}" for k in keys)
    return f"""cells AS (SELECT {kc + ', ' if keys else ''}{y} AS y, {yh} AS yh, count(*) AS n FROM {src} GROUP BY ALL),
labs AS (SELECT {kc + ', ' if keys else ''}y AS label FROM cells UNION SELECT {kc + ', ' if keys else ''}yh FROM cells),
pl AS (SELECT l.*,
  CAST(coalesce((SELECT sum(n) FROM cells c WHERE c.y = l.label AND c.yh = l.label{kk}), 0) AS BIGINT) AS tp,
  CAST(coalesce((SELECT sum(n) FROM cells c WHERE c.y = l.label{kk}), 0) AS BIGINT) AS sup,
  CAST(coalesce((SELECT sum(n) FROM cells c WHERE c.yh = l.label{kk}), 0) AS BIGINT) AS pred
  FROM labs l),
pm AS (SELECT *, CASE WHEN pred > 0 THEN CAST(tp AS DOUBLE) / pred ELSE 0.0 END AS p,
              CASE WHEN sup > 0 THEN CAST(tp AS DOUBLE) / sup ELSE 0.0 END AS r,
              CASE WHEN sup + pred > 0 THEN 2.0 * tp / (sup + pred) ELSE 0.0 END AS f FROM pl)"""


def metric_select(keys: list[str], cols=None) -> str:
    allc = {
        "accuracy": "CAST(sum(tp) AS DOUBLE) / sum(sup)", "macro_precision": "avg(p)", "macro_recall": "avg(r)",
        "macro_f1": "avg(f)", "weighted_precision": "sum(p * sup) / sum(sup)",
        "weighted_recall": "sum(r * sup) / sum(sup)", "weighted_f1": "sum(f * sup) / sum(sup)"}
    cols = cols or list(allc)
    sel = ", ".join(f"round({allc[c]}, 10) AS {c}" for c in cols)
    kc = ", ".join(keys)
    extra = ", CAST(sum(sup) AS BIGINT) AS n" if cols == list(allc) else ""
    return f"SELECT {kc + ', ' if keys else ''}{sel}{extra} FROM pm {'GROUP BY ' + kc if keys else ''}"


QT = "qt AS (SELECT doc_id, lang, CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS yh FROM ct)"

ORACLE.update({
    "eval_metrics": f"WITH {CT}, {QT}, {metric_ctes('qt', ['lang'], 'y', 'yh')}\n{metric_select(['lang'])}",
    "confusion_matrix": f"""WITH {CT}, {QT},
cells AS (SELECT y, yh, count(*) AS n FROM qt GROUP BY y, yh),
labs AS (SELECT y AS label FROM cells UNION SELECT yh FROM cells)
SELECT a.label AS true_label, b.label AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM labs a, labs b LEFT JOIN cells c ON c.y = a.label AND c.yh = b.label""",
    "class_report": f"""WITH {CT}, {QT}, {metric_ctes('qt', ['lang'], 'y', 'yh')}
SELECT lang, label, round(p, 10) AS precision, round(r, 10) AS recall, round(f, 10) AS f1, sup AS support FROM pm""",
    "class_report_full": f"""WITH {CT}, {QT}, {metric_ctes('qt', [], 'y', 'yh')},
fixed AS (SELECT * FROM (VALUES ('0'), ('1'), ('2')) t(label)),
rows AS (SELECT fx.label AS "row", coalesce(pm.p, 0.0) AS p, coalesce(pm.r, 0.0) AS r, coalesce(pm.f, 0.0) AS f,
                CAST(coalesce(pm.sup, 0) AS BIGINT) AS sup FROM fixed fx LEFT JOIN pm ON pm.label = fx.label),
tot AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(sup) AS acc, CAST(sum(sup) AS BIGINT) AS n FROM pm)
SELECT "row", round(p, 10) AS precision, round(r, 10) AS recall, round(f, 10) AS f1, sup AS support FROM rows
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 10), n FROM tot
UNION ALL SELECT 'macro avg', round(avg(p), 10), round(avg(r), 10), round(avg(f), 10), (SELECT n FROM tot) FROM rows
UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 10), round(sum(r * sup) / sum(sup), 10),
                 round(sum(f * sup) / sum(sup), 10), (SELECT n FROM tot) FROM rows""",
    "class_counts": f"""WITH {CT}, c AS (SELECT label, count(*) AS n FROM ct GROUP BY label)
SELECT label, n, avg(n) OVER () AS mean_n, count(*) OVER () AS n_classes FROM c""",
    "group_split": f"""WITH {CT}, {split_cte()}
SELECT doc_id, source, side FROM split""",
    "two_stage_split": f"""WITH {CT}, {split_cte()},
tr AS (SELECT DISTINCT source FROM split WHERE side = 'train'),
g2 AS (SELECT source, row_number() OVER (ORDER BY md5('1:stage2:' || source), source) - 1 AS pos, count(*) OVER () AS g FROM tr)
SELECT s.doc_id, s.source,
       CASE WHEN s.side = 'test' THEN 'test' WHEN g2.pos < ceil(CAST(g2.g AS DOUBLE) * 0.5) THEN 'eval' ELSE 'train' END AS side
FROM split s LEFT JOIN g2 ON g2.source = s.source""",
    "split_all_seeds": f"""WITH {CT}, seeds AS (SELECT * FROM range(1, 6) t(seed)),
gsrc AS (SELECT DISTINCT source FROM ct),
gs AS (SELECT seed, source, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || ':' || source), source) - 1 AS pos,
              count(*) OVER (PARTITION BY seed) AS g FROM seeds, gsrc)
SELECT CAST(gs.seed AS INTEGER) AS seed, ct.doc_id,
       CASE WHEN gs.pos < ceil(CAST(gs.g AS DOUBLE) * 0.4) THEN 'test' ELSE 'train' END AS side
FROM ct JOIN gs ON gs.source = ct.source""",
    "oversample": f"""WITH {CT}, {split_cte()},
tr AS (SELECT doc_id, label FROM split WHERE side = 'train'),
cnt AS (SELECT label, count(*) AS c FROM tr GROUP BY label),
need AS (SELECT label, c, CAST(floor((SELECT avg(c) FROM cnt)) AS BIGINT) AS n FROM cnt WHERE c < (SELECT avg(c) FROM cnt)),
draws AS (SELECT label, c, unnest(range(0, n)) AS j FROM need),
pos AS (SELECT label, j + 1 AS draw, {h60("'1:' || label || ':' || CAST(j AS VARCHAR)")} % c AS pos FROM draws),
idx AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos FROM tr)
SELECT doc_id, label, 0 AS copy, 0 AS draw FROM tr
UNION ALL SELECT idx.doc_id, idx.label, 1, draw FROM pos JOIN idx ON idx.label = pos.label AND idx.pos = pos.pos""",
    "holdout_split": f"""WITH {CT},
ix AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos, count(*) OVER () AS n FROM ct)
SELECT doc_id, CASE WHEN pos < floor(CAST(n AS DOUBLE) * 0.2) THEN 'validation' ELSE 'train' END AS side FROM ix""",
    "stratified_folds": f"""WITH {CT}
SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 3 AS INTEGER) AS fold
FROM ct""",
})


def fewshot_ctes(n: int, query_filter: str = "TRUE", stratum: str = "lang", text: str = "data",
                 pool_src: str | None = None, query_src: str = "split") -> str:
    """Systematic sampling restated with window functions over the pool, by default the
    oversampled train side: classes below the mean size get that many drawn rows."""
    drawn = "" if pool_src else f"""os_tr AS (SELECT * FROM split WHERE side = 'train'),
os_cnt AS (SELECT label, count(*) AS c FROM os_tr GROUP BY label),
os_draw AS (SELECT label, c, unnest(range(0, CAST(floor((SELECT avg(c) FROM os_cnt)) AS BIGINT))) AS j
            FROM os_cnt WHERE c < (SELECT avg(c) FROM os_cnt)),
os_idx AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS os_pos FROM os_tr),
os_all AS (SELECT * FROM os_tr UNION ALL SELECT i.* EXCLUDE (os_pos) FROM os_draw d JOIN os_idx i
           ON i.label = d.label AND i.os_pos = {h60("'1:' || d.label || ':' || CAST(d.j AS VARCHAR)")} % d.c),
"""
    pool_src = pool_src or "os_all"
    return drawn + f"""pool AS (SELECT {stratum} AS st, md5('1:' || CAST({text} AS VARCHAR)) AS th, doc_id, label, data,
                 row_number() OVER (PARTITION BY {stratum} ORDER BY md5('1:' || CAST({text} AS VARCHAR)),
                                    md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos
          FROM {pool_src}),
sizes AS (SELECT st, count(*) AS cnt FROM pool GROUP BY st),
blocks AS (SELECT st, th, count(*) AS b, max(pos) AS e FROM pool GROUP BY st, th),
qq AS (SELECT q.doc_id AS qid, q.{stratum} AS st, coalesce(s.cnt, 0) AS cnt, coalesce(bl.b, 0) AS b, coalesce(bl.e, -1) AS e
       FROM (SELECT * FROM {query_src} WHERE {query_filter}) q LEFT JOIN sizes s ON s.st = q.{stratum}
       LEFT JOIN blocks bl ON bl.st = q.{stratum} AND bl.th = md5('1:' || CAST(q.{text} AS VARCHAR))),
qm AS (SELECT *, cnt - b AS m, least({n}, cnt - b) AS nf, {h60("'1:q:' || CAST(qid AS VARCHAR)")} % (cnt - b) AS o
       FROM qq WHERE cnt - b > 0),
picks AS (SELECT qid, st, nf, j, (e + 1 + (o + j * m) // nf) % cnt AS pos
          FROM (SELECT *, unnest(range(0, nf)) AS j FROM qm)),
pairs AS (SELECT p.qid AS doc_id, CAST(p.j AS INTEGER) AS j, pool.doc_id AS example_id, CAST(p.nf AS INTEGER) AS n_found,
                 pool.label AS ex_label, pool.data AS ex_data
          FROM picks p JOIN pool ON pool.st = p.st AND pool.pos = p.pos)"""


LABEL_CODE = "CASE {x} WHEN 'Remains' THEN 0 WHEN 'More Depressed' THEN 1 WHEN 'Less Depressed' THEN 2 END"

ORACLE.update({
    "few_shot_pairs": f"""WITH {CT}, {split_cte()}, {fewshot_ctes(5)}
SELECT doc_id, j, example_id, n_found FROM pairs
UNION ALL SELECT qid, NULL, NULL, 0 FROM qq WHERE cnt - b <= 0""",
    "same_subject_examples": f"""WITH {CT}, {fewshot_ctes(3, stratum='source', text='doc_id', pool_src='ct', query_src='ct')}
SELECT doc_id, j, example_id, n_found FROM pairs
UNION ALL SELECT qid, NULL, NULL, 0 FROM qq WHERE cnt - b <= 0""",
    "any_subject_examples": f"""WITH {CT}, ca AS (SELECT *, 'all' AS anyone FROM ct),
{fewshot_ctes(3, stratum='anyone', text='doc_id', pool_src='ca', query_src='ca')}
SELECT doc_id, j, example_id, n_found FROM pairs
UNION ALL SELECT qid, NULL, NULL, 0 FROM qq WHERE cnt - b <= 0""",
    "aligned_predictions": f"""WITH {CT}, {split_cte()}, {fewshot_ctes(1, "side = 'test'")}
SELECT s.doc_id, s.label, p.ex_label AS predicted, p.ex_label IS NOT NULL AS answered
FROM split s LEFT JOIN (SELECT doc_id, ex_label FROM pairs WHERE doc_id % 2 = 0) p ON p.doc_id = s.doc_id WHERE s.side = 'test'""",
    "reject_rows": f"""WITH {SEQ14}, {SURVEY}
SELECT uid AS "user", date, phq9 FROM rec WHERE uid NOT IN (SELECT uid FROM sv WHERE grp = 'patient')""",
    "few_shot_vote": f"""WITH {CT}, {split_cte()}, {fewshot_ctes(5, "side = 'test'")},
v AS (SELECT doc_id, ex_label, count(*) AS votes FROM pairs GROUP BY doc_id, ex_label),
b AS (SELECT doc_id, ex_label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC,
        {LABEL_CODE.format(x='ex_label')}) AS r FROM v) WHERE r = 1)
SELECT s.doc_id, s.label, coalesce(b.ex_label, 'Remains') AS predicted
FROM split s LEFT JOIN b ON b.doc_id = s.doc_id WHERE s.side = 'test'""",
    "shots_curve": f"""WITH {CT}, {split_cte()}, {fewshot_ctes(25, "side = 'test'")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
             md5('1:rank:' || CAST(doc_id AS VARCHAR) || ':' || CAST(example_id AS VARCHAR)), example_id) - 1 AS rnk FROM pairs),
shots AS (SELECT * FROM (VALUES (0), (1), (3), (5), (10), (15), (25)) t(n_shots)),
v AS (SELECT n_shots, doc_id, ex_label, count(*) AS votes FROM ranked, shots WHERE rnk < n_shots GROUP BY ALL),
b AS (SELECT n_shots, doc_id, ex_label FROM (SELECT *, row_number() OVER (PARTITION BY n_shots, doc_id ORDER BY votes DESC,
        {LABEL_CODE.format(x='ex_label')}) AS r FROM v) WHERE r = 1),
pr AS (SELECT sh.n_shots, s.doc_id, s.label, coalesce(b.ex_label, 'Remains') AS predicted
       FROM split s CROSS JOIN shots sh LEFT JOIN b ON b.doc_id = s.doc_id AND b.n_shots = sh.n_shots WHERE s.side = 'test'),
{metric_ctes('pr', ['n_shots'], 'label', 'predicted')}
{metric_select(['n_shots'], ['accuracy', 'macro_f1'])}""",
})

NL = "\n"
HEAD = (_P.TURN_USER.format(content=_P.INSTRUCTION_TURN.format(system=_P.SYSTEM_PROMPT))
        + _P.TURN_ASSISTANT.format(content=_P.ACK_TURN))


def chat_sql(side: str, answer: bool) -> str:
    ex = f"'<start_of_turn>user{NL}' || ex_data || '<end_of_turn>{NL}<start_of_turn>model{NL}Label: ' || ex_label || '{NL}<end_of_turn>{NL}'"
    ans = f" || '<start_of_turn>model{NL}Label: ' || s.label || '{NL}<end_of_turn>{NL}'" if answer else ""
    return f"""WITH {CT}, {split_cte()}, {fewshot_ctes(3, f"side = '{side}'")},
agg AS (SELECT doc_id, count(*) AS n_ex, string_agg({ex}, '' ORDER BY j) AS ex_text FROM pairs GROUP BY doc_id),
txt AS (SELECT s.doc_id, 3 + 2 * coalesce(a.n_ex, 0) {'+ 1' if answer else ''} AS n_messages,
          {q(HEAD)} || coalesce(a.ex_text, '') || '<start_of_turn>user{NL}' || s.data || '<end_of_turn>{NL}'{ans}
          || '<start_of_turn>model{NL}' AS t
        FROM split s LEFT JOIN agg a ON a.doc_id = s.doc_id WHERE s.side = '{side}')
SELECT doc_id, CAST(n_messages AS BIGINT) AS n_messages, CAST(length(t) AS BIGINT) AS chat_len, md5(t) AS chat_md5 FROM txt"""


ORACLE.update({
    "chat_train": chat_sql("train", True),
    "chat_test": chat_sql("test", False),
    "chat_render": f"""WITH r AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(
    CASE role WHEN 'system' THEN '<bos><start_of_turn>model{NL}' || text || '<end_of_turn>{NL}'
              WHEN 'user' THEN '<start_of_turn>user{NL}' || text || '<end_of_turn>{NL}'
              WHEN 'assistant' THEN '<start_of_turn>model{NL}' || text || '<end_of_turn>{NL}' ELSE '' END, '' ORDER BY turn)
    || '<start_of_turn>model{NL}' AS t
  FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(length(t) AS BIGINT) AS chat_len, md5(t) AS chat_md5 FROM r""",
    "parse_label": f"""WITH g AS (
  SELECT doc_id, text AS p, text || CASE {h60('CAST(doc_id AS VARCHAR)')} % 4
      WHEN 0 THEN '{NL}Label: Remains' WHEN 1 THEN ' Label: More Depressed' WHEN 2 THEN 'Label: Less Depressed.'
      ELSE 'no idea' END AS g FROM documents),
o AS (SELECT doc_id, regexp_replace(regexp_replace(substring(g, length(p) + 1), '^\\s+', ''), '\\s+$', '') AS out FROM g)
SELECT doc_id,
  CASE WHEN contains(out, 'Label: Remains') THEN 'Remains' WHEN contains(out, 'Label: More Depressed') THEN 'More Depressed'
       WHEN contains(out, 'Label: Less Depressed') THEN 'Less Depressed' ELSE 'Remains' END AS label,
  contains(out, 'Label: Remains') OR contains(out, 'Label: More Depressed') OR contains(out, 'Label: Less Depressed') AS parsed
FROM o""",
})


# ---------------------------------------------------------------- model preparation
FLAT_ORDER = ["battery_afternoon", "magnitude_max", "screen_off_night_duration", "screen_use_duration_afternoon"]

FORECAST = f"""{SEQ14}, {SURVEY},
led AS (SELECT *, lead(date) OVER w AS next_date, lead(phq9) OVER w AS next_phq9
        FROM rec WINDOW w AS (PARTITION BY uid ORDER BY date, idx)),
fc AS (SELECT uid, date, idx, phq9, next_phq9 AS future_phq9, {label_sql('next_phq9', 'phq9')} AS label
       FROM led WHERE datediff('day', date, next_date) = 14 AND next_phq9 IS NOT NULL),
flat AS (SELECT fc.uid AS user_id, sv.bg_sex AS gender, sv.grp AS "group", sv.bg_age AS age, fc.date,
   {', '.join(f'max(CASE WHEN fv.slot = {i} THEN fv.{f} END) AS {f}_{i}' for f in FLAT_ORDER for i in range(1, 15))},
   fc.phq9 AS phq_week2, fc.future_phq9 AS future_phq_week2, fc.label
  FROM fc JOIN fv ON fv.uid = fc.uid AND fv.date = fc.date AND fv.idx = fc.idx LEFT JOIN sv ON sv.uid = fc.uid
  GROUP BY fc.uid, sv.bg_sex, sv.grp, sv.bg_age, fc.date, fc.phq9, fc.future_phq9, fc.label)"""

_FLAT_COLS = ", ".join(["user_id", "gender", '"group"', "age"] + [f"{f}_{i}" for f in FLAT_ORDER for i in range(1, 15)]
                       + ["phq_week2", "future_phq_week2", "label"])


def _num(x: str) -> str:
    return fmt_double(f"CAST({x} AS DOUBLE)")


USER_SPLIT = """us AS (SELECT uid, row_number() OVER (ORDER BY md5('1:' || CAST(uid AS VARCHAR)), uid) - 1 AS pos,
                     count(*) OVER () AS g FROM (SELECT DISTINCT uid FROM fc)),
uside AS (SELECT uid, CASE WHEN pos < ceil(CAST(g AS DOUBLE) * 0.4) THEN 'test' ELSE 'train' END AS side FROM us)"""

ORACLE.update({
    "flatten_sequences": f"WITH {FORECAST}\nSELECT {_FLAT_COLS} FROM flat",
    "sequence_matrix": f"""WITH {FORECAST},
steps AS (SELECT fc.uid, fc.date, fc.phq9, fv.slot,
   {" || ' ' || ".join(_num('fv.' + f) for f in FLAT_ORDER)} AS step
   FROM fc JOIN fv ON fv.uid = fc.uid AND fv.date = fc.date AND fv.idx = fc.idx)
SELECT uid AS user_id, phq9 AS phq_week2, string_agg(step, '; ' ORDER BY slot) AS matrix FROM steps GROUP BY uid, date, phq9""",
    "numeric_coerce": f"""WITH {CT},
raw AS (SELECT doc_id, source AS r1, substring(source, 4, 10) AS r2,
               CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'NaN' ELSE lang END AS r3 FROM ct),
num AS (SELECT doc_id, {', '.join(f"TRY_CAST(coalesce(r{i}, '0') AS DOUBLE) AS n{i}" for i in (1, 2, 3))} FROM raw)
SELECT doc_id, {', '.join(f'CASE WHEN isnan(n{i}) THEN NULL ELSE n{i} END AS tree_{i}' for i in (1, 2, 3))},
       {', '.join(f'coalesce(CASE WHEN isnan(n{i}) THEN NULL ELSE n{i} END, 0.0) AS seq_{i}' for i in (1, 2, 3))}
FROM num""",
    "standard_scale": f"""WITH e AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS z_{i}' for i in range(64))} FROM embeddings),
ix AS (SELECT vec_id, row_number() OVER (ORDER BY md5('1:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS pos, count(*) OVER () AS n FROM e),
sd AS (SELECT e.*, CASE WHEN pos < floor(CAST(n AS DOUBLE) * 0.2) THEN 'validation' ELSE 'train' END AS side FROM e JOIN ix USING (vec_id)),
st AS (SELECT {', '.join(f'avg(z_{i}) AS mu_{i}, stddev_pop(z_{i}) AS sd_{i}' for i in range(64))} FROM sd WHERE side = 'train')
SELECT vec_id, side, {', '.join(f'round((z_{i} - mu_{i}) / CASE WHEN sd_{i} = 0 THEN 1.0 ELSE sd_{i} END, 6) AS z_{i}' for i in range(64))}
FROM sd, st""",
    "minmax_sequences": f"""WITH {FORECAST}, {USER_SPLIT},
vals AS (SELECT fc.uid, fc.date, u.side, fv.slot,
   {', '.join(f'coalesce(CAST(fv.{f} AS DOUBLE), 0.0) AS {f}' for f in FEATS)}
   FROM fc JOIN fv ON fv.uid = fc.uid AND fv.date = fc.date AND fv.idx = fc.idx JOIN uside u ON u.uid = fc.uid),
st AS (SELECT {', '.join(f'min({f}) AS mn_{f}, max({f}) AS mx_{f}' for f in FEATS)} FROM vals WHERE side = 'train')
SELECT uid AS "user", date, side, {', '.join(
        f'round(sum(({f} - mn_{f}) / CASE WHEN mx_{f} - mn_{f} = 0 THEN 1.0 ELSE mx_{f} - mn_{f} END), 6) AS mm_sum_{f}'
        for f in FEATS)}
FROM vals, st GROUP BY uid, date, side""",
    "label_encode": f"""WITH {FORECAST}, {USER_SPLIT},
tr AS (SELECT DISTINCT uid FROM uside WHERE side = 'train'),
u2 AS (SELECT uid, row_number() OVER (ORDER BY md5('1:stage2:' || CAST(uid AS VARCHAR)), uid) - 1 AS pos, count(*) OVER () AS g FROM tr),
sides AS (SELECT u.uid, CASE WHEN u.side = 'test' THEN 'test' WHEN u2.pos < ceil(CAST(u2.g AS DOUBLE) * 0.5) THEN 'eval' ELSE 'train' END AS side
          FROM uside u LEFT JOIN u2 ON u2.uid = u.uid),
rows AS (SELECT fc.uid, fc.date, s.side, fc.label FROM fc JOIN sides s ON s.uid = fc.uid),
dict AS (SELECT DISTINCT label FROM rows WHERE side IN ('train', 'eval'))
SELECT uid AS "user", date, side, label,
       CASE WHEN label IN (SELECT label FROM dict) THEN CAST((SELECT count(*) FROM dict d WHERE d.label < rows.label) AS INTEGER) END AS code
FROM rows""",
    "argmax_class": """SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted
FROM embeddings""",
})


# ---------------------------------------------------------------- study, sinks and restart
DETAIL = """detail AS (
  SELECT c.c_custkey AS random_seed, c.c_mktsegment AS model, n.n_name AS feature_set,
         (c.c_custkey % 97) / 97.0 AS accuracy,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal / 10000.0 END AS macro_f1,
         (c.c_custkey % 89) / 89.0 AS weighted_f1, (c.c_custkey % 83) / 83.0 AS macro_precision,
         (c.c_custkey % 79) / 79.0 AS macro_recall, CAST(14 * (1 + n.n_nationkey % 4) AS INTEGER) AS num_features
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

_MS = ("accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall")
SUMMARY = DETAIL + """,
summary AS (SELECT model, feature_set, """ + ", ".join(
    f"{npround(f'avg({m})', 4)} AS {m}_mean, {npround(f'stddev_samp({m})', 4)} AS {m}_std" for m in _MS) + """,
  min(num_features) AS num_features_first FROM detail GROUP BY model, feature_set)"""


def _coverage_sql() -> str:
    names = ["battery_afternoon", "screen_off_night_duration", "magnitude_max", "screen_use_duration_afternoon"]
    flags = [f"((i >> {3 - j}) & 1) = 0" for j in range(4)]
    name = "concat_ws('_', " + ", ".join(f"CASE WHEN {flags[j]} THEN '{names[j]}' END" for j in range(4)) + ")"
    nval = " + ".join(f"CASE WHEN {flags[j]} THEN nv_{names[j]} ELSE 0 END" for j in range(4))
    nfeat = " + ".join(f"CAST({flags[j]} AS INTEGER)" for j in range(4))
    return f"""WITH {SEQ14},
tot AS (SELECT (SELECT count(*) FROM rec) AS n_records,
  {', '.join(f'(SELECT count({n}) FROM fv) AS nv_{n}' for n in names)}),
cfg AS (SELECT CAST(i AS INTEGER) AS i FROM range(0, 15) t(i))
SELECT i AS config, {name} AS feature_set, CAST({nfeat} AS INTEGER) AS n_features,
       CAST({nval} AS BIGINT) AS n_values, CAST(n_records AS BIGINT) AS n_records FROM cfg, tot"""


STYLES = ("Basic", "Health_Informtion", "Statistics", "All")

ORACLE.update({
    "study_summary": f"WITH {SUMMARY}\nSELECT * FROM summary",
    "top_performers": f"""WITH {SUMMARY}
SELECT model, feature_set, macro_f1_mean, macro_f1_std, accuracy_mean FROM summary
ORDER BY macro_f1_mean DESC NULLS LAST, model, feature_set LIMIT 10""",
    "best_per_group": f"""WITH {SUMMARY},
r AS (SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY macro_f1_mean DESC NULLS LAST, model, feature_set) AS rf,
               row_number() OVER (PARTITION BY model ORDER BY macro_f1_mean DESC NULLS LAST, model, feature_set) AS rm FROM summary)
SELECT 'feature_set' AS group_kind, feature_set AS group_value, model, feature_set, macro_f1_mean, accuracy_mean FROM r WHERE rf = 1
UNION ALL
SELECT 'model', model, model, feature_set, macro_f1_mean, accuracy_mean FROM r WHERE rm = 1""",
    "best_params": f"""WITH {DETAIL}
SELECT model, feature_set, random_seed, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model, feature_set ORDER BY macro_f1 DESC, random_seed) AS r
  FROM detail WHERE macro_f1 IS NOT NULL) WHERE r = 1""",
    "experiment_grid": f"""WITH {DETAIL}, cells AS (SELECT DISTINCT model, feature_set FROM detail)
SELECT CAST(s AS INTEGER) AS random_seed, model, feature_set, CAST(s AS INTEGER) AS split_seed, CAST(42 * s AS INTEGER) AS model_seed
FROM cells, range(1, 6) t(s)""",
    "feature_power_set": _coverage_sql(),
    "prompt_length_stats": f"""WITH {PAIRS}, pv AS (SELECT {PROMPT_COLS} FROM prompts),
long AS ({' UNION ALL '.join(f"SELECT '{s}' AS style, length(\"{s}\") AS chars, len(string_split_regex(trim(\"{s}\"), '\\s+')) AS words FROM pv" for s in STYLES)})
SELECT style, CAST(min(chars) AS BIGINT) AS min_chars, round(avg(chars), 6) AS avg_chars, CAST(max(chars) AS BIGINT) AS max_chars,
       CAST(min(words) AS BIGINT) AS min_words, round(avg(words), 6) AS avg_words, CAST(max(words) AS BIGINT) AS max_words
FROM long GROUP BY style""",
    "prompt_style_select": f"""WITH {PAIRS}, pv AS (SELECT uid, date, previous_state, label, {PROMPT_COLS} FROM prompts)
""" + " UNION ALL ".join(
        f"SELECT '{name}' AS style, uid AS \"user\", date, CAST(length(\"{col}\") AS BIGINT) AS data_len, md5(\"{col}\") AS data_md5, "
        f"previous_state, label FROM pv" for name, col in (("Basic", "Basic"), ("Health_Information", "Health_Informtion"),
                                                            ("Statistics", "Statistics"), ("All", "All"))),
    "csv_roundtrip": f"""WITH {PAIRS}
SELECT uid AS "user", phq9 AS "current PHQ", prev_phq9 AS "previous PHQ", previous_state AS "previous depression state",
       current_state AS "current depression state", label, {PROMPT_COLS} FROM prompts""",
    "sequence_json_unnest": f"""WITH {SEQ14}, {SURVEY}
SELECT s.uid AS "user", sv.bg_sex AS gender, sv.grp AS "group", sv.bg_age AS age, s.date, s.phq9,
       {', '.join(f's.s_{n}' for n in FEATS)}
FROM seq s LEFT JOIN sv ON sv.uid = s.uid""",
    "pending_runs_both": f"""WITH {EV},
grid AS (SELECT uid, CAST(day AS DATE) AS date FROM (SELECT DISTINCT uid FROM ev),
  (SELECT unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM ev)),
m AS (SELECT uid, d AS date, CASE WHEN k % 2 = 0 THEN 'json' ELSE 'csv' END AS kind FROM ev)
SELECT uid AS "user", date FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.uid = g.uid AND m.date = g.date AND m.kind = 'json')
   OR NOT EXISTS (SELECT 1 FROM m WHERE m.uid = g.uid AND m.date = g.date AND m.kind = 'csv')""",
    "pending_runs_latest_valid": f"""WITH {EV},
grid AS (SELECT uid, CAST(day AS DATE) AS date FROM (SELECT DISTINCT uid FROM ev),
  (SELECT unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM ev)),
m AS (SELECT user_id AS uid, CAST(ts AS DATE) AS date, ts,
             CASE WHEN event_type <> 'error' THEN value END AS acc, CASE WHEN event_type <> 'signup' THEN value END AS f1 FROM events),
latest AS (SELECT uid, date, arg_max(acc IS NOT NULL AND f1 IS NOT NULL, ts) AS ok FROM m GROUP BY uid, date)
SELECT uid AS "user", date FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.uid = g.uid AND l.date = g.date AND l.ok)""",
})


# Round trips and the scoring hook: the sink must return the shot-count metrics unchanged;
# the fallback predictor answers "Label: Remains" after every prompt.
ORACLE["results_sink"] = ORACLE["shots_curve"]
ORACLE["score_prompts"] = f"""WITH {CT}, {split_cte()}
SELECT doc_id, label, 'Remains' AS predicted, true AS parsed FROM split WHERE side = 'test'"""


# ---------------------------------------------------------------- in-context chain on the prompt table
def incontext_ctes(n: int, seeds: int) -> str:
    """The keyed chain restated: per seed users are split and the train side oversampled; per seed, style
    and previous state every test row takes systematic positions outside its own text."""
    style = (("Basic", "Basic"), ("Health_Information", "Health_Informtion"), ("Statistics", "Statistics"), ("All", "All"))
    texts = " UNION ALL ".join(f"""SELECT '{name}' AS style, pair, uid, st, label, "{col}" AS data FROM pv""" for name, col in style)
    return f"""{PAIRS},
pv AS (SELECT uid, CAST(uid AS VARCHAR) || ':' || strftime(date, '%Y-%m-%d') AS pair, previous_state AS st, label, {PROMPT_COLS} FROM prompts),
lt AS ({texts}),
sd AS (SELECT CAST(s AS INTEGER) AS seed FROM range(1, {seeds + 1}) t(s)),
us AS (SELECT seed, uid, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || uid), uid) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS g
       FROM sd, (SELECT DISTINCT uid FROM pv)),
sp AS (SELECT us.seed, lt.*, CASE WHEN us.pos < ceil(CAST(us.g AS DOUBLE) * 0.4) THEN 'test' ELSE 'train' END AS side FROM lt JOIN us USING (uid)),
tr AS (SELECT DISTINCT seed, pair, label FROM sp WHERE side = 'train'),
oc AS (SELECT *, avg(c) OVER (PARTITION BY seed) AS mean FROM (SELECT seed, label, count(*) AS c FROM tr GROUP BY seed, label)),
od AS (SELECT seed, label, c, unnest(range(0, CAST(floor(mean) AS BIGINT))) AS j FROM oc WHERE c < mean),
oi AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || ':' || pair), pair) - 1 AS pos FROM tr),
dr AS (SELECT seed, pair FROM tr UNION ALL SELECT i.seed, i.pair FROM od d JOIN oi i ON i.seed = d.seed AND i.label = d.label
       AND i.pos = {h60("d.seed || ':' || d.label || ':' || d.j")} % d.c),
pool AS (SELECT sp.*, md5(seed || ':' || data) AS th, row_number() OVER (PARTITION BY seed, style, st
           ORDER BY md5(seed || ':' || data), md5(seed || ':' || pair), pair) - 1 AS pos FROM dr JOIN sp USING (seed, pair)),
sizes AS (SELECT seed, style, st, count(*) AS cnt FROM pool GROUP BY ALL),
blocks AS (SELECT seed, style, st, th, count(*) AS b, max(pos) AS e FROM pool GROUP BY ALL),
qq AS (SELECT q.seed, q.style, q.pair, q.st, s.cnt, coalesce(bl.b, 0) AS b, coalesce(bl.e, -1) AS e FROM sp q JOIN sizes s USING (seed, style, st)
       LEFT JOIN blocks bl ON bl.seed = q.seed AND bl.style = q.style AND bl.st = q.st AND bl.th = md5(q.seed || ':' || q.data) WHERE q.side = 'test'),
qm AS (SELECT *, cnt - b AS m, least({n}, cnt - b) AS nf, {h60("seed || ':q:' || pair")} % (cnt - b) AS o FROM qq WHERE cnt - b > 0),
picks AS (SELECT *, (e + 1 + (o + j * m) // nf) % cnt AS pos FROM (SELECT *, unnest(range(0, nf)) AS j FROM qm)),
pairs_x AS (SELECT p.seed, p.style, p.pair, p.j, x.pair AS example_id, x.label AS ex_label, x.data AS ex_data
            FROM picks p JOIN pool x ON x.seed = p.seed AND x.style = p.style AND x.st = p.st AND x.pos = p.pos)"""


ORACLE["incontext_curve"] = f"""WITH {incontext_ctes(25, 5)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, style, pair ORDER BY md5(seed || ':rank:' || pair || ':' || example_id), example_id) - 1 AS rnk FROM pairs_x),
shots AS (SELECT * FROM (VALUES (0), (1), (3), (5), (10), (15), (25)) t(n_shots)),
v AS (SELECT seed, style, n_shots, pair, ex_label, count(*) AS votes FROM ranked, shots WHERE rnk < n_shots GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY seed, style, n_shots, pair ORDER BY votes DESC, {LABEL_CODE.format(x='ex_label')}) = 1),
pr AS (SELECT s.seed, s.style, sh.n_shots, s.label, coalesce(b.ex_label, 'Remains') AS predicted FROM sp s CROSS JOIN shots sh
       LEFT JOIN b ON b.seed = s.seed AND b.style = s.style AND b.pair = s.pair AND b.n_shots = sh.n_shots WHERE s.side = 'test'),
{metric_ctes('pr', ['seed', 'style', 'n_shots'], 'label', 'predicted')},
ms AS ({metric_select(['seed', 'style', 'n_shots'])})
SELECT seed, style, n_shots, accuracy, macro_f1, n FROM ms"""
_EX = f"'<start_of_turn>user{NL}' || ex_data || '<end_of_turn>{NL}<start_of_turn>model{NL}Label: ' || ex_label || '{NL}<end_of_turn>{NL}'"
ORACLE["incontext_chats"] = f"""WITH {incontext_ctes(3, 1)},
agg AS (SELECT style, pair, count(*) AS n_ex, string_agg({_EX}, '' ORDER BY j) AS ex_text FROM pairs_x GROUP BY style, pair),
txt AS (SELECT style, pair, coalesce(n_ex, 0) AS n_ex, {q(HEAD)} || coalesce(ex_text, '') || '<start_of_turn>user{NL}' || data
          || '<end_of_turn>{NL}<start_of_turn>model{NL}' AS t FROM sp LEFT JOIN agg USING (style, pair) WHERE side = 'test')
SELECT style, pair, CAST(n_ex AS INTEGER) AS n_examples, CAST(length(t) AS BIGINT) AS chat_len, md5(t) AS chat_md5 FROM txt"""


# Every run key (language, fold 0-4) with what a restart finds of it: folds 0 to 3 were published whole,
# fold 1 a second time without the macro F1, fold 2 a second time without being published.
ORACLE["run_restart"] = f"""WITH {CT},
fq AS (SELECT lang, CAST(doc_id % 5 AS INTEGER) AS fold, CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS yh FROM ct),
{metric_ctes('fq', ['lang', 'fold'], 'y', 'yh')},
m AS ({metric_select(['lang', 'fold'])})
SELECT lang, fold, fold < 4 AS done_both, fold IN (0, 2, 3) AS done_valid,
  CASE WHEN fold < 4 THEN accuracy END AS accuracy, CASE WHEN fold IN (0, 2, 3) THEN macro_f1 END AS macro_f1,
  CASE WHEN fold < 4 THEN n ELSE 0 END AS n_scored, CASE WHEN fold < 4 THEN CAST(round(accuracy * n) AS BIGINT) END AS n_right FROM m"""
ORACLE["score_resumed"] = f"""WITH {CT}
SELECT doc_id, label, CASE WHEN doc_id % 2 = 0 THEN 'Remains' ELSE 'More Depressed' END AS predicted, true AS parsed FROM ct"""


# ---------------------------------------------------------------- inputs of the tree study
def _study_inputs() -> str:
    order = ["battery_afternoon", "screen_off_night_duration", "magnitude_max", "screen_use_duration_afternoon"]
    sets = ", ".join("('" + "_".join(f for i, f in enumerate(order) if not m >> (3 - i) & 1) + f"', {[1 - (m >> (3 - i) & 1) for i in range(4)]})"
                     for m in range(15))
    z = ", ".join(f"sum((coalesce(CAST(v.{f} AS DOUBLE), 0.0) - t.mu_{f}) / CASE WHEN t.sd_{f} = 0 THEN 1.0 ELSE t.sd_{f} END) AS z_{f}" for f in FEATS)
    stats = ", ".join(f"avg(coalesce(CAST(v.{f} AS DOUBLE), 0.0)) AS mu_{f}, stddev_pop(coalesce(CAST(v.{f} AS DOUBLE), 0.0)) AS sd_{f}" for f in FEATS)
    return f"""WITH {FORECAST},
seeds AS (SELECT CAST(seed AS INTEGER) AS seed FROM range(1, 6) r(seed)),
pr AS (SELECT DISTINCT uid, date, idx, label, CAST(uid AS VARCHAR) || ':' || strftime(date, '%Y-%m-%d') AS pair FROM fc),
s1 AS (SELECT seed, uid, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || uid), uid) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS g
       FROM seeds, (SELECT DISTINCT uid FROM pr)),
s2 AS (SELECT seed, uid, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':stage2:' || uid), uid) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS g
       FROM s1 WHERE pos >= ceil(CAST(g AS DOUBLE) * 0.4)),
rw AS (SELECT s2.seed, pr.*, CASE WHEN s2.pos < ceil(CAST(s2.g AS DOUBLE) * 0.5) THEN 'eval' ELSE 'train' END AS side FROM pr JOIN s2 USING (uid)),
cnt AS (SELECT seed, label, count(*) AS c FROM rw WHERE side = 'train' GROUP BY seed, label),
need AS (SELECT seed, label, c, CAST(floor(m) AS BIGINT) AS n FROM (SELECT *, avg(c) OVER (PARTITION BY seed) AS m FROM cnt) WHERE c < m),
draws AS (SELECT seed, label, c, unnest(range(0, n)) AS j FROM need),
ix AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || ':' || pair), pair) - 1 AS pos FROM rw WHERE side = 'train'),
tr AS (SELECT seed, pair, uid, date, idx, label, 0 AS draw FROM ix
       UNION ALL SELECT ix.seed, ix.pair, ix.uid, ix.date, ix.idx, ix.label, d.j + 1 FROM draws d JOIN ix ON ix.seed = d.seed AND ix.label = d.label
         AND ix.pos = {h60("d.seed || ':' || d.label || ':' || CAST(d.j AS VARCHAR)")} % d.c),
fl AS (SELECT *, (row_number() OVER (PARTITION BY seed, label ORDER BY md5((42 * seed) || ':' || rw), rw) - 1) % 3 AS fold
       FROM (SELECT *, CASE WHEN draw = 0 THEN pair ELSE pair || '#' || draw END AS rw FROM tr)),
al AS (SELECT seed, pair, uid, date, idx, label, draw, 'train' AS side, CAST(fold AS INTEGER) AS fold FROM fl
       UNION ALL SELECT seed, pair, uid, date, idx, label, 0, 'eval', -1 FROM rw WHERE side = 'eval'),
dict AS (SELECT seed, label, CAST(row_number() OVER (PARTITION BY seed ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT seed, label FROM al)),
st AS (SELECT al.seed, v.slot, {stats} FROM al JOIN fv v ON v.uid = al.uid AND v.date = al.date AND v.idx = al.idx WHERE al.side = 'train' GROUP BY al.seed, v.slot),
zs AS (SELECT al.seed, al.pair, al.draw, al.side, al.fold, al.label, {z}
       FROM al JOIN fv v ON v.uid = al.uid AND v.date = al.date AND v.idx = al.idx JOIN st t ON t.seed = al.seed AND t.slot = v.slot
       GROUP BY al.seed, al.pair, al.draw, al.side, al.fold, al.label)
SELECT zs.seed AS random_seed, fs.name AS feature_set, zs.pair, zs.draw, zs.side, zs.fold, dict.code,
       round({" + ".join(f"fs.f[{i + 1}] * z_{f}" for i, f in enumerate(order))}, 6) AS z_sum
FROM zs JOIN dict ON dict.seed = zs.seed AND dict.label = zs.label, (VALUES {sets}) fs(name, f)"""


ORACLE["study_inputs"] = _study_inputs()
# the same records, whichever way the inputs came in
ORACLE["load_inputs_roundtrip"] = ORACLE["feature_projection"]
