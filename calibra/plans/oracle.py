"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Generated from the same fixed parameters as the Spark jobs (label lists,
criteria words, grids), but written independently as plain SQL over the
driver's parquet views. List computations are staged in CTEs, mirroring the
arithmetic order of the Spark expressions so doubles agree before the final
6-dp rounding.
"""
from __future__ import annotations

from calibra.operators.labels import DEPARTMENT_NAMES
from calibra.plans import catalog as cat
from calibra.plans import fixtures as fx

FLOOR = "1e-9"
CEIL = "(-ln(1e-9))"


def _lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _d(x) -> str:
    return f"{float(x)!r}::DOUBLE"


EV_LABELS = _lst(fx.EVENT_LABELS)

# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------
E_CTE = f"""
e0 AS (
  SELECT event_id, ts, event_type,
         CASE WHEN event_id % 4 <> 0 THEN list_position({EV_LABELS}, event_type) - 1
              ELSE (event_id // 4) % 5 END AS bk
  FROM events),
e1 AS (
  SELECT event_id, ts, event_type,
         list_transform(range(5), lambda k: 1 + (event_id * (7 * k + 3)) % 7
             + CASE WHEN bk = k THEN (event_id * 13) % 120 ELSE 0 END) AS w
  FROM e0),
E AS (
  SELECT event_id, ts, event_type AS truth, {EV_LABELS} AS labels,
         list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS probs
  FROM e1)"""

O_CTE = """
o0 AS (
  SELECT o_orderkey,
         CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1
              WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 0 END AS truth
  FROM orders),
o1 AS (
  SELECT o_orderkey, truth,
         list_transform(range(3), lambda i: 1 + (o_orderkey * [3, 5, 7][i + 1]) % 11
             + CASE WHEN truth = i AND o_orderkey % 3 <> 0 THEN 14 ELSE 0 END) AS w
  FROM o0),
O AS (
  SELECT o_orderkey, truth, ['0', '1', '2'] AS labels,
         list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS probs
  FROM o1)"""


def scaled_ctes(src: str, out: str, probs: str, t: str, keep: str = "*") -> str:
    """CTEs ``{out}_l``, ``{out}_e`` and ``{out}`` adding column ``{out}p`` =
    softmax(ln(max(p,1e-9))/t) of ``{probs}``, staged like the Spark side."""
    return f"""
{out}_l AS (SELECT {keep}, list_transform({probs}, lambda x: ln(greatest(x, {FLOOR})) / {t}) AS {out}_lg FROM {src}),
{out}_e AS (SELECT *, list_transform({out}_lg, lambda x: exp(x - list_max({out}_lg))) AS {out}_ex FROM {out}_l),
{out} AS (SELECT *, list_transform({out}_ex, lambda x: x / list_sum({out}_ex)) AS {out}p FROM {out}_e)"""


def softmax_ctes(src: str, out: str, logits: str) -> str:
    """Column ``{out}p`` = softmax of an existing list column ``logits``."""
    return f"""
{out}_e AS (SELECT *, list_transform({logits}, lambda x: exp(x - list_max({logits}))) AS {out}_ex FROM {src}),
{out} AS (SELECT *, list_transform({out}_ex, lambda x: x / list_sum({out}_ex)) AS {out}p FROM {out}_e)"""


def argmax(labels: str, p: str) -> str:
    return f"{labels}[list_position({p}, list_max({p}))]"


def expected_value(labels: str, p: str) -> str:
    return f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: TRY_CAST({labels}[i] AS INTEGER) * {p}[i]))"


def ordinal_class(ev: str, n: str) -> str:
    return f"greatest(0, least(({n}) - 1, round_even({ev}, 0)::INTEGER))"


def gate(conf: str, th: float = 0.85) -> str:
    return f"CASE WHEN {conf} >= {_d(th)} THEN 'auto_route' ELSE 'escalate_to_human' END"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


# E calibrated at T = 1 (uncalibrated): label, confidence, gate.
EC_CTE = f"""
EC AS (
  SELECT event_id, ts, truth AS true_department, labels, probs,
         {argmax('labels', 'probs')} AS cal_department,
         list_max(probs) AS cal_department_confidence,
         {gate('list_max(probs)')} AS gate_decision
  FROM E)"""

# ---------------------------------------------------------------------------
# NLL / temperature fit
# ---------------------------------------------------------------------------
COARSE = ", ".join(f"({t!r}::DOUBLE)" for t in [round(0.25 + 0.25 * i, 2) for i in range(80)])


def nll_term(t: str) -> str:
    return (f"coalesce(CASE WHEN {t} = 1.0 THEN -ln(greatest(coalesce(p_true, {FLOOR}), {FLOOR})) "
            f"ELSE least({CEIL}, lmax / {t} + ln(list_sum(list_transform(lp, lambda x: exp((x - lmax) / {t})))) "
            f"- lp_true / {t}) END, {CEIL})")


def fit_ctes(src: str, labels: str, probs: str, truth: str, name: str) -> str:
    """CTEs ending in ``{name}`` with one row: question, n, t_coarse,
    temperature, nll_best, nll_t1, hit_ceiling."""
    return f"""
{name}_i0 AS (SELECT list_transform({probs}, lambda x: ln(greatest(x, {FLOOR}))) AS lp,
                     list_position({labels}, CAST({truth} AS VARCHAR)) AS pos, {probs} AS pr FROM {src}),
{name}_i AS (SELECT lp, list_max(lp) AS lmax, lp[pos] AS lp_true, pr[pos] AS p_true FROM {name}_i0),
{name}_g AS (SELECT * FROM (VALUES {COARSE}) g(t)),
{name}_c AS (SELECT g.t, avg({nll_term('g.t')}) AS nll, count(*) AS n
             FROM {name}_i CROSS JOIN {name}_g g GROUP BY g.t),
{name}_w AS (SELECT t AS t0, nll AS nll0 FROM {name}_c ORDER BY round(nll, 12), t LIMIT 1),
{name}_fg AS (SELECT round(t0 - 0.25::DOUBLE + 0.02::DOUBLE * i, 3) AS t FROM {name}_w, range(25) r(i)),
{name}_f AS (SELECT g.t, avg({nll_term('g.t')}) AS nll
             FROM {name}_i CROSS JOIN (SELECT t FROM {name}_fg WHERE t > 0) g GROUP BY g.t),
{name}_b AS (SELECT t, nll FROM (SELECT t0 AS t, nll0 AS nll, 0 AS stage FROM {name}_w
                                 UNION ALL SELECT t, nll, 1 AS stage FROM {name}_f)
             ORDER BY round(nll, 12), stage, t LIMIT 1),
{name} AS (
  SELECT '{name}' AS question,
         (SELECT coalesce(max(n), 0) FROM {name}_c)::BIGINT AS n,
         (SELECT t0 FROM {name}_w) AS t_coarse,
         coalesce((SELECT t FROM {name}_b), 1.0::DOUBLE) AS temperature,
         (SELECT nll FROM {name}_b) AS nll_best,
         (SELECT max(nll) FILTER (WHERE t = 1.0) FROM {name}_c) AS nll_t1,
         coalesce((SELECT t FROM {name}_b), 1.0::DOUBLE) >= 19.75::DOUBLE AS hit_ceiling)"""


def fit_select(name: str) -> str:
    return (f"SELECT question, n, t_coarse, temperature, {r6('nll_best')} AS nll_best, "
            f"{r6('nll_t1')} AS nll_t1, hit_ceiling FROM {name}")


# ---------------------------------------------------------------------------
# Tickets (fixture T): raw -> prepared -> split -> lexical scores -> records
# ---------------------------------------------------------------------------
QUEUE_NAMES = _lst(fx.QUEUE_NAMES)
DEPTS = _lst(DEPARTMENT_NAMES)

T_PREP_CTE = f"""
traw AS (
  SELECT d.doc_id AS ticket_id,
         split_part(d.text, chr(10), 1) AS subject,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) END AS body,
         {QUEUE_NAMES}[e.label + 1] AS queue,
         ['low', 'medium', 'high'][TRY_CAST(regexp_extract(d.source, '(\\d+)', 1) AS INTEGER) % 3 + 1] AS priority,
         d.lang AS language
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
tclean AS (
  SELECT ticket_id, trim(concat_ws(chr(10), subject, body)) AS text, queue, priority
  FROM traw WHERE language = 'en'),
TP AS (
  SELECT ticket_id, text, queue AS department,
         (CASE lower(priority) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END)::INTEGER AS urgency_score
  FROM tclean
  WHERE text IS NOT NULL AND length(trim(text)) > 0 AND list_contains({DEPTS}, queue)
    AND (CASE lower(priority) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END) IS NOT NULL)"""


def split_ctes(src: str, id_col: str, stratum: str, out: str, sizes=None, seed: int = 42) -> str:
    sizes = dict(sizes or {"cal": 500, "dev": 500, "test": 1000})
    total = sum(sizes.values())
    cases, cum = [], 0
    for name, size in sizes.items():
        cum += size
        cases.append(f"WHEN rk <= round((ns * {cum})::DOUBLE / greatest(n, {total})::DOUBLE, 0) THEN '{name}'")
    return f"""
{out}_h AS (SELECT *, md5('{seed}|' || CAST({id_col} AS VARCHAR)) AS h FROM {src}),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY h, {id_col}) AS rk,
                   count(*) OVER (PARTITION BY {stratum}) AS ns,
                   count(*) OVER () AS n FROM {out}_h),
{out} AS (SELECT * EXCLUDE (h, rk, ns, n), CASE {' '.join(cases)} ELSE 'unused' END AS split FROM {out}_r)"""


def rate(words) -> str:
    return (f"len(list_filter(tok, lambda x: list_contains({_lst(words)}, x)))::DOUBLE * 100.0::DOUBLE "
            f"/ greatest(ntok, 1)::DOUBLE")


def lexical_ctes(src: str, out: str, spec, text: str = "text") -> str:
    """Scores every question of ``spec`` into columns ``{q}_p`` (probs),
    ``{q}_ev`` (score questions) or ``{q}_n`` (noul)."""
    parts = [f"""
{out}_t0 AS (SELECT *, regexp_extract_all(lower(nfc_normalize(coalesce({text}, ''))), '[\\p{{L}}\\p{{M}}]+') AS tok FROM {src}),
{out}_t AS (SELECT *, len(tok) AS ntok FROM {out}_t0)"""]
    prev = f"{out}_t"
    for q in spec.questions:
        nm = q.name
        if q.type == "noul":
            parts.append(f"""
{out}_{nm} AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_d(q.bias)} + {_d(q.weight)} * ({rate(q.cues)})))) AS {nm}_n
               FROM {prev})""")
            prev = f"{out}_{nm}"
            continue
        rates = "[" + ", ".join(f"({rate(o.criteria())}) * 1.0::DOUBLE" for o in q.options) + "]"
        parts.append(f"""
{out}_{nm}_r AS (SELECT *, {rates} AS {nm}_r FROM {prev})""")
        parts.append(softmax_ctes(f"{out}_{nm}_r", f"{out}_{nm}_s", f"{nm}_r"))
        parts.append(f"""
{out}_{nm} AS (SELECT * EXCLUDE ({out}_{nm}_s_ex), {out}_{nm}_sp AS {nm}_p FROM {out}_{nm}_s)""")
        prev = f"{out}_{nm}"
        if q.type == "score":
            lab = _lst(q.labels)
            parts.append(f"""
{out}_{nm}_v AS (SELECT *, {expected_value(lab, f'{nm}_p')} AS {nm}_ev FROM {prev})""")
            prev = f"{out}_{nm}_v"
    parts.append(f"""
{out} AS (SELECT * FROM {prev})""")
    return ",".join(p.strip("\n") for p in parts)


SPEC = cat.ticket_spec()
DEPT_LABELS = _lst(SPEC["department"].labels)
URG_LABELS = _lst(SPEC["urgency"].labels)

TICKETS_CTES = [
    T_PREP_CTE,
    split_ctes("TP", "ticket_id", "department", "TS"),
    lexical_ctes("TS", "TL", SPEC),
    f"""
TR AS (
  SELECT ticket_id, split, text, department AS true_department, urgency_score AS true_urgency,
         {DEPT_LABELS} AS department_labels, department_p AS department_probs,
         {URG_LABELS} AS urgency_labels, urgency_p AS urgency_probs, urgency_ev AS urgency_score_raw,
         churn_risk_n AS churn_risk, refund_requested_n AS refund_requested
  FROM TL)""",
    "\nTCAL AS (SELECT * FROM TR WHERE split = 'cal')",
    fit_ctes("TCAL", "department_labels", "department_probs", "true_department", "department"),
    fit_ctes("TCAL", "urgency_labels", "urgency_probs", "true_urgency", "urgency"),
    f"""
TT AS (
  SELECT TR.*, (SELECT temperature FROM department) AS t_dep, (SELECT temperature FROM urgency) AS t_urg
  FROM TR WHERE split <> 'cal')""",
    scaled_ctes("TT", "TD", "department_probs", "t_dep"),
    scaled_ctes("TD", "TU", "urgency_probs", "t_urg"),
    f"""
TPRED0 AS (
  SELECT *,
         CASE WHEN t_dep = 1.0 THEN department_probs ELSE TDp END AS dscaled,
         CASE WHEN t_urg = 1.0 THEN urgency_probs ELSE TUp END AS uscaled,
         {ordinal_class('urgency_score_raw', 'len(urgency_labels)')} AS cal_urgency
  FROM TU),
TPRED AS (
  SELECT ticket_id, text, true_department, true_urgency, churn_risk, refund_requested,
         {argmax('department_labels', 'dscaled')} AS cal_department,
         list_max(dscaled) AS cal_department_confidence,
         cal_urgency,
         coalesce(uscaled[list_position(urgency_labels, CAST(cal_urgency AS VARCHAR))], 0.0::DOUBLE) AS cal_urgency_confidence,
         {gate('list_max(dscaled)')} AS gate_decision
  FROM TPRED0)""",
]
TICKETS = with_ctes(*TICKETS_CTES)

# Batch triage of user messages (T = 1: the raw distributions).
BATCH_CTES = [
    """
UM AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')""",
    lexical_ctes("UM", "UL", SPEC),
    f"""
BT AS (
  SELECT conv_id, turn, text,
         {argmax(DEPT_LABELS, 'department_p')} AS department,
         list_max(department_p) AS department_confidence,
         {ordinal_class('urgency_ev', '3')} AS urgency_class,
         churn_risk_n AS churn_risk, refund_requested_n AS refund_requested,
         {gate('list_max(department_p)')} AS gate_decision
  FROM UL),
BT2 AS (
  SELECT *, coalesce(urgency_p[urgency_class + 1], 0.0::DOUBLE) AS urgency_confidence,
         ['low', 'medium', 'high'][urgency_class + 1] AS urgency_label
  FROM BT JOIN (SELECT conv_id AS c2, turn AS t2, urgency_p FROM UL) x ON x.c2 = BT.conv_id AND x.t2 = BT.turn)""",
]

LOG_CTES = [
    f"""
LOGB AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, '{cat.BATCH_CREATED_AT}' AS created_at, 'batch' AS source,
         text, department AS pred_department, department_confidence, urgency_class AS pred_urgency,
         gate_decision, NULL::VARCHAR AS true_department, NULL::INTEGER AS true_urgency,
         NULL::INTEGER AS department_correct, NULL::INTEGER AS urgency_correct
  FROM BT2),
LOGE AS (
  SELECT (SELECT count(*) FROM LOGB) + row_number() OVER (ORDER BY ticket_id) AS id,
         '{cat.LOG_CREATED_AT}' AS created_at, 'eval' AS source, text,
         cal_department AS pred_department, cal_department_confidence AS department_confidence,
         cal_urgency AS pred_urgency, gate_decision, true_department, true_urgency,
         CASE WHEN true_department IS NOT NULL THEN (cal_department IS NOT DISTINCT FROM true_department)::INTEGER END
             AS department_correct,
         (cal_urgency = true_urgency)::INTEGER AS urgency_correct
  FROM TPRED),
LOG AS (SELECT * FROM LOGB UNION ALL SELECT * FROM LOGE)""",
]
TICKETS_LOG = with_ctes(*TICKETS_CTES, *BATCH_CTES, *LOG_CTES)
BATCH = with_ctes(*BATCH_CTES)


def _dense_confusion(src: str, labels: list, truth: str, pred: str, tname: str, pname: str, typ: str) -> str:
    if typ == "VARCHAR":
        vals = _lst(labels)
    else:
        vals = "[" + ", ".join(str(v) for v in labels) + "]"
    k = len(labels)
    return f"""
G AS (
  SELECT (a.i - 1)::INTEGER AS true_index, {vals}[a.i]::{typ} AS {tname},
         (b.i - 1)::INTEGER AS pred_index, {vals}[b.i]::{typ} AS {pname}
  FROM range(1, {k + 1}) a(i), range(1, {k + 1}) b(i)),
C AS (SELECT CAST({truth} AS {typ}) AS ct, CAST({pred} AS {typ}) AS cp, count(*) AS n FROM {src} GROUP BY ALL),
CONF AS (
  SELECT G.true_index, G.{tname}, G.pred_index, G.{pname}, coalesce(C.n, 0)::BIGINT AS n
  FROM G LEFT JOIN C ON C.ct = G.{tname} AND C.cp = G.{pname})"""


EVENTS_CONF = with_ctes(E_CTE, EC_CTE, _dense_confusion("EC", fx.EVENT_LABELS, "true_department", "cal_department",
                                                        "true_label", "pred_label", "VARCHAR"))

O_CLASS = f"""
OC AS (
  SELECT o_orderkey, truth AS true_urgency, labels, probs, {expected_value('labels', 'probs')} AS ev FROM O),
{scaled_ctes('OC', 'OS', 'probs', _d(cat.O_TEMPERATURE)).strip(chr(10))},
OK2 AS (
  SELECT *, {ordinal_class('ev', 'len(labels)')} AS cal_urgency FROM OS),
OK3 AS (
  SELECT *, coalesce(OSp[list_position(labels, CAST(cal_urgency AS VARCHAR))], 0.0::DOUBLE) AS cal_urgency_confidence
  FROM OK2)"""

S_EVENTS = split_ctes("E", "event_id", "truth", "ES")


def _pct_ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0)::DOUBLE, 0.0::DOUBLE)"


ORACLE_SQL: dict[str, str] = {
    "gating_metrics": with_ctes(E_CTE, EC_CTE, """
S AS (
  SELECT count(*) AS total,
         count(*) FILTER (WHERE cal_department_confidence >= 0.85::DOUBLE) AS auto_n,
         count(*) FILTER (WHERE cal_department_confidence >= 0.85::DOUBLE
                          AND true_department IS NOT DISTINCT FROM cal_department) AS auto_ok,
         count(*) FILTER (WHERE NOT coalesce(cal_department_confidence >= 0.85::DOUBLE, false)
                          AND true_department IS NOT DISTINCT FROM cal_department) AS esc_ok
  FROM EC)""") + f"""
SELECT 0.85::DOUBLE AS threshold, auto_n AS auto_route_count,
       {r6(_pct_ratio('auto_n', 'total'))} AS auto_route_rate,
       {r6(_pct_ratio('auto_ok', 'auto_n'))} AS auto_route_accuracy,
       total - auto_n AS escalate_count,
       {r6(_pct_ratio('total - auto_n', 'total'))} AS escalate_rate,
       {r6(_pct_ratio('esc_ok', 'total - auto_n'))} AS escalate_accuracy,
       {r6(_pct_ratio('auto_ok + esc_ok', 'total'))} AS overall_accuracy
FROM S""",

    "gate_decisions": with_ctes(E_CTE, EC_CTE) + f"""
SELECT event_id, cal_department AS label, {r6('cal_department_confidence')} AS confidence, gate_decision FROM EC""",

    "apply_temperature_long": with_ctes(E_CTE, scaled_ctes("E", "ET", "probs", _d(cat.E_TEMPERATURE)).strip("\n")) + """
SELECT event_id, label_index::INTEGER AS label_index, label, round(p, 6) AS p FROM (
  SELECT event_id, unnest(range(1, len(ETp) + 1)) AS label_index, unnest(labels) AS label, unnest(ETp) AS p FROM ET)""",

    "top_option": with_ctes(E_CTE, scaled_ctes("E", "ES2", "probs", _d(cat.E_SHARPEN)).strip("\n")) + f"""
SELECT event_id, {argmax('labels', 'probs')} AS top_label, {r6('list_max(probs)')} AS top_prob,
       {argmax('labels', 'ES2p')} AS cal_label, {r6('list_max(ES2p)')} AS cal_confidence
FROM ES2""",

    "option_ranking": with_ctes(E_CTE, """
U AS (SELECT event_id, unnest(range(1, len(probs) + 1)) AS pos, unnest(labels) AS label, unnest(probs) AS prob FROM E)""") + """
SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY prob DESC, pos))::INTEGER AS rank,
       label, round(prob, 6) AS prob
FROM U""",

    "expected_value_class": with_ctes(O_CTE, O_CLASS) + f"""
SELECT o_orderkey, {r6('ev')} AS urgency_score_raw, cal_urgency, {r6('cal_urgency_confidence')} AS cal_urgency_confidence
FROM OK3""",

    "nll_by_temperature": with_ctes(E_CTE, fit_ctes("E", "labels", "probs", "truth", "events")) + """
SELECT t, round(nll, 6) AS nll, n FROM events_c""",

    "fit_temperature": with_ctes(E_CTE, O_CTE, fit_ctes("E", "labels", "probs", "truth", "events"),
                                 fit_ctes("O", "labels", "probs", "truth", "orders"))
    + fit_select("events") + "\nUNION ALL\n" + fit_select("orders"),

    "mean_top_prob": with_ctes(E_CTE, O_CTE, scaled_ctes("E", "ET", "probs", _d(cat.E_TEMPERATURE)).strip("\n"),
                               scaled_ctes("O", "OT", "probs", _d(cat.O_TEMPERATURE)).strip("\n")) + """
SELECT 'events' AS question, round(avg(list_max(probs)), 6) AS mean_top_before, round(avg(list_max(ETp)), 6) AS mean_top_after FROM ET
UNION ALL
SELECT 'orders', round(avg(list_max(probs)), 6), round(avg(list_max(OTp)), 6) FROM OT""",

    "department_accuracy": with_ctes(E_CTE, EC_CTE) + """
SELECT round(coalesce(avg((true_department IS NOT DISTINCT FROM cal_department)::INTEGER::DOUBLE), 0.0), 6) AS accuracy FROM EC""",

    "department_confusion": EVENTS_CONF + "SELECT * FROM CONF",

    "per_class_recall": with_ctes(E_CTE, EC_CTE, f"""
D AS (SELECT (i - 1)::INTEGER AS ordinal, {EV_LABELS}[i] AS label FROM range(1, {len(fx.EVENT_LABELS) + 1}) r(i)),
P AS (SELECT true_department AS label, count(*) AS support,
             avg((true_department IS NOT DISTINCT FROM cal_department)::INTEGER::DOUBLE) AS recall
      FROM EC WHERE list_contains({EV_LABELS}, true_department) GROUP BY 1)""") + """
SELECT D.ordinal, D.label, coalesce(P.support, 0)::BIGINT AS support, round(coalesce(P.recall, 0.0), 6) AS recall
FROM D LEFT JOIN P ON P.label = D.label""",

    "urgency_metrics": with_ctes(O_CTE, O_CLASS) + """
SELECT count(*) AS n,
       round(coalesce(avg((true_urgency = cal_urgency)::INTEGER::DOUBLE), 0.0), 6) AS accuracy,
       round(coalesce(avg((abs(true_urgency - cal_urgency) <= 1)::INTEGER::DOUBLE), 0.0), 6) AS within_one_level
FROM OK3""",

    "urgency_confusion": with_ctes(O_CTE, O_CLASS, _dense_confusion("OK3", [0, 1, 2], "true_urgency", "cal_urgency",
                                                                     "true_urgency", "pred_urgency", "INTEGER"))
    + "SELECT * FROM CONF",

    "confusion_peak": EVENTS_CONF + """
SELECT *, (SELECT greatest(max(n), 1) FROM CONF)::BIGINT AS peak,
       n > (SELECT greatest(max(n), 1) FROM CONF) / 2.0::DOUBLE AS above_half
FROM CONF""",

    "threshold_sweep": with_ctes(E_CTE, EC_CTE) + """
SELECT round(r.i / 100, 6) AS threshold,
       count(EC.event_id)::BIGINT AS auto_route_count,
       round(coalesce(count(EC.event_id)::DOUBLE / nullif((SELECT count(*) FROM EC), 0)::DOUBLE * 100.0::DOUBLE, 0.0), 6)
           AS auto_route_rate,
       round(sum((EC.true_department IS NOT DISTINCT FROM EC.cal_department)::INTEGER)::DOUBLE
             / nullif(count(EC.event_id), 0)::DOUBLE * 100.0::DOUBLE, 6) AS auto_route_accuracy
FROM range(50, 100, 2) r(i) LEFT JOIN EC ON EC.cal_department_confidence >= r.i / 100
GROUP BY r.i""",

    "recall_table": with_ctes(E_CTE, EC_CTE) + f"""
SELECT true_department AS department, count(*) AS support,
       round(avg((cal_department = true_department)::INTEGER::DOUBLE) * 100.0::DOUBLE, 1) AS recall_pct
FROM EC WHERE list_contains({EV_LABELS}, true_department) GROUP BY 1""",

    "confident_correct": with_ctes(E_CTE, EC_CTE) + f"""
SELECT event_id, cal_department, {r6('cal_department_confidence')} AS conf FROM EC
WHERE cal_department = true_department AND cal_department_confidence >= 0.85::DOUBLE
ORDER BY cal_department_confidence DESC, event_id LIMIT {cat.CASES_N}""",

    "confident_disagreements": with_ctes(E_CTE, EC_CTE) + f"""
SELECT event_id, cal_department, true_department, {r6('cal_department_confidence')} AS conf FROM EC
WHERE cal_department IS DISTINCT FROM true_department AND cal_department_confidence >= 0.6::DOUBLE
ORDER BY cal_department_confidence DESC, event_id LIMIT {cat.CASES_N}""",

    "latency_arithmetic": """
WITH L AS (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1e6 AS s FROM events)
SELECT n AS tickets, round(s, 6) AS total_seconds, round(s / greatest(n, 1)::DOUBLE * 1000.0::DOUBLE, 6) AS ms_per_ticket,
       round(greatest(n, 1)::DOUBLE / s, 6) AS tickets_per_second
FROM L""",

    "stratified_split": with_ctes(E_CTE, S_EVENTS) + "SELECT event_id, truth, split FROM ES",

    "split_overlap": with_ctes(E_CTE, S_EVENTS) + """
SELECT a.s AS split_a, b.s AS split_b,
       (SELECT count(*) FROM (SELECT DISTINCT event_id FROM ES WHERE split = a.s) x
        WHERE x.event_id IN (SELECT event_id FROM ES WHERE split = b.s))::BIGINT AS overlap
FROM (VALUES ('cal', 1), ('dev', 2), ('test', 3)) a(s, k), (VALUES ('cal', 1), ('dev', 2), ('test', 3)) b(s, k)
WHERE a.k < b.k""",

    "head_rows": with_ctes(E_CTE) + f"SELECT event_id, truth FROM E ORDER BY event_id LIMIT {cat.HEAD_N}",

    "priority_mapping": """
WITH P AS (
  SELECT o_orderkey, o_orderpriority,
         CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1
              WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 0 END AS urgency_score
  FROM orders),
Q AS (SELECT *, CASE urgency_score WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS priority FROM P)
SELECT o_orderkey, o_orderpriority, urgency_score::INTEGER AS urgency_score, priority,
       (CASE lower(priority) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END)::INTEGER AS score_back
FROM Q""",

    "prepared_tickets": with_ctes(T_PREP_CTE) + "SELECT ticket_id, text, department, urgency_score FROM TP",

    "label_mapping": with_ctes(T_PREP_CTE) + f"""
SELECT (list_position({DEPTS}, department) - 1)::INTEGER AS ordinal, department, count(*) AS n FROM TP GROUP BY department""",

    "ticket_split": with_ctes(T_PREP_CTE, split_ctes("TP", "ticket_id", "department", "TS"))
    + "SELECT ticket_id, department, split FROM TS",

    "lexical_choice_scores": with_ctes(
        "\nDOC AS (SELECT doc_id, text FROM documents)",
        lexical_ctes("DOC", "QL", cat.spec_from_options("q", fx.QUERY_OPTIONS))) + f"""
SELECT doc_id, {argmax(_lst(fx.QUERY_OPTIONS), 'q_p')} AS choice, {r6('list_max(q_p)')} AS confidence,
       {', '.join(f"{r6(f'q_p[{i + 1}]')} AS p_{k}" for i, k in enumerate(fx.QUERY_OPTIONS))}
FROM QL""",

    "unicode_criteria": with_ctes("""
UT AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\\p{L}\\p{M}]+') AS tok FROM documents),
UN AS (SELECT doc_id, greatest(len(tok), 1)::DOUBLE AS n,
              len(list_filter(tok, lambda x: x IN ('für', 'é', 'ción')))::DOUBLE AS a, len(list_filter(tok, lambda x: x IN ('ss', 'ß', 'ä')))::DOUBLE AS b,
              len(list_filter(range(1, len(tok)), lambda i: (tok[i] = 'of' AND tok[i + 1] = 'the') OR (tok[i] = 'in' AND tok[i + 1] IN ('the', 'der'))))::DOUBLE AS c
       FROM UT),
UR AS (SELECT doc_id, [a * 100.0 / n, b * 100.0 / n, c * 100.0 / n] AS r FROM UN)""", softmax_ctes("UR", "US", "r")) + """
SELECT doc_id, ['marked', 'folded', 'sequence'][list_position(USp, list_max(USp))] AS choice, round(USp[1], 6) AS p_marked,
       round(USp[2], 6) AS p_folded, round(USp[3], 6) AS p_sequence FROM US""",

    "lexical_urgency_score": with_ctes("\nDOC AS (SELECT doc_id, text FROM documents)", lexical_ctes("DOC", "DL", SPEC)) + f"""
SELECT doc_id, {r6('urgency_ev')} AS score, {ordinal_class('urgency_ev', '3')} AS urgency_class,
       {r6(f"coalesce(urgency_p[{ordinal_class('urgency_ev', '3')} + 1], 0.0::DOUBLE)")} AS confidence
FROM DL""",

    "noul_scores": with_ctes("\nDOC AS (SELECT doc_id, text FROM documents)", lexical_ctes("DOC", "DL", SPEC)) + """
SELECT doc_id, round(churn_risk_n, 6) AS churn_risk, round(refund_requested_n, 6) AS refund_requested FROM DL""",
}

_FLAT = f"""
SELECT ticket_id, {argmax(DEPT_LABELS, 'department_p')} AS department,
       {r6('list_max(department_p)')} AS department_confidence,
       {r6('urgency_ev')} AS urgency_score, {ordinal_class('urgency_ev', '3')} AS urgency_class,
       {r6(f"coalesce(urgency_p[{ordinal_class('urgency_ev', '3')} + 1], 0.0::DOUBLE)")} AS urgency_confidence,
       {r6('churn_risk_n')} AS churn_risk, {r6('refund_requested_n')} AS refund_requested{{extra}}
FROM TL"""
_T_SCORED = with_ctes(T_PREP_CTE, split_ctes("TP", "ticket_id", "department", "TS"), lexical_ctes("TS", "TL", SPEC))

ORACLE_SQL["flat_answers"] = _T_SCORED + _FLAT.replace("{extra}", ", 'lexical' AS routed_model")
ORACLE_SQL["model_scored"] = _T_SCORED + _FLAT.replace("{extra}", "")


def _fmt(x: str) -> str:
    return f"printf('%.2f', coalesce({x}, 0.0::DOUBLE))"


ORACLE_SQL["answer_lines"] = _T_SCORED + f"""
SELECT ticket_id, 0 AS question_index, 'department' AS question,
       {argmax(DEPT_LABELS, 'department_p')} || '  (conf ' || {_fmt('list_max(department_p)')} || ')' AS answer FROM TL
UNION ALL
SELECT ticket_id, 1, 'urgency', 'score ' || {_fmt('urgency_ev')} || '  (conf '
       || {_fmt(f"coalesce(urgency_p[{ordinal_class('urgency_ev', '3')} + 1], 0.0::DOUBLE)")} || ')' FROM TL
UNION ALL
SELECT ticket_id, 2, 'churn_risk', {_fmt('churn_risk_n')} || ' probability' FROM TL
UNION ALL
SELECT ticket_id, 3, 'refund_requested', {_fmt('refund_requested_n')} || ' probability' FROM TL"""

ORACLE_SQL["ticket_temperatures"] = TICKETS + fit_select("department") + "\nUNION ALL\n" + fit_select("urgency")

ORACLE_SQL["ticket_predictions"] = TICKETS + """
SELECT ticket_id, true_department, cal_department, round(cal_department_confidence, 6) AS cal_department_confidence,
       true_urgency, cal_urgency, round(cal_urgency_confidence, 6) AS cal_urgency_confidence, gate_decision
FROM TPRED"""

ORACLE_SQL["evaluation_rollup"] = TICKETS + f"""
, R AS (
  SELECT count(*) AS total,
         sum(coalesce(cal_department = true_department, false)::INTEGER) AS ok,
         sum((cal_urgency = true_urgency)::INTEGER) AS urg_ok,
         count(*) FILTER (WHERE gate_decision = 'auto_route') AS auto_n,
         sum(coalesce(cal_department = true_department, false)::INTEGER) FILTER (WHERE gate_decision = 'auto_route') AS auto_ok,
         count(*) FILTER (WHERE gate_decision = 'escalate_to_human') AS esc_n,
         sum(coalesce(cal_department = true_department, false)::INTEGER) FILTER (WHERE gate_decision = 'escalate_to_human') AS esc_ok
  FROM TPRED)
SELECT total, {r6(_pct_ratio('ok', 'total'))} AS department_accuracy, {r6(_pct_ratio('urg_ok', 'total'))} AS urgency_accuracy,
       auto_n AS auto_route_count, {r6(_pct_ratio('auto_n', 'total'))} AS auto_route_rate,
       {r6(_pct_ratio('auto_ok', 'auto_n'))} AS auto_route_accuracy, esc_n AS escalate_count,
       {r6(_pct_ratio('esc_ok', 'esc_n'))} AS escalate_accuracy,
       {r6(f"({_pct_ratio('auto_ok', 'auto_n')} - {_pct_ratio('ok', 'total')}) * 100.0::DOUBLE")} AS accuracy_gain_pts
FROM R"""

ORACLE_SQL["metrics_report"] = TICKETS + f"""
, A AS (SELECT count(*) AS n,
               coalesce(avg((true_department IS NOT DISTINCT FROM cal_department)::INTEGER::DOUBLE), 0.0) AS acc,
               coalesce(avg((true_urgency = cal_urgency)::INTEGER::DOUBLE), 0.0) AS uacc,
               coalesce(avg((abs(true_urgency - cal_urgency) <= 1)::INTEGER::DOUBLE), 0.0) AS w1,
               count(*) FILTER (WHERE cal_department_confidence >= 0.85::DOUBLE) AS auto_n,
               count(*) FILTER (WHERE cal_department_confidence >= 0.85::DOUBLE
                                AND true_department IS NOT DISTINCT FROM cal_department) AS auto_ok,
               count(*) FILTER (WHERE NOT coalesce(cal_department_confidence >= 0.85::DOUBLE, false)
                                AND true_department IS NOT DISTINCT FROM cal_department) AS esc_ok
        FROM TPRED),
D AS (SELECT unnest({DEPTS}) AS d),
V AS (SELECT unnest([0, 1, 2]) AS v, unnest(['0:low', '1:medium', '2:high']) AS name),
L AS (SELECT 'department' AS section, 'accuracy' AS key, acc AS value FROM A
      UNION ALL SELECT 'department', 'support:' || d, (SELECT count(*) FROM TPRED WHERE true_department = d)::DOUBLE FROM D
      UNION ALL SELECT 'department', 'recall:' || d, coalesce((SELECT avg((cal_department IS NOT DISTINCT FROM d)::INTEGER::DOUBLE)
                       FROM TPRED WHERE true_department = d), 0.0) FROM D
      UNION ALL SELECT 'department', 'confusion:' || a.d || '|' || b.d,
                       (SELECT count(*) FROM TPRED WHERE true_department = a.d AND cal_department = b.d)::DOUBLE FROM D a, D b
      UNION ALL SELECT 'urgency', 'confusion:' || a.name || '|' || b.name,
                       (SELECT count(*) FROM TPRED WHERE true_urgency = a.v AND cal_urgency = b.v)::DOUBLE FROM V a, V b
      UNION ALL SELECT 'urgency', 'n', n::DOUBLE FROM A
      UNION ALL SELECT 'urgency', 'accuracy', uacc FROM A
      UNION ALL SELECT 'urgency', 'within_one_level', w1 FROM A
      UNION ALL SELECT 'gating', 'threshold', 0.85::DOUBLE FROM A
      UNION ALL SELECT 'gating', 'auto_route_count', auto_n::DOUBLE FROM A
      UNION ALL SELECT 'gating', 'auto_route_rate', {_pct_ratio('auto_n', 'n')} FROM A
      UNION ALL SELECT 'gating', 'auto_route_accuracy', {_pct_ratio('auto_ok', 'auto_n')} FROM A
      UNION ALL SELECT 'gating', 'escalate_count', (n - auto_n)::DOUBLE FROM A
      UNION ALL SELECT 'gating', 'escalate_rate', {_pct_ratio('n - auto_n', 'n')} FROM A
      UNION ALL SELECT 'gating', 'escalate_accuracy', {_pct_ratio('esc_ok', 'n - auto_n')} FROM A
      UNION ALL SELECT 'gating', 'overall_accuracy', {_pct_ratio('auto_ok + esc_ok', 'n')} FROM A
      UNION ALL SELECT 'latency', 'tickets', n::DOUBLE FROM A
      UNION ALL SELECT 'meta', 'n_test', n::DOUBLE FROM A
      UNION ALL SELECT 'meta', 'departments', len({DEPTS})::DOUBLE FROM A
      UNION ALL SELECT 'meta', 't_department', (SELECT temperature FROM department) FROM A
      UNION ALL SELECT 'meta', 't_urgency', (SELECT temperature FROM urgency) FROM A)
SELECT section, key, round(value, 6) AS value FROM L"""

ORACLE_SQL["scoring_time"] = """
SELECT s AS scorer, count(*) AS tickets, count(*) AS timed, true AS within_clock FROM documents, (VALUES ('lexical'), ('model')) v(s) GROUP BY s"""

ORACLE_SQL["correctness_flags"] = TICKETS + """
SELECT ticket_id,
       CASE WHEN true_department IS NOT NULL THEN (cal_department IS NOT DISTINCT FROM true_department)::INTEGER END
           AS department_correct,
       (cal_urgency = true_urgency)::INTEGER AS urgency_correct,
       CASE WHEN cal_department IS NOT DISTINCT FROM true_department THEN 'OK' ELSE 'MISS' END AS mark
FROM TPRED"""

ORACLE_SQL["decision_log_backfill"] = TICKETS_LOG + """
SELECT id, created_at, source, pred_department, round(department_confidence, 6) AS department_confidence,
       pred_urgency, gate_decision, true_department, true_urgency, department_correct, urgency_correct
FROM LOG"""

ORACLE_SQL["log_by_decision"] = TICKETS_LOG + """
SELECT gate_decision, count(*) AS n, round(avg(department_correct::DOUBLE) * 100.0::DOUBLE, 1) AS dept_acc
FROM LOG GROUP BY gate_decision"""

ORACLE_SQL["log_by_department"] = TICKETS_LOG + """
SELECT coalesce(pred_department, '(none)') AS department, count(*) AS n,
       round(avg(department_correct::DOUBLE) * 100.0::DOUBLE, 1) AS acc
FROM LOG GROUP BY pred_department"""

ORACLE_SQL["log_counts"] = TICKETS_LOG + """
SELECT count(*) AS total, count(*) FILTER (WHERE gate_decision = 'escalate_to_human') AS escalated FROM LOG"""

ORACLE_SQL["log_recent"] = TICKETS_LOG + f"""
SELECT id, CASE WHEN pred_department IS NOT DISTINCT FROM true_department THEN 'OK' ELSE 'MISS' END AS mark,
       pred_department, round(department_confidence, 6) AS department_confidence, true_department,
       replace(substr(text, 1, 70), chr(10), ' ') AS preview
FROM LOG WHERE gate_decision = 'escalate_to_human' ORDER BY id DESC LIMIT {cat.LOG_RECENT_N}"""

ORACLE_SQL["batch_triage"] = BATCH + """
SELECT conv_id, turn, substr(text, 1, 90) AS text, department, round_even(department_confidence, 3) AS dept_conf,
       urgency_label AS urgency, gate_decision AS decision,
       round_even(churn_risk, 2) AS churn, round_even(refund_requested, 2) AS refund
FROM BT2"""

ORACLE_SQL["batch_rollup"] = BATCH + """
SELECT count(*) AS tickets,
       round(coalesce(avg((gate_decision = 'auto_route')::INTEGER::DOUBLE) * 100.0::DOUBLE, 0.0), 6) AS auto_route_pct
FROM BT2"""

ORACLE_SQL["department_volume"] = BATCH + """
SELECT department, count(*) AS n FROM BT2 WHERE department IS NOT NULL GROUP BY department"""

ORACLE_SQL["probs_json_roundtrip"] = with_ctes(E_CTE) + """
SELECT event_id, label_index::INTEGER AS label_index, round(p, 6) AS p FROM (
  SELECT event_id, unnest(range(1, len(probs) + 1)) AS label_index, unnest(probs) AS p FROM E)"""

_LIVE = with_ctes(
    "\nDOC AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\\S'))", lexical_ctes("DOC", "LL", SPEC),
    scaled_ctes("LL", "LD", "department_p", _d(cat.LIVE_TEMPERATURES["department"])),
    scaled_ctes("LD", "LU", "urgency_p", _d(cat.LIVE_TEMPERATURES["urgency"])))
ORACLE_SQL["live_triage_stream"] = _LIVE + f"""
SELECT row_number() OVER (ORDER BY doc_id) AS id, true AS fresh, 'live' AS source,
       {argmax(DEPT_LABELS, 'LDp')} AS pred_department, {r6('list_max(LDp)')} AS department_confidence,
       {ordinal_class('urgency_ev', '3')} AS pred_urgency,
       {r6(f"coalesce(LUp[{ordinal_class('urgency_ev', '3')} + 1], 0.0::DOUBLE)")} AS urgency_confidence,
       {r6('churn_risk_n')} AS churn_risk, {r6('refund_requested_n')} AS refund_requested,
       {gate('list_max(LDp)', cat.LIVE_THRESHOLD)} AS gate_decision, NULL::INTEGER AS department_correct
FROM LU"""

ORACLE_SQL["log_compaction"] = BATCH + f"""
SELECT row_number() OVER (ORDER BY conv_id % {cat.LOG_APPENDS}, conv_id, turn) AS id, text, department AS pred_department,
       {cat.LOG_APPENDS} AS segments_before, 1 AS segments_after FROM BT2"""


ORACLE_SQL["prediction_display"] = TICKETS + """
SELECT ticket_id, substr(cal_department, 1, 10) AS dept_short, substr(cal_department, 1, 12) AS dept_short12,
       ['low', 'medium', 'high'][cal_urgency + 1] AS urgency_name,
       upper(substr(['low', 'medium', 'high'][cal_urgency + 1], 1, 1)) || substr(['low', 'medium', 'high'][cal_urgency + 1], 2)
           AS urgency_title,
       printf('%.0f', cal_department_confidence * 100.0::DOUBLE) || '%' AS conf_pct,
       replace(substr(text, 1, 80), chr(10), ' ') AS preview
FROM TPRED"""

_PRESET = cat.triage_preset()
_PRESET_CTE = with_ctes(
    """
UM AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')""",
    lexical_ctes("UM", "PL", _PRESET))
ORACLE_SQL["preset_answers"] = _PRESET_CTE + f"""
SELECT conv_id, turn, 0 AS question_index, 'sentiment' AS question,
       {argmax(_lst(_PRESET['sentiment'].labels), 'sentiment_p')} || '  (conf ' || {_fmt('list_max(sentiment_p)')} || ')' AS answer
FROM PL
UNION ALL
SELECT conv_id, turn, 1, 'priority', 'score ' || {_fmt('priority_ev')} || '  (conf '
       || {_fmt(f"coalesce(priority_p[{ordinal_class('priority_ev', '3')} + 1], 0.0::DOUBLE)")} || ')' FROM PL
UNION ALL
SELECT conv_id, turn, 2, 'needs_reply', {_fmt('needs_reply_n')} || ' probability' FROM PL"""

ORACLE_SQL["run_metadata"] = TICKETS + """
SELECT (SELECT count(*) FROM TR WHERE split <> 'cal') AS n_test, 'lexical' AS scorer,
       (SELECT temperature FROM department) AS t_department, (SELECT temperature FROM urgency) AS t_urgency"""

ORACLE_SQL["log_by_source"] = TICKETS_LOG + """
SELECT count(*) AS total, count(*) FILTER (WHERE gate_decision = 'escalate_to_human') AS escalated, 'batch' AS source
FROM LOG WHERE source = 'batch'"""

ORACLE_SQL["upload_csv_roundtrip"] = """
SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations"""

ORACLE_SQL["raw_ticket_csv"] = with_ctes(T_PREP_CTE) + """
SELECT subject, body, queue, priority, language, NULL::VARCHAR AS type, md5(concat_ws(chr(10), subject, body)) AS tags FROM traw"""

ORACLE_SQL["split_dataset"] = with_ctes(T_PREP_CTE, split_ctes("TP", "ticket_id", "department", "TS")) + """
SELECT ticket_id, department, urgency_score FROM TS WHERE split = 'test'"""

ORACLE_SQL["batch_output_csv"] = ORACLE_SQL["batch_triage"]

ORACLE_SQL["predictions_parquet"] = TICKETS + """
SELECT ticket_id, label_index::INTEGER AS label_index, round(p, 6) AS p FROM (
  SELECT ticket_id, unnest(range(1, len(department_probs) + 1)) AS label_index, unnest(department_probs) AS p
  FROM TR WHERE split <> 'cal')"""

ORACLE_SQL["temperatures_json"] = TICKETS + """
SELECT question, temperature FROM department
UNION ALL SELECT question, temperature FROM urgency
UNION ALL SELECT 'churn_risk', 1.0::DOUBLE"""

# Inputs with NULL, NaN and other label counts, written from the stated rules.
_W10 = {10: "(2 * k + 3)", 2: "(4 * k + 3)"}
for _n, _m in _W10.items():
    ORACLE_SQL[f"scaling_{_n}_labels"] = f"""
WITH w AS (SELECT event_id, list_transform(range({_n}), lambda k: 1 + (event_id * {_m}) % 17) AS w FROM events),
p AS (SELECT event_id, list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS p FROM w),
l AS (SELECT event_id, t, list_transform(p, lambda x: ln(greatest(x, 1e-9)) / t) AS l FROM p, (VALUES (2.0::DOUBLE), (20.0::DOUBLE)) v(t)),
e AS (SELECT event_id, t, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l)
SELECT event_id, t AS temperature, 'd' || (list_position(e, list_max(e)) - 1) AS label, round(list_max(e) / list_sum(e), 6) AS confidence FROM e"""

_EDGE_CTE = """
X AS (SELECT event_id, event_type AS truth,
        CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN event_type ELSE 'view' END AS pred,
        CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN 0.85 WHEN 3 THEN 0.8 ELSE 0.99 END AS conf,
        0.75 + (event_id % 4) / 20.0::DOUBLE AS limit_
      FROM events),
G AS (SELECT *, conf IS NOT NULL AND NOT isnan(conf) AND conf >= 0.85 AS auto, pred IS NOT DISTINCT FROM truth AS ok FROM X)"""
ORACLE_SQL["gate_nan_null"] = "WITH" + _EDGE_CTE + """
SELECT event_id, CASE WHEN auto THEN 'auto_route' ELSE 'escalate_to_human' END AS decision,
       CASE WHEN conf IS NOT NULL AND NOT isnan(conf) AND conf >= limit_ THEN 'auto_route' ELSE 'escalate_to_human' END AS decision_own FROM G"""
ORACLE_SQL["gating_metrics_nan_null"] = "WITH" + _EDGE_CTE + """
SELECT 0.85::DOUBLE AS threshold, count(*) FILTER (WHERE auto) AS auto_route_count, round(count(*) FILTER (WHERE auto) / count(*)::DOUBLE, 6) AS auto_route_rate,
       round(count(*) FILTER (WHERE auto AND ok) / (count(*) FILTER (WHERE auto))::DOUBLE, 6) AS auto_route_accuracy,
       count(*) FILTER (WHERE NOT auto) AS escalate_count, round(count(*) FILTER (WHERE NOT auto) / count(*)::DOUBLE, 6) AS escalate_rate,
       round(count(*) FILTER (WHERE NOT auto AND ok) / (count(*) FILTER (WHERE NOT auto))::DOUBLE, 6) AS escalate_accuracy,
       round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS overall_accuracy FROM G"""
ORACLE_SQL["threshold_sweep_nan_null"] = "WITH" + _EDGE_CTE + """
SELECT (p / 100.0::DOUBLE)::DOUBLE AS threshold, count(*) FILTER (WHERE conf IS NOT NULL AND NOT isnan(conf) AND conf >= p / 100.0::DOUBLE) AS auto_route_count
FROM G, (SELECT unnest(range(50, 100, 2)) AS p) GROUP BY p"""
ORACLE_SQL["recall_null_predictions"] = "WITH" + _EDGE_CTE + f"""
SELECT truth AS department, count(*) AS support, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100.0, 1) AS recall_pct
FROM G WHERE list_contains({EV_LABELS}, truth) GROUP BY truth"""
ORACLE_SQL["split_null_strata"] = with_ctes("""
NS AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS stratum FROM events)""",
                                            split_ctes("NS", "event_id", "stratum", "NSS")) + "SELECT event_id, stratum, split FROM NSS"
ORACLE_SQL["fraction_split"] = """
WITH u AS (SELECT event_id, ('0x' || substr(md5('42|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events)
SELECT event_id, CASE WHEN u < 0.05 THEN 'cal' WHEN u < 0.95 THEN 'test' ELSE 'unused' END AS split FROM u"""
ORACLE_SQL["blank_texts"] = """
SELECT doc_id, regexp_matches(CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(9) || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END, '\\S') AS has_text FROM documents"""
