"""Independent SQL for the catalog: what each query must return."""

from __future__ import annotations

from tidewatch.functions import fixed_values as fixed
from tidewatch.functions import wording
from tidewatch.sources.warehouse import PAYMENT_TERMS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(column: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def dec(value: str, places: int) -> str:
    return f"format('{{:.{places}f}}', {value})"


def filled(template: str, **values: str) -> str:
    out = text(template)
    for mark, value in values.items():
        if "{" + mark + "}" in template:
            out = f"replace({out}, '{{{mark}}}', {value})"
    return out


NL = "chr(10)"

SALES = f"""sales AS (
  SELECT c_custkey AS customer_key, CAST(o_orderdate AS DATE) AS transaction_date,
         c_name AS customer_name, p_type AS category, CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice * (1 - l_discount) / l_quantity AS unit_sales_price,
         p_retailprice * (1 + l_tax) AS unit_cost,
         {case('o_orderpriority', PAYMENT_TERMS)} AS payment_term, c_acctbal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""

DICT = """dict AS (
  SELECT customer_name AS name, 'CUSTOMER_' || row_number() OVER (ORDER BY k, customer_name) AS token,
         row_number() OVER (ORDER BY k, customer_name) AS token_no
  FROM (SELECT customer_name, min(customer_key) AS k FROM sales GROUP BY 1))"""

EARLY = """early AS (
  SELECT customer_name AS name, row_number() OVER (ORDER BY min(customer_key), customer_name) AS token_no
  FROM sales WHERE transaction_date < DATE '1996-01-01' GROUP BY customer_name),
grown AS (
  SELECT name, token_no FROM early
  UNION ALL
  SELECT customer_name, (SELECT max(token_no) FROM early)
         + row_number() OVER (ORDER BY min(customer_key), customer_name)
  FROM sales WHERE customer_name NOT IN (SELECT name FROM early) GROUP BY customer_name)"""

MASKED = """masked AS (
  SELECT token AS customer_id, token_no AS pos, sales.* FROM sales JOIN dict ON name = customer_name)"""

DIRTY = """dirty AS (
  SELECT customer_key, transaction_date,
         CASE WHEN c_acctbal < 0 THEN '   ' ELSE customer_name END AS customer_name,
         CASE WHEN category = 'PROMO' THEN repeat(category, 21) ELSE category END AS category,
         CASE WHEN quantity < 50 THEN quantity END AS quantity,
         CASE quantity WHEN 1 THEN 0e0 WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE unit_sales_price END
           AS unit_sales_price,
         CASE WHEN quantity = 2 THEN CAST('NaN' AS DOUBLE) ELSE unit_cost END AS unit_cost, CASE WHEN payment_term <> 'Net 45' THEN payment_term END AS payment_term
  FROM sales),
judged AS (
  SELECT *, concat_ws(',',
      CASE WHEN quantity IS NULL THEN 'NULL_QUANTITY' END,
      CASE WHEN payment_term IS NULL THEN 'NULL_PAYMENT_TERM' END,
      CASE WHEN trim(customer_name) = '' THEN 'MASK_EMPTY' END,
      CASE WHEN length(category) > 100 THEN 'LONG_CATEGORY' END,
      CASE WHEN unit_sales_price = 0 THEN 'ZERO_UNIT_SALES_PRICE' END,
      CASE WHEN NOT isfinite(unit_sales_price) THEN 'NOT_FINITE_UNIT_SALES_PRICE' END,
      CASE WHEN NOT isfinite(unit_cost) THEN 'NOT_FINITE_UNIT_COST' END) AS reasons
  FROM dirty)"""


def metric_ctes(key: str, source: str, period: str = "quarter", fill: bool = False) -> str:
    """totals, trends and metrics for a key; ``fill`` adds empty periods."""
    totals = f"""observed AS (
  SELECT {key}, CAST(date_trunc('{period}', transaction_date) AS DATE) AS period,
         CAST(sum(quantity) AS BIGINT) AS quantity, sum(quantity * unit_sales_price) AS revenue,
         sum(quantity * unit_cost) AS cost_total
  FROM {source} GROUP BY ALL),
"""
    if fill:
        step = {"quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH"}[period]
        totals += f"""spine AS (
  SELECT {key}, CAST(unnest(generate_series(CAST(min(period) AS TIMESTAMP),
      CAST((SELECT max(period) FROM observed) AS TIMESTAMP), {step})) AS DATE) AS period
  FROM observed GROUP BY {key}),
totals AS (
  SELECT {key}, period, coalesce(quantity, 0) AS quantity, coalesce(revenue, 0) AS revenue,
         coalesce(cost_total, 0) AS cost_total
  FROM spine LEFT JOIN observed USING ({key}, period)),
"""
    else:
        totals += "totals AS (SELECT * FROM observed),\n"
    return totals + f"""valued AS (
  SELECT *, revenue / nullif(quantity, 0) AS unit_price, cost_total / nullif(quantity, 0) AS unit_cost,
         lag(quantity, 1) OVER w AS previous_quantity, lag(quantity, 2) OVER w AS earlier_quantity
  FROM totals WINDOW w AS (PARTITION BY {key} ORDER BY period)),
trends AS (
  SELECT *,
    round((previous_quantity - quantity) / nullif(CAST(previous_quantity AS DOUBLE), 0) * 100e0, 6) AS single_drop,
    round((earlier_quantity - quantity) / nullif(CAST(earlier_quantity AS DOUBLE), 0) * 100e0, 6) AS two_drop
  FROM valued),
ends AS (
  SELECT {key}, count(*) AS periods, max(period) AS current_period,
         arg_max(quantity, period) AS current_quantity, max(single_drop) AS max_single_drop,
         arg_max_null(single_drop, period) AS last_drop, arg_max_null(two_drop, period) AS two_period_drop,
         arg_min(unit_price, period) FILTER (unit_price IS NOT NULL) AS first_price,
         arg_max(unit_price, period) FILTER (unit_price IS NOT NULL) AS last_price,
         arg_min(unit_cost, period) FILTER (unit_price IS NOT NULL) AS first_cost,
         arg_max(unit_cost, period) FILTER (unit_price IS NOT NULL) AS last_cost
  FROM trends GROUP BY {key}),
metrics AS (
  SELECT *, round((last_price - last_cost) / nullif(last_price, 0), 6) AS current_margin,
         round((last_cost / nullif(first_cost, 0) - 1) * 100e0, 6) AS cost_growth_pct,
         round((last_price / nullif(first_price, 0) - 1) * 100e0, 6) AS price_growth_pct,
         round((last_cost / nullif(first_cost, 0) - last_price / nullif(first_price, 0)) * 100e0, 6) AS growth_gap
  FROM ends)"""


def class_ctes(drop: str = "max_single_drop") -> str:
    return f"""classified AS (
  SELECT *, coalesce(two_period_drop >= 30, false) OR coalesce({drop} >= 50, false) AS churn,
         coalesce(current_margin < 0.15e0, false) OR coalesce(growth_gap >= 10, false) AS margin,
         greatest(two_period_drop, {drop}) AS worst
  FROM metrics),
typed AS (
  SELECT *, CASE WHEN churn AND margin THEN 'BOTH' WHEN churn THEN 'CHURN_RISK'
                 WHEN margin THEN 'MARGIN_RISK' END AS risk_type FROM classified),
graded AS (
  SELECT *,
    CASE WHEN risk_type = 'BOTH' THEN 'CRITICAL'
         WHEN coalesce(worst >= 70, false) OR coalesce(current_margin < 0.10e0, false) THEN 'HIGH'
         WHEN coalesce(worst >= 50, false) OR coalesce(current_margin < 0.15e0, false) THEN 'MEDIUM'
         ELSE 'LOW' END AS severity,
    round(CASE risk_type WHEN 'CHURN_RISK' THEN worst WHEN 'MARGIN_RISK' THEN current_margin
          ELSE worst + greatest(0e0, (0.15e0 - current_margin) * 100e0) END, 6) AS metric_value
  FROM typed WHERE risk_type IS NOT NULL)"""


def _evidence() -> str:
    def number(value: str) -> str:
        return f"coalesce({dec(value, 1)}, {text(wording.NOT_MEASURED)})"

    arms = " ".join(
        f"WHEN {text(risk)} THEN "
        + filled(
            template,
            customer="customer_id",
            two=number("two_period_drop"),
            single=number("max_single_drop"),
            margin=number("current_margin * 100e0"),
            gap=number("growth_gap"),
        )
        for risk, template in wording.EVIDENCE.items()
    )
    return f"CASE risk_type {arms} END"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


_TITLES = {risk: play["title"] for risk, play in wording.PLAYBOOK.items()}
_RATIONALES = {risk: play["rationale"] for risk, play in wording.PLAYBOOK.items()}
_STEPS = " ".join(
    f"WHEN {text(risk)} THEN {_list(play['steps'])}" for risk, play in wording.PLAYBOOK.items()
)

FINDINGS = f"""findings AS (
  SELECT customer_id, risk_type, severity, {_evidence()} AS evidence, metric_value,
         CAST(replace(customer_id, 'CUSTOMER_', '') AS BIGINT) AS pos FROM graded)"""

STRATEGIES = f"""strategies AS (
  SELECT customer_id, risk_type, {case('risk_type', _TITLES)} AS strategy_title,
         replace({case('risk_type', _RATIONALES)}, '{{evidence}}', evidence) AS rationale,
         list_transform(CASE risk_type {_STEPS} END,
                        lambda s: replace(s, '{{customer}}', customer_id)) AS action_steps,
         {case('severity', fixed.SEVERITY_PRIORITY)} AS priority, pos FROM findings)"""

_BODY = f"""replace(CASE channel WHEN 'EMAIL' THEN {case('risk_type', wording.EMAIL_BODIES)}
  ELSE {case('risk_type', wording.CHAT_BODIES)} END, '[{{customer}} {{role}}]',
  '[' || customer_id || ' {wording.READER_ROLE}]')"""

MESSAGES = f"""messages AS (
  SELECT customer_id, risk_type, channel,
         CASE channel WHEN 'EMAIL' THEN {case('risk_type', wording.SUBJECTS)} ELSE '' END AS subject,
         {_BODY} AS body,
         CASE WHEN channel = 'EMAIL' THEN 'FORMAL' WHEN priority = 'URGENT' THEN 'URGENT'
              ELSE 'FRIENDLY_PROFESSIONAL' END AS tone,
         CASE channel WHEN 'EMAIL' THEN pos * 2 - 1 ELSE pos * 2 END AS pos
  FROM strategies CROSS JOIN (VALUES ('EMAIL'), ('WHATSAPP')) AS c(channel))"""

_ICON = case("severity", fixed.SEVERITY_ICONS, text(fixed.DEFAULT_ICON))
CARDS = f"""cards AS (
  SELECT f.*, s.strategy_title, s.rationale, s.action_steps, s.priority, m.body,
         '[' || {_ICON} || ' ' || {case('severity', fixed.SEVERITY_LABELS, 'severity')} || ' Risk]' AS severity_tag,
         {case('f.risk_type', fixed.RISK_LABELS, 'f.risk_type')} AS risk_label
  FROM findings f LEFT JOIN strategies s USING (customer_id)
  LEFT JOIN (SELECT * FROM messages WHERE channel = 'WHATSAPP') m USING (customer_id))"""

BASE = f"{SALES},\n{DICT},\n{MASKED}"
METRICS = f"{BASE},\n{metric_ctes('customer_id', 'masked')}"
RISKS = f"{METRICS},\n{class_ctes()},\n{FINDINGS},\n{STRATEGIES},\n{MESSAGES}"
ALL = f"{RISKS},\n{CARDS}"

_SIX = "round({0} + 1e-9, 6) AS {0}".format
_COLUMNS = (
    "CAST(transaction_date AS VARCHAR) AS transaction_date, category, quantity, "
    "unit_sales_price, unit_cost, payment_term"
)
_PERIOD = "CAST(period AS VARCHAR) AS period"
_MARGIN = "((unit_sales_price - unit_cost) / nullif(unit_sales_price, 0) * 100e0)"
_LINE = (
    "'  ' || CAST(transaction_date AS VARCHAR) || ' | Category: ' || category || ' | Qty: ' || quantity"
    f" || ' | Price: ' || {dec('unit_sales_price', 2)} || ' TRY | Cost: ' || {dec('unit_cost', 2)}"
    f" || ' TRY | Margin: ' || {dec(_MARGIN, 1)} || '%'"
)
_FINDING_LINE = (
    "'- ' || customer_id || ' | ' || risk_type || ' | Severity: ' || severity || ' | Metric: ' || "
    f"{dec('metric_value', 3)} || ' | Evidence: ' || evidence"
)
_STRATEGY_BLOCK = (
    f"'Customer: ' || customer_id || {NL} || 'Risk: ' || risk_type || ' | Priority: ' || priority || {NL}"
    f" || 'Strategy: ' || strategy_title || {NL} || 'Rationale: ' || rationale || {NL}"
    f" || 'Action Steps:' || {NL} || array_to_string(list_transform(action_steps,"
    f" lambda s, i: '    ' || i || '. ' || s), {NL})"
)
_ENCODED = "replace(url_encode({0}), '%2F', '/')".format
_LINK = f"{text(fixed.SHARE_PREFIX)} || " + _ENCODED("{0}")


def _named(column: str) -> str:
    """The text with the card's own token replaced as a whole."""
    return f"regexp_replace({column}, customer_id || '([^0-9]|$)', name || '\\1', 'g')"


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _digests(output: str, columns: dict[str, str], source: str, part: str = "''") -> str:
    """Rows of an output and the sum of 32 bits of the hash of each; columns in order of name."""
    values = [f"coalesce(CAST({columns[name]} AS VARCHAR), '~')" for name in sorted(columns)]
    row = f"concat_ws('|', {part}, {', '.join(values)})"
    return (
        f"SELECT '{output}' AS output, {part} AS part, count(*) AS rows,"
        f" CAST(coalesce(sum(CAST('0x' || substr(md5({row}), 1, 8) AS BIGINT)), 0) AS BIGINT) AS digest"
        f" FROM {source} GROUP BY 2"
    )


def _same(*columns: str) -> dict[str, str]:
    return {column: column for column in columns}


def _sinks() -> str:
    clean = f"{SALES},\n{DIRTY},\nclean AS (SELECT * FROM judged WHERE reasons = '')"
    rest = f"{DICT},\n{MASKED}".replace("FROM sales", "FROM clean").replace("sales.*", "clean.*")
    ctes = f"{clean},\n{rest},\n{metric_ctes('customer_id', 'masked')},\n{class_ctes()}"
    ctes += f",\n{FINDINGS},\n{STRATEGIES},\n{MESSAGES},\n{CARDS}"
    ctes += """,
wrong AS (
  SELECT 'load' AS step, CAST(customer_key AS VARCHAR) AS key, unnest(string_split(reasons, ',')) AS reason
  FROM judged WHERE reasons <> ''),
counted AS (
  SELECT unnest(['findings', 'strategies', 'messages', 'errors']) AS metric, unnest([
    (SELECT count(*) FROM findings), (SELECT count(*) FROM strategies), (SELECT count(*) FROM messages),
    (SELECT count(*) FROM wrong)]) AS value),
drafts AS (
  SELECT *, CAST(n AS INTEGER) AS words,
    CASE channel WHEN 'EMAIL' THEN n BETWEEN 150 AND 250 ELSE n BETWEEN 60 AND 100 END AS length_ok
  FROM (SELECT *, len(regexp_split_to_array(trim(body), '\\s+')) AS n FROM messages)),
summed AS (""" + ORACLE_SUMMARY + "),\nadvised AS (" + ORACLE_ADVICE + ")"
    steps = f"array_to_string(action_steps, {NL})"
    named = {c: _named(c) for c in ("evidence", "rationale", "body")}
    inbox = _same("customer_id", "pos", "risk_type", "severity", "metric_value", "priority", "strategy_title") | named
    inbox |= {
        "customer_name": "name",
        "action_steps": _named(steps),
        "share_link": _LINK.format(_named("body")),
        "queue": "CASE severity WHEN 'LOW' THEN 'AUTO' ELSE 'REVIEW' END",
    }
    parts = [
        _digests(
            "findings",
            _same("customer_id", "risk_type", "severity", "evidence", "metric_value", "pos"),
            "findings",
            "risk_type",
        ),
        _digests(
            "strategies",
            _same("customer_id", "risk_type", "strategy_title", "rationale", "priority", "pos") | {"action_steps": steps},
            "strategies",
        ),
        _digests(
            "messages",
            _same("customer_id", "risk_type", "channel", "subject", "body", "tone", "pos", "words", "length_ok"),
            "drafts",
        ),
        _digests("inbox", inbox, "cards JOIN dict ON token = customer_id"),
        _digests("errors", _same("step", "key", "reason"), "wrong"),
        _digests("analysis_summary", _same("summary"), "summed"),
        _digests("strategy_summary", _same("summary"), "advised"),
        _digests("run_counts", _same("metric", "value"), "counted"),
    ]
    return _sql(ctes, "\nUNION ALL ".join(parts))


ORACLE_SUMMARY = (
    "SELECT "
    + filled(
        wording.ANALYSIS_SUMMARY,
        total="CAST(count(*) AS VARCHAR)",
        churn="CAST(count(*) FILTER (risk_type = 'CHURN_RISK') AS VARCHAR)",
        margin="CAST(count(*) FILTER (risk_type = 'MARGIN_RISK') AS VARCHAR)",
        both="CAST(count(*) FILTER (risk_type = 'BOTH') AS VARCHAR)",
        critical="CAST(count(*) FILTER (severity = 'CRITICAL') AS VARCHAR)",
    )
    + " AS summary FROM findings"
)
ORACLE_ADVICE = (
    "SELECT "
    + filled(
        wording.STRATEGY_SUMMARY,
        total="CAST(count(*) AS VARCHAR)",
        urgent="CAST(count(*) FILTER (priority = 'URGENT') AS VARCHAR)",
    )
    + " AS summary FROM strategies"
)


ORACLE: dict[str, str] = {
    "S1_sales_scan": _sql(SALES, f"SELECT customer_name, {_COLUMNS} FROM sales"),
    "S2_contract": _sql(
        f"{SALES},\n{DIRTY}",
        "SELECT reasons, count(*) AS rows, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity"
        " FROM judged GROUP BY 1",
    ),
    "S3_raw_ingest": _sql(SALES, f"SELECT customer_name, {_COLUMNS} FROM sales"),
    "S3_unreadable_lines": _sql(
        SALES,
        """SELECT CASE quantity WHEN 7 THEN 'UNREADABLE_QUANTITY' WHEN 8 THEN 'UNREADABLE_TRANSACTION_DATE'
  ELSE 'BROKEN_LINE' END AS reason, count(*) AS rows,
  count(DISTINCT CASE quantity WHEN 9 THEN category ELSE payment_term END) AS endings
FROM sales WHERE quantity IN (7, 8, 9) GROUP BY 1""",
    ),
    "S1_sales_by_customer": _sql(
        f"{SALES},\n{metric_ctes('customer_name', 'sales')}",
        f"SELECT customer_name, {_PERIOD}, quantity, {_SIX('unit_price')}, {_SIX('unit_cost')} FROM trends",
    ),
    "S4_load_once": _sql(SALES, "SELECT payment_term, count(*) AS rows FROM sales GROUP BY 1"),
    "S5_default_rows": _sql(
        SALES,
        "SELECT category, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity FROM sales GROUP BY 1",
    ),
    "S6_input_check": _sql(
        SALES, "SELECT payment_term, CAST(sum(quantity) AS BIGINT) AS quantity FROM sales GROUP BY 1"
    ),
    "S7_output_sinks": _sinks(),
    "M1_token_dictionary": _sql(f"{SALES},\n{DICT}", "SELECT name, token, token_no FROM dict"),
    "M2_dictionary_extension": _sql(
        f"{SALES},\n{EARLY}", "SELECT name, 'CUSTOMER_' || token_no AS token, token_no FROM grown"
    ),
    "M3_mask": _sql(
        BASE,
        "SELECT customer_id, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity FROM masked GROUP BY 1",
    ),
    "M4_unmask": _sql(
        f"{SALES},\n{EARLY}",
        "SELECT 'CUSTOMER_' || g.token_no AS customer_id, coalesce(e.name, '') AS customer_name,"
        " CAST(CAST(date_trunc('quarter', transaction_date) AS DATE) AS VARCHAR) AS period,"
        " CAST(sum(quantity) AS BIGINT) AS quantity"
        " FROM sales JOIN grown g ON g.name = customer_name LEFT JOIN early e ON e.token_no = g.token_no"
        " GROUP BY 1, 2, 3",
    ),
    "M4_unmask_strict": _sql(
        RISKS,
        "SELECT customer_id, name AS customer_name, risk_type FROM findings JOIN dict ON token = customer_id",
    ),
    "M5_unmask_text": _sql(
        f"{SALES},\n{EARLY}",
        f"""SELECT t AS key, coalesce(a.name, t) || {NL} || coalesce(b.name, t || '0') || ' C X'
  || coalesce(a.name, t) || ', CUSTOMER_ / ' || coalesce(c.name, t || '1') AS text
FROM (SELECT 'CUSTOMER_' || token_no AS t, token_no AS n FROM grown)
LEFT JOIN early a ON a.token_no = n LEFT JOIN early b ON b.token_no = n * 10
LEFT JOIN early c ON c.token_no = n * 10 + 1""",
    ),
    "M6_name_check": _sql(
        f"{SALES},\n{DIRTY}",
        "SELECT CASE WHEN trim(customer_name) = '' THEN 'MASK_EMPTY' ELSE '' END AS reason,"
        " count(*) AS rows, count(DISTINCT customer_key) AS customers FROM dirty GROUP BY 1",
    ),
    "M7_prefix": (
        "SELECT s_name AS name, 'VENDOR_' || row_number() OVER (ORDER BY s_suppkey) AS token,"
        " row_number() OVER (ORDER BY s_suppkey) AS token_no FROM supplier"
    ),
    "M8_export_map": _sql(f"{SALES},\n{DICT}", "SELECT name, token FROM dict"),
    "M9_reset": _sql(
        f"{SALES},\n{DICT},\n{EARLY}",
        """SELECT d.name, d.token, d.token_no, coalesce('CUSTOMER_' || e.token_no, '') AS old_token,
  coalesce(n.name, '') AS old_token_now
FROM dict d LEFT JOIN early e ON e.name = d.name LEFT JOIN dict n ON n.token_no = e.token_no""",
    ),
    "M10_leak_audit": _sql(
        ALL,
        "SELECT t.key, n.name FROM ("
        + " UNION ALL ".join(
            [
                f"SELECT 'tokens/' || customer_id || '/{name}' AS key, {value} AS text FROM {source}"
                for name, value, source in (
                    ("evidence", "evidence", "findings"),
                    ("strategy_title", "strategy_title", "strategies"),
                    ("rationale", "rationale", "strategies"),
                    ("action_steps", f"array_to_string(action_steps, {NL})", "strategies"),
                )
            ]
            + [
                f"SELECT 'tokens/' || customer_id || '/' || channel || '/{name}', {name} FROM messages"
                for name in ("subject", "body")
            ]
            + [
                f"SELECT 'names/' || customer_id || '/{name}', {_named(value)} FROM cards JOIN dict ON token = customer_id"
                for name, value in (
                    ("evidence", "evidence"),
                    ("rationale", "rationale"),
                    ("action_steps", f"array_to_string(action_steps, {NL})"),
                    ("body", "body"),
                )
            ]
        )
        + ") t JOIN dict n ON contains(t.text, n.name)",
    ),
    "M11_masked_projection": _sql(BASE, f"SELECT customer_id, {_COLUMNS} FROM masked"),
    "P1_row_margin": _sql(
        BASE,
        "SELECT customer_id, CAST(transaction_date AS VARCHAR) AS transaction_date, quantity,"
        f" round({_MARGIN}, 6) AS margin_pct FROM masked",
    ),
    "P2_sale_line": _sql(BASE, f"SELECT customer_id, {_LINE} AS line FROM masked"),
    "P3_finding_line": _sql(RISKS, f"SELECT customer_id, {_FINDING_LINE} AS line FROM findings"),
    "P4_strategy_block": _sql(RISKS, f"SELECT customer_id, {_STRATEGY_BLOCK} AS line FROM strategies"),
    "P5_labels": _sql(ALL, "SELECT customer_id, severity_tag, risk_label FROM cards"),
    "P6_metric_text": _sql(
        RISKS,
        f"""SELECT customer_id, {case('risk_type', fixed.METRIC_LABELS)} AS metric_label,
  CASE WHEN risk_type = 'CHURN_RISK' THEN '%' || {dec('metric_value', 1)}
       WHEN risk_type = 'MARGIN_RISK' AND metric_value < 1 THEN '%' || {dec('metric_value * 100e0', 1)}
       ELSE {dec('metric_value', 1)} END AS metric_text,
  CASE risk_type WHEN 'CHURN_RISK' THEN '-%' || {dec('metric_value', 1)}
       WHEN 'MARGIN_RISK' THEN {text(fixed.MARGIN_NOTE)} ELSE {text(fixed.SCORE_NOTE)} END AS metric_note
FROM findings""",
    ),
    "P7_share_link": _sql(
        RISKS,
        f"SELECT customer_id, {_LINK.format('body')} AS share_link FROM messages WHERE channel = 'WHATSAPP'",
    ),
    "P8_strategy_defaults": _sql(
        RISKS,
        f"""SELECT customer_id,
  CASE risk_type WHEN 'BOTH' THEN strategy_title ELSE {text(fixed.NO_TITLE)} END AS strategy_title,
  CASE risk_type WHEN 'BOTH' THEN rationale ELSE {text(fixed.NO_RATIONALE)} END AS rationale,
  CASE risk_type WHEN 'BOTH' THEN array_to_string(action_steps, {NL}) ELSE {text(fixed.NO_STEP)} END AS action_steps
FROM strategies""",
    ),
    "P9_placeholder": _sql(
        f"{SALES},\n{DICT}",
        f"SELECT token AS customer_id, '[' || token || ' {wording.READER_ROLE}]' AS placeholder FROM dict",
    ),
    "F1_at_risk": _sql(RISKS, "SELECT customer_id, risk_type, periods FROM graded"),
    "F2_channel_filter": _sql(
        RISKS, "SELECT customer_id, channel, tone FROM messages WHERE channel = 'WHATSAPP'"
    ),
    "F3_empty_findings": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({text(line)})"
        for line in (
            wording.NO_ANALYSIS_SUMMARY,
            fixed.NO_RISK_SUMMARY,
            fixed.NO_FINDINGS_LINE,
            fixed.NO_STRATEGIES_LINE,
        )
    )
    + ") AS t(line)",
    "A1_row_count": _sql(BASE, "SELECT count(*) AS records FROM masked"),
    "A2_distinct_customers": _sql(BASE, "SELECT count(DISTINCT customer_id) AS customers FROM masked"),
    "A3_context_blocks": _sql(
        BASE,
        f"""SELECT customer_id, CAST(block AS INTEGER) AS block, CAST(count(*) AS INTEGER) AS pieces,
  CASE WHEN block = 0 THEN {NL} || '=== ' || customer_id || ' ===' || {NL} ELSE '' END
    || string_agg(rtrim(repeat({_LINE} || {NL}, CAST(copies AS BIGINT)), {NL}), {NL} ORDER BY n) AS text
FROM (
  SELECT *, (n - 1) // 25 AS block FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date, category, quantity,
                                 unit_sales_price, unit_cost) AS n
    FROM (SELECT customer_id, transaction_date, category, quantity, unit_sales_price, unit_cost,
                 count(*) AS copies FROM masked GROUP BY ALL)))
GROUP BY customer_id, block""",
    ),
    "A4_period_totals": _sql(
        METRICS,
        f"SELECT customer_id, {_PERIOD}, quantity, {_SIX('unit_price')}, {_SIX('unit_cost')} FROM trends",
    ),
    "A4_month_and_category": _sql(
        BASE,
        "SELECT customer_id, category,"
        " CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS period,"
        " CAST(sum(quantity) AS BIGINT) AS quantity,"
        " round(sum(quantity * unit_sales_price) + 1e-9, 6) AS revenue FROM masked GROUP BY 1, 2, 3",
    ),
    "A5_period_spine": _sql(
        f"{BASE},\n{metric_ctes('customer_id', 'masked', fill=True)}",
        f"SELECT customer_id, {_PERIOD}, quantity, {_SIX('revenue')} FROM totals",
    ),
    "A6_first_last": _sql(
        METRICS,
        f"SELECT customer_id, {_SIX('first_price')}, {_SIX('last_price')}, {_SIX('first_cost')},"
        f" {_SIX('last_cost')}, cost_growth_pct, price_growth_pct FROM metrics",
    ),
    "A7_margin_and_velocity": _sql(
        METRICS,
        """SELECT customer_id, avg_margin_ratio, order_velocity_change_pct FROM
  (SELECT customer_id, round(avg((unit_sales_price - unit_cost) / nullif(unit_sales_price, 0)), 6)
   AS avg_margin_ratio FROM masked GROUP BY 1)
JOIN (SELECT customer_id, arg_max_null(round((quantity - previous_quantity)
      / nullif(CAST(previous_quantity AS DOUBLE), 0) * 100e0, 6), period) AS order_velocity_change_pct
      FROM trends GROUP BY 1) USING (customer_id)""",
    ),
    "A8_first_seen_order": _sql(RISKS, "SELECT customer_id, pos FROM findings"),
    "A9_run_counts": _sql(
        RISKS,
        """SELECT 'findings' AS metric, count(*) AS value FROM findings
UNION ALL SELECT 'strategies', count(*) FROM strategies
UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'errors', 0""",
    ),
    "A10_risk_rollup": _sql(
        RISKS,
        """SELECT CASE WHEN grouping(risk_type) = 1 THEN 'ALL' ELSE risk_type END AS risk_type,
  CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE severity END AS severity,
  count(*) AS findings, round(avg(metric_value), 6) AS mean_metric
FROM findings GROUP BY ROLLUP (risk_type, severity)""",
    ),
    "A10_summaries": _sql(RISKS, f"{ORACLE_SUMMARY} UNION ALL {ORACLE_ADVICE}"),
    "W1_period_order": _sql(
        METRICS,
        f"SELECT customer_id, {_PERIOD}, quantity, coalesce(previous_quantity, -1) AS previous_quantity, coalesce(earlier_quantity, -1) AS earlier_quantity FROM trends",
    ),
    "W2_single_drop": _sql(METRICS, f"SELECT customer_id, {_PERIOD}, single_drop FROM trends"),
    "W3_two_period_drop": _sql(METRICS, f"SELECT customer_id, {_PERIOD}, two_drop FROM trends"),
    "W4_current_period": _sql(
        METRICS,
        "SELECT customer_id, periods, CAST(current_period AS VARCHAR) AS current_period,"
        " current_quantity, current_margin FROM metrics",
    ),
    "W5_growth_gap": _sql(
        METRICS,
        f"""SELECT customer_id, {_PERIOD},
  round((unit_cost / first_cost - 1) * 100e0, 6) AS cost_growth_pct,
  round((unit_price / first_price - 1) * 100e0, 6) AS price_growth_pct,
  round((unit_cost / first_cost - unit_price / first_price) * 100e0, 6) AS growth_gap
FROM trends JOIN (SELECT customer_id, first_price, first_cost FROM metrics) USING (customer_id)""",
    ),
    "R1_churn": _sql(RISKS, "SELECT customer_id, two_period_drop, max_single_drop, churn FROM typed"),
    "R2_margin": _sql(RISKS, "SELECT customer_id, current_margin, growth_gap, margin FROM typed"),
    "R3_risk_type": _sql(RISKS, "SELECT customer_id, coalesce(risk_type, 'NONE') AS risk_type FROM typed"),
    "R3_latest_drop_scope": _sql(
        f"{METRICS},\n{class_ctes('last_drop')}",
        "SELECT customer_id, risk_type, severity, metric_value FROM graded",
    ),
    "R3_category_grain": _sql(
        f"{SALES},\n{metric_ctes('customer_name, category', 'sales')},\n{class_ctes()}",
        "SELECT customer_name, category, coalesce(risk_type, 'NONE') AS risk_type FROM typed",
    ),
    "R3_filled_months": _sql(
        f"{SALES},\n{metric_ctes('customer_name', 'sales', 'month', fill=True)},\n{class_ctes()}",
        "SELECT customer_name, periods, coalesce(risk_type, 'NONE') AS risk_type FROM typed",
    ),
    "R4_severity": _sql(RISKS, "SELECT customer_id, severity FROM findings"),
    "R5_metric_value": _sql(RISKS, "SELECT customer_id, metric_value FROM findings"),
    "R6_evidence": _sql(RISKS, "SELECT customer_id, evidence FROM findings"),
    "R7_strategies": _sql(
        RISKS,
        f"SELECT customer_id, strategy_title, rationale, array_to_string(action_steps, {NL}) AS action_steps"
        " FROM strategies",
    ),
    "R8_priority": _sql(RISKS, "SELECT customer_id, priority FROM strategies"),
    "R9_drafts": _sql(RISKS, "SELECT customer_id, channel, subject, body, tone FROM messages"),
    "R10_length_check": _sql(
        RISKS,
        """SELECT customer_id, channel, CAST(words AS INTEGER) AS words,
  CASE channel WHEN 'EMAIL' THEN words BETWEEN 150 AND 250 ELSE words BETWEEN 60 AND 100 END AS length_ok
FROM (SELECT *, len(regexp_split_to_array(trim(body), '\\s+')) AS words FROM messages)""",
    ),
    "R11_routing": _sql(
        RISKS,
        "SELECT customer_id, CASE severity WHEN 'LOW' THEN 'AUTO' ELSE 'REVIEW' END AS queue FROM findings",
    ),
    "J1_cards": _sql(
        ALL,
        "SELECT customer_id, risk_type, severity, metric_value, priority, strategy_title, body FROM cards",
    ),
    "J2_named_inbox": _sql(
        ALL,
        f"""SELECT customer_id, name AS customer_name, {_named('evidence')} AS evidence, strategy_title,
  {_named('rationale')} AS rationale,
  {_named(f'array_to_string(action_steps, {NL})')} AS action_steps,
  {_named('body')} AS body, {_LINK.format(_named('body'))} AS share_link
FROM cards JOIN dict ON token = customer_id""",
    ),
    "J3_coverage": _sql(
        RISKS,
        """SELECT * FROM (
  SELECT customer_id, risk_type, findings, strategies, emails, chats, concat_ws(',',
    CASE WHEN strategies < findings THEN 'STRATEGY_MISSING' END,
    CASE WHEN strategies > findings THEN 'STRATEGY_EXTRA' END,
    CASE WHEN emails < strategies THEN 'EMAIL_MISSING' END,
    CASE WHEN strategies > 0 AND emails > strategies THEN 'EMAIL_EXTRA' END,
    CASE WHEN chats < strategies THEN 'WHATSAPP_MISSING' END,
    CASE WHEN strategies > 0 AND chats > strategies THEN 'WHATSAPP_EXTRA' END,
    CASE WHEN strategies = 0 AND emails + chats > 0 THEN 'MESSAGE_ORPHAN' END) AS problems
  FROM (SELECT customer_id, risk_type, CAST(1 AS BIGINT) AS findings,
      CAST(CASE WHEN severity = 'CRITICAL' THEN 2 WHEN risk_type = 'MARGIN_RISK' THEN 0 ELSE 1 END AS BIGINT) AS strategies,
      CAST(1 AS BIGINT) AS emails,
      CAST(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END AS BIGINT) AS chats
    FROM findings)) WHERE problems <> ''""",
    ),
    "J3_coverage_by_category": _sql(
        f"{BASE},\n{metric_ctes('customer_id, category', 'masked')},\n{class_ctes()}",
        """SELECT customer_id, category, risk_type, CAST(1 AS BIGINT) AS findings,
  CAST(CASE category WHEN 'PROMO' THEN 0 ELSE 2 END AS BIGINT) AS strategies,
  CAST(1 AS BIGINT) AS emails, CAST(1 AS BIGINT) AS chats,
  CASE category WHEN 'PROMO' THEN 'STRATEGY_MISSING,MESSAGE_ORPHAN'
    ELSE 'STRATEGY_EXTRA,EMAIL_MISSING,WHATSAPP_MISSING' END AS problems
FROM graded WHERE category IN ('PROMO', 'ECONOMY')""",
    ),
    "U3_failed_step": _sql(
        RISKS,
        """SELECT 'dictionary_and_metrics' AS output, count(*) AS rows FROM metrics
UNION ALL SELECT unnest(['findings', 'strategies', 'inbox', 'coverage EMAIL_MISSING', 'coverage WHATSAPP_MISSING']),
  (SELECT count(*) FROM findings)
UNION ALL SELECT 'messages', 0 UNION ALL SELECT 'messages STEP_FAILED', 1""",
    ),
    "U1_accumulate": _sql(
        RISKS,
        """SELECT customer_id, pos, 'findings' AS step FROM findings
UNION ALL SELECT customer_id, pos, 'strategies' FROM strategies
UNION ALL SELECT customer_id, pos, 'messages' FROM messages""",
    ),
    "U2_last_write": _sql(
        METRICS, "SELECT customer_id, arg_max(quantity, period) AS quantity FROM totals GROUP BY 1"
    ),
    "U3_errors": _sql(
        f"{RISKS},\n{DIRTY},\n{EARLY}",
        """SELECT step, reason, count(*) AS rows, count(DISTINCT key) AS keys FROM (
  SELECT 'load' AS step, CAST(customer_key AS VARCHAR) AS key, unnest(string_split(reasons, ',')) AS reason
  FROM judged WHERE reasons <> ''
  UNION ALL
  SELECT 'findings', customer_id, unnest(CASE
      WHEN severity = 'MEDIUM' THEN ['MISSING_evidence', 'TYPE_metric_value']
      WHEN risk_type = 'MARGIN_RISK' THEN ['BROKEN_JSON']
      ELSE ['TYPE_customer_id', 'VALUE_severity'] END)
  FROM findings WHERE severity IN ('MEDIUM', 'LOW')
  UNION ALL
  SELECT 'unmask', CAST(token_no AS VARCHAR), 'UNKNOWN_TOKEN' FROM grown
  WHERE token_no > (SELECT max(token_no) FROM early))
GROUP BY 1, 2""",
    ),
    "O1_most_urgent": _sql(
        RISKS,
        """SELECT customer_id, severity, metric_value FROM findings
ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC,
  metric_value DESC, customer_id LIMIT 25""",
    ),
    "V1_findings": _sql(
        RISKS,
        "SELECT customer_id AS key, customer_id, risk_type, severity, evidence, metric_value"
        " FROM findings WHERE severity IN ('CRITICAL', 'HIGH')",
    ),
    "V1_rejected_findings": _sql(
        RISKS,
        """SELECT customer_id AS key, CASE
  WHEN severity = 'MEDIUM' THEN 'MISSING_evidence,TYPE_metric_value'
  WHEN risk_type = 'MARGIN_RISK' THEN 'BROKEN_JSON'
  ELSE 'TYPE_customer_id,VALUE_severity' END AS reasons
FROM findings WHERE severity IN ('MEDIUM', 'LOW')""",
    ),
    "V1_strategies": _sql(
        RISKS,
        """SELECT customer_id AS key,
  CASE WHEN sound THEN strategy_title ELSE '' END AS strategy_title,
  CASE WHEN sound THEN CAST(len(action_steps) AS INTEGER) ELSE 0 END AS steps,
  CASE WHEN sound THEN '' ELSE 'TYPE_action_steps' END AS reasons
FROM (SELECT *, true AS sound FROM strategies
  UNION ALL SELECT * REPLACE ('bad/' || customer_id AS customer_id), false FROM strategies)""",
    ),
    "V1_messages": _sql(
        RISKS, "SELECT pos AS key, customer_id, channel, subject, body, tone FROM messages"
    ),
    "V2_reports": _sql(
        RISKS,
        """SELECT customer_id AS key, CAST(CASE WHEN sound THEN 0 ELSE -1 END AS INTEGER) AS item_no,
  CASE WHEN sound THEN severity ELSE '' END AS severity, CASE WHEN sound THEN metric_value ELSE 0 END AS metric_value,
  CASE WHEN sound THEN risk_type ELSE '' END AS summary,
  CASE WHEN sound THEN '' WHEN severity = 'HIGH' THEN 'BROKEN_JSON' WHEN severity = 'MEDIUM' THEN 'TYPE_findings'
    ELSE 'MISSING_summary' END AS reasons
FROM (SELECT *, true AS sound FROM findings
  UNION ALL SELECT * REPLACE ('bad/' || customer_id AS customer_id), false FROM findings)""",
    ),
    "V3_token_check": _sql(
        f"{SALES},\n{EARLY}",
        "SELECT 'CUSTOMER_' || token_no AS customer_id, 'UNKNOWN_TOKEN' AS reason, count(*) AS rows"
        " FROM sales JOIN grown ON name = customer_name"
        " WHERE token_no > (SELECT max(token_no) FROM early) GROUP BY 1",
    ),
    "ST1_risk_monitor": _sql(
        f"{RISKS}",
        "SELECT name AS customer_name, risk_type, severity, metric_value"
        " FROM findings JOIN dict ON token = customer_id",
    ),
    "ST1_silent_customers": _sql(
        f"{SALES},\n{metric_ctes('customer_name', 'sales', 'month', fill=True)},\n{class_ctes()}",
        "SELECT customer_name, periods, coalesce(risk_type, 'NONE') AS risk_type FROM typed",
    ),
    "ST1_live_inbox": _sql(
        ALL,
        f"""SELECT name AS customer_name, {_named('evidence')} AS evidence, strategy_title,
  {_named('rationale')} AS rationale, {_named(f'array_to_string(action_steps, {NL})')} AS action_steps,
  {_named('body')} AS body, {_LINK.format(_named('body'))} AS share_link
FROM cards JOIN dict ON token = customer_id""",
    ),
    "ST2_count_once": (
        "SELECT event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1"
    ),
}
