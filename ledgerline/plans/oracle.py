"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from ledgerline import contract as C
from ledgerline.plans.catalog import (PAGE, QUOTED_MAX, SQL_CUSTOMER_FACTS, SQL_CUSTOMERS, SQL_LADDER, SQL_ORDER_FACTS,
                                      SQL_REFUND_FACTS, sql_analytics, sql_iso)

A_ORDERS = sql_analytics(SQL_ORDER_FACTS)
A_SIGNED = sql_analytics(SQL_REFUND_FACTS)
A_ZERO = sql_analytics(SQL_CUSTOMER_FACTS, SQL_CUSTOMERS)


def _page(source: str, where: str, key: str, cols: str) -> str:
    return f"""WITH f AS ({source}),
p AS (SELECT * FROM f WHERE {where} ORDER BY {key} LIMIT {PAGE + 1}),
r AS (SELECT *, row_number() OVER (ORDER BY {key}) AS rn, count(*) OVER () AS n FROM p)
SELECT {cols}, CAST(CASE WHEN n > {PAGE} THEN max(CASE WHEN rn <= {PAGE} THEN {key} END) OVER () END AS BIGINT)
  AS next_cursor
FROM r QUALIFY rn <= {PAGE}"""


PAGE_COLS = f"import_id, id, source_row, transaction_id, {sql_iso('occurred_at')} AS occurred_at, amount, category"

SQL_JOBS = f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate AS d FROM orders),
li AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS acc,
         count(*) FILTER (WHERE l_returnflag = 'R') AS rej, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
j AS (SELECT 'job-' || CAST(o.o_orderkey AS VARCHAR) AS import_id, o.o_orderstatus,
  CASE WHEN o_orderstatus = 'O' THEN '{C.QUEUED}' WHEN o_orderstatus = 'P' OR li.n IS NULL THEN '{C.PROCESSING}'
       WHEN li.rej = 0 THEN '{C.COMPLETED}' ELSE '{C.COMPLETED_WITH_ERRORS}' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE COALESCE(li.acc, 0) END AS accepted_rows,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE COALESCE(li.rej, 0) END AS rejected_rows,
  d AS created_at, d + INTERVAL 1 HOUR AS queued_at,
  CASE WHEN o_orderstatus <> 'O' THEN d + INTERVAL 2 HOUR END AS started_at,
  CASE WHEN o_orderstatus = 'F' AND li.n IS NOT NULL THEN greatest(li.last_ship, d + INTERVAL 2 HOUR) END AS finished_at,
  CASE WHEN o_orderstatus = 'O' THEN d + INTERVAL 1 HOUR
       ELSE greatest(COALESCE(li.last_ship, d), d + INTERVAL 2 HOUR) END AS updated_at,
  CAST(NULL AS VARCHAR) AS failure_reason
FROM o LEFT JOIN li ON li.l_orderkey = o.o_orderkey)
SELECT * FROM j"""

TERMINAL = "('" + "', '".join(C.TERMINAL_STATUSES) + "')"

# stated anew, so that the oracle does not follow the code under test
LEGAL_SQL = """(prev = 'RECEIVED' AND status IN ('QUEUED', 'FAILED')) OR (prev = 'QUEUED' AND status IN ('PROCESSING', 'FAILED'))
  OR (prev = 'PROCESSING' AND status IN ('PROCESSING', 'COMPLETED', 'COMPLETED_WITH_ERRORS', 'FAILED'))"""

SQL_AUDIT_RULES = f"""
  CASE WHEN NOT (updated_at >= created_at AND (queued_at IS NULL OR queued_at >= created_at)
    AND (started_at IS NULL OR (queued_at IS NOT NULL AND started_at >= queued_at))
    AND (finished_at IS NULL OR finished_at >= COALESCE(started_at, queued_at, created_at))
    AND updated_at >= COALESCE(started_at, queued_at, created_at)) THEN 'timestamps_ordered' END AS r1,
  CASE WHEN NOT COALESCE(
    (status = 'RECEIVED' AND updated_at = created_at AND queued_at IS NULL AND started_at IS NULL
       AND finished_at IS NULL AND failure_reason IS NULL AND accepted_rows = 0 AND rejected_rows = 0)
    OR (status = 'QUEUED' AND queued_at IS NOT NULL AND updated_at = queued_at AND started_at IS NULL
       AND finished_at IS NULL AND failure_reason IS NULL AND accepted_rows = 0 AND rejected_rows = 0)
    OR (status = 'PROCESSING' AND queued_at IS NOT NULL AND started_at IS NOT NULL AND updated_at >= started_at
       AND finished_at IS NULL AND failure_reason IS NULL)
    OR (status = 'COMPLETED' AND queued_at IS NOT NULL AND started_at IS NOT NULL AND finished_at IS NOT NULL
       AND updated_at = finished_at AND failure_reason IS NULL AND rejected_rows = 0)
    OR (status = 'COMPLETED_WITH_ERRORS' AND queued_at IS NOT NULL AND started_at IS NOT NULL
       AND finished_at IS NOT NULL AND updated_at = finished_at AND failure_reason IS NULL AND rejected_rows > 0)
    OR (status = 'FAILED' AND finished_at IS NOT NULL AND updated_at = finished_at AND failure_reason IS NOT NULL
       AND trim(failure_reason) <> ''), FALSE) THEN 'state_consistent' END AS r2"""

FIRST_WINS_ORDER = ("l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
                    "l_returnflag, l_linestatus")

from ledgerline.plans.files import FILE_ORACLE  # noqa: E402

ORACLE: dict[str, str] = {
    **FILE_ORACLE,
    "analytics_grouping_sets": A_ORDERS,
    "analytics_sql_grouping_sets": A_ORDERS,
    "analytics_zero_filled": A_ZERO,
    "analytics_signed": A_SIGNED,
    "analytics_rollup_check": f"""WITH a AS ({A_ORDERS}),
g AS (SELECT import_id,
  SUM(CASE WHEN aggregation_type = 'TOTAL' THEN transaction_count END) AS total_count,
  SUM(CASE WHEN aggregation_type = 'TOTAL' THEN total_amount END) AS total_amount,
  COALESCE(SUM(CASE WHEN aggregation_type = 'CATEGORY' THEN transaction_count END), 0) AS category_count,
  COALESCE(SUM(CASE WHEN aggregation_type = 'CATEGORY' THEN total_amount END), 0) AS category_amount,
  COALESCE(SUM(CASE WHEN aggregation_type = 'MONTH' THEN transaction_count END), 0) AS month_count,
  COALESCE(SUM(CASE WHEN aggregation_type = 'MONTH' THEN total_amount END), 0) AS month_amount,
  count(*) FILTER (WHERE aggregation_type <> 'TOTAL' AND transaction_count < 1) AS empty_groups,
  count(*) FILTER (WHERE aggregation_type = 'TOTAL') AS total_rows
FROM a GROUP BY import_id)
SELECT import_id, CAST(total_count AS BIGINT) AS total_count, CAST(total_amount AS DECIMAL(38,2)) AS total_amount,
  CAST(category_count AS BIGINT) AS category_count, CAST(category_amount AS DECIMAL(38,2)) AS category_amount,
  CAST(month_count AS BIGINT) AS month_count, CAST(month_amount AS DECIMAL(38,2)) AS month_amount,
  (total_rows = 1 AND category_count = total_count AND month_count = total_count
   AND category_amount = total_amount AND month_amount = total_amount AND empty_groups = 0) AS consistent
FROM g""",
    "analytics_ordered": f"""SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY
  CASE aggregation_type WHEN 'TOTAL' THEN 0 WHEN 'CATEGORY' THEN 1 ELSE 2 END, category NULLS FIRST, month NULLS FIRST) AS position
FROM ({A_SIGNED})""",
    # white space as Java has it, stated anew
    "failure_reasons": r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text,
    '^[\t-\r\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+', ''),
    '[\t-\r\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+$', '') AS t FROM documents)
SELECT doc_id, CASE WHEN t IS NULL OR t = '' THEN 'Ingestion failed without a reported reason.' ELSE left(t, 1000) END AS failure_reason
FROM s""",
    "category_share": f"""WITH a AS ({A_SIGNED})
SELECT import_id, category, transaction_count,
  CASE WHEN max(transaction_count) OVER (PARTITION BY import_id) = 0 THEN 0.0
       ELSE CAST(transaction_count AS DOUBLE) * 100.0 / CAST(max(transaction_count) OVER (PARTITION BY import_id) AS DOUBLE)
  END AS share_of_max
FROM a WHERE aggregation_type = 'CATEGORY'""",
    "month_magnitude_share": f"""WITH a AS ({A_SIGNED}),
m AS (SELECT *, abs(CAST(total_amount AS DOUBLE)) AS mag FROM a WHERE aggregation_type = 'MONTH')
SELECT import_id, month, total_amount,
  CASE WHEN max(mag) OVER (PARTITION BY import_id) = 0 THEN 0.0
       ELSE mag * 100.0 / max(mag) OVER (PARTITION BY import_id) END AS magnitude_share,
  total_amount < 0 AS negative
FROM m""",
    "transactions_first_page": _page(SQL_ORDER_FACTS, "import_id = 'F' AND id > 0", "id", PAGE_COLS),
    "transactions_deep_page": _page(
        SQL_ORDER_FACTS,
        "import_id = 'O' AND id > (SELECT quantile_disc(id, 0.9) FROM (" + SQL_ORDER_FACTS + ") WHERE import_id = 'O')",
        "id", PAGE_COLS),
    "transactions_first_pages_all": f"""WITH f AS ({SQL_ORDER_FACTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY id) AS rn FROM f WHERE id > 0)
SELECT {PAGE_COLS}, CAST(CASE WHEN max(rn) OVER (PARTITION BY import_id) > {PAGE}
  THEN max(CASE WHEN rn <= {PAGE} THEN id END) OVER (PARTITION BY import_id) END AS BIGINT) AS next_cursor
FROM r WHERE rn <= {PAGE + 1} QUALIFY rn <= {PAGE}""",
    "errors_page": _page(f"SELECT * FROM ({SQL_LADDER}) WHERE error_code IS NOT NULL",
                         "import_id = 'F' AND source_row > 0", "source_row",
                         "import_id, source_row, error_code, reason"),
    "validate_ladder": f"SELECT import_id, source_row, error_code FROM ({SQL_LADDER})",
    "accepted_rows": f"""SELECT import_id, source_row, transaction_id, {sql_iso('occurred_at')} AS occurred_at,
  amount, category FROM ({SQL_LADDER}) WHERE error_code IS NULL""",
    "rejected_rows": f"SELECT import_id, source_row, error_code, reason FROM ({SQL_LADDER}) WHERE error_code IS NOT NULL",
    "import_counts": f"""SELECT import_id, count(*) FILTER (WHERE error_code IS NULL) AS accepted_rows,
  count(*) FILTER (WHERE error_code IS NOT NULL) AS rejected_rows, count(*) AS processed_rows
FROM ({SQL_LADDER}) GROUP BY import_id""",
    "terminal_status": f"""SELECT import_id, CASE WHEN count(*) FILTER (WHERE error_code IS NOT NULL) = 0
  THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END AS status FROM ({SQL_LADDER}) GROUP BY import_id""",
    "error_code_counts": f"""SELECT import_id, error_code, count(*) AS n FROM ({SQL_LADDER})
WHERE error_code IS NOT NULL GROUP BY import_id, error_code""",
    "idempotent_insert": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
  {sql_iso('l_shipdate')} AS l_shipdate
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {FIRST_WINS_ORDER}) = 1""",
    "replay_counts": f"""WITH w AS (SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY {FIRST_WINS_ORDER}) = 1),
f AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY {FIRST_WINS_ORDER}) = 1),
r AS (SELECT * FROM w ANTI JOIN f USING (l_orderkey, l_linenumber)),
c1 AS (SELECT l_linestatus, count(*) AS n FROM f GROUP BY 1),
c2 AS (SELECT l_linestatus, count(*) AS n FROM r GROUP BY 1)
SELECT COALESCE(c1.l_linestatus, c2.l_linestatus) AS import_id, CAST(COALESCE(c1.n, 0) AS BIGINT) AS inserted_first,
  CAST(COALESCE(c2.n, 0) AS BIGINT) AS inserted_replay, CAST(COALESCE(c1.n, 0) + COALESCE(c2.n, 0) AS BIGINT) AS stored
FROM c1 FULL OUTER JOIN c2 ON c1.l_linestatus = c2.l_linestatus""",
    "import_status": f"""WITH j AS ({SQL_JOBS})
SELECT import_id, status, CAST(accepted_rows + rejected_rows AS BIGINT) AS processed_rows,
  CAST(accepted_rows AS BIGINT) AS accepted_rows, CAST(rejected_rows AS BIGINT) AS rejected_rows,
  status IN {TERMINAL} AS terminal,
  {sql_iso('created_at')} AS created_at, {sql_iso('queued_at')} AS queued_at, {sql_iso('started_at')} AS started_at,
  {sql_iso('finished_at')} AS finished_at, {sql_iso('updated_at')} AS updated_at, failure_reason
FROM j""",
    "completion_reconcile": f"""WITH j AS ({SQL_JOBS}),
s AS (SELECT 'job-' || CAST(l_orderkey AS VARCHAR) AS import_id,
        count(*) FILTER (WHERE l_returnflag <> 'R') AS scan_accepted,
        count(*) FILTER (WHERE l_returnflag = 'R') AS scan_rejected
      FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') o
        ON lineitem.l_orderkey = o.o_orderkey GROUP BY 1)
SELECT COALESCE(j.import_id, s.import_id) AS import_id,
  CAST(COALESCE(accepted_rows, 0) AS BIGINT) AS accepted_rows, CAST(COALESCE(rejected_rows, 0) AS BIGINT) AS rejected_rows,
  CAST(COALESCE(scan_accepted, 0) AS BIGINT) AS scan_accepted, CAST(COALESCE(scan_rejected, 0) AS BIGINT) AS scan_rejected,
  (COALESCE(accepted_rows, 0) = COALESCE(scan_accepted, 0) AND COALESCE(rejected_rows, 0) = COALESCE(scan_rejected, 0))
    AS reconciled
FROM j FULL OUTER JOIN s ON j.import_id = s.import_id""",
    "stalled_imports": f"""WITH j AS ({SQL_JOBS})
SELECT import_id, status, {sql_iso('created_at')} AS created_at, {sql_iso('updated_at')} AS updated_at
FROM j WHERE status NOT IN {TERMINAL}
  AND updated_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
ORDER BY COALESCE(started_at, queued_at, created_at), import_id LIMIT {PAGE}""",
    "run_outcomes": f"""WITH j AS ({SQL_JOBS})
SELECT status AS outcome, CAST(count(*) AS BIGINT) AS runs,
  CAST(sum((epoch_us(updated_at) - epoch_us(created_at)) / 1e6) AS DOUBLE) AS total_seconds
FROM j GROUP BY status""",
    "throughput": f"""WITH j AS ({SQL_JOBS}),
t AS (SELECT import_id, accepted_rows + rejected_rows AS processed_rows,
        (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS seconds FROM j)
SELECT import_id, CAST(processed_rows AS BIGINT) AS processed_rows, seconds,
  CASE WHEN seconds > 0 THEN processed_rows / seconds END AS rows_per_second FROM t""",
    "ledger_audit": f"""WITH j AS ({SQL_JOBS}), r AS (SELECT import_id, status, {SQL_AUDIT_RULES} FROM j)
SELECT import_id, status, (r1 IS NULL AND r2 IS NULL) AS consistent, concat_ws(',', r1, r2) AS violations FROM r""",
    "record_audit": f"""WITH f AS ({SQL_ORDER_FACTS}),
e AS (SELECT * FROM ({SQL_LADDER}) WHERE error_code IS NOT NULL),
ids AS (SELECT import_id FROM f UNION SELECT import_id FROM e),
t AS (SELECT import_id, count(*) AS transactions, count(*) FILTER (WHERE source_row < 2) AS bad_source_row,
        count(*) FILTER (WHERE trim(transaction_id) = '') AS blank_transaction_id,
        count(*) FILTER (WHERE trim(category) = '') AS blank_category,
        count(*) FILTER (WHERE amount = 0) AS zero_amount FROM f GROUP BY 1),
d AS (SELECT import_id, count(*) AS duplicate_keys FROM (SELECT import_id, source_row FROM f GROUP BY 1, 2
        HAVING count(*) > 1) GROUP BY 1),
ee AS (SELECT import_id, count(*) AS errors, count(*) FILTER (WHERE source_row < 2 OR trim(error_code) = ''
        OR trim(reason) = '') AS bad_errors FROM e GROUP BY 1)
SELECT ids.import_id,
  CAST(COALESCE(transactions, 0) AS BIGINT) AS transactions, CAST(COALESCE(bad_source_row, 0) AS BIGINT) AS bad_source_row,
  CAST(COALESCE(blank_transaction_id, 0) AS BIGINT) AS blank_transaction_id,
  CAST(COALESCE(blank_category, 0) AS BIGINT) AS blank_category, CAST(COALESCE(zero_amount, 0) AS BIGINT) AS zero_amount,
  CAST(COALESCE(duplicate_keys, 0) AS BIGINT) AS duplicate_keys, CAST(COALESCE(errors, 0) AS BIGINT) AS errors,
  CAST(COALESCE(bad_errors, 0) AS BIGINT) AS bad_errors, ids.import_id = 'P' AS orphan
FROM ids LEFT JOIN t USING (import_id) LEFT JOIN d USING (import_id) LEFT JOIN ee USING (import_id)""",
    "orphan_rows": """SELECT o_orderkey, k AS o_custkey FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS k FROM orders)
WHERE k NOT IN (SELECT c_custkey FROM customer)""",
    "existence_gate": f"""SELECT i.import_id, c.c_custkey IS NOT NULL AS known,
  CASE WHEN c.c_custkey IS NOT NULL THEN (SELECT count(*) FROM orders WHERE o_custkey = c.c_custkey) END AS n_rows
FROM ({SQL_CUSTOMERS}) i LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = i.import_id""",
    "page_trimmed": _page(SQL_ORDER_FACTS, "import_id = 'F' AND id > 0", "id", PAGE_COLS),
    "quoted_field_lengths": f"""WITH t AS (SELECT o_orderkey, o_orderkey % {QUOTED_MAX} + 1 AS n,
  rpad('', CAST(o_orderkey % {QUOTED_MAX} + 1 AS INTEGER),
       CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'a"' ELSE 'b' || chr(10) END) AS text FROM orders)
SELECT o_orderkey, TRUE AS complete, CAST(n AS BIGINT) AS n_chars, md5(text) AS digest,
  CASE WHEN n > 100 THEN 'CATEGORY_TOO_LONG' END AS error_code FROM t""",
    "zero_filled_imports": f"SELECT import_id, transaction_count, total_amount FROM ({A_ZERO}) WHERE aggregation_type = 'TOTAL'",
    "latency_summary": """SELECT event_type AS query, CAST(count(value) AS BIGINT) AS samples, round(min(value), 3) AS min_ms,
  round(quantile_cont(value, 0.5), 3) AS p50_ms, round(quantile_disc(value, 0.95), 3) AS p95_ms,
  round(max(value), 3) AS max_ms FROM events GROUP BY event_type""",
    "deep_cursor_p90": f"SELECT import_id, quantile_disc(id, 0.9) AS p90_id FROM ({SQL_ORDER_FACTS}) GROUP BY import_id",
    "peak_by_group": "SELECT event_type AS service, max(value) AS peak FROM events GROUP BY event_type",
    "ledger_transitions": f"""WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders),
li AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS rej FROM lineitem GROUP BY 1),
ev AS (
  SELECT 'job-' || CAST(o_orderkey AS VARCHAR) AS import_id, 1 AS seq, 'RECEIVED' AS status FROM o
  UNION ALL SELECT 'job-' || CAST(o_orderkey AS VARCHAR), 2, 'QUEUED' FROM o
  UNION ALL SELECT 'job-' || CAST(o_orderkey AS VARCHAR), 3, 'PROCESSING' FROM o WHERE o_orderstatus <> 'O'
  UNION ALL SELECT 'job-' || CAST(o.o_orderkey AS VARCHAR), 1000,
    CASE WHEN li.rej = 0 THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END
    FROM o JOIN li ON li.l_orderkey = o.o_orderkey WHERE o_orderstatus = 'F'),
s AS (SELECT *, lag(status) OVER (PARTITION BY import_id ORDER BY seq) AS prev FROM ev),
k AS (SELECT *, CASE WHEN prev IS NULL THEN status = 'RECEIVED' ELSE ({LEGAL_SQL}) END AS ok FROM s)
SELECT import_id, CAST(count(*) AS BIGINT) AS status_events,
  CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS illegal_steps,
  arg_min(CASE WHEN NOT ok THEN COALESCE(prev, 'START') || '->' || status END, CASE WHEN NOT ok THEN seq END)
    AS first_illegal
FROM k GROUP BY import_id""",
    "snapshot_labels": f"""WITH j AS ({SQL_JOBS})
SELECT import_id, status, CASE WHEN status IN ('COMPLETED', 'COMPLETED_WITH_ERRORS') THEN 'final'
  WHEN status = 'FAILED' THEN 'before_failure' ELSE 'partial' END AS snapshot FROM j""",
}
