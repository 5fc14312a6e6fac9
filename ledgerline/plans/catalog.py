"""Registered queries over the driver tables and their DuckDB oracles.

Every query reads whole tables (no id subsets, no row caps); a LIMIT appears
only where it is the feature (a keyset page, a top-n report).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import contract as C
from ledgerline.functions.csvfields import is_complete_record, raw_fields, unquote
from ledgerline.operators import analytics as AN
from ledgerline.operators import ladder
from ledgerline.operators import ledger as LG
from ledgerline.operators import metrics as M
from ledgerline.operators import pages as PG
from ledgerline.operators.sink import first_wins, new_rows
from ledgerline.plans import derived as D

PAGE = 100


def iso(c):
    """`Instant.toString`-style UTC text (fraction only when non-zero)."""
    col = F.col(c) if isinstance(c, str) else c
    frac = F.unix_micros(col) % 1000000
    return F.when(frac == 0, F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss."),
                 F.regexp_replace(F.lpad(frac.cast("string"), 6, "0"), "(000)+$", ""), F.lit("Z")))


SQL_ISO = ("(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN 'Z' ELSE "
           "'.' || regexp_replace(lpad(CAST(epoch_us({c}) % 1000000 AS VARCHAR), 6, '0'), '(000)+$', '') || 'Z' END)")


def sql_iso(c: str) -> str:
    return SQL_ISO.format(c=c)


# --------------------------------------------------------------------------- SQL building blocks
SQL_ORDER_FACTS = """SELECT o_orderstatus AS import_id, o_orderkey + 1 AS id, o_orderkey + 2 AS source_row,
  'ord-' || CAST(o_orderkey AS VARCHAR) AS transaction_id, o_orderdate AS occurred_at,
  CAST(o_totalprice AS DECIMAL(19,2)) AS amount, o_orderpriority AS category FROM orders"""

SQL_REFUND_FACTS = """SELECT l_linestatus AS import_id, l_returnflag AS category, l_shipdate AS occurred_at,
  CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(19,2))
       ELSE CAST(l_extendedprice AS DECIMAL(19,2)) END AS amount FROM lineitem"""


def sql_analytics(facts_sql: str, imports_sql: str | None = None, key: str = "import_id") -> str:
    """Totals, categories and months as three plain GROUP BYs. With
    ``imports_sql`` its imports without facts have a zero total."""
    ids = imports_sql or f"SELECT DISTINCT {key} FROM ({facts_sql})"
    return f"""WITH f AS ({facts_sql}), ids AS ({ids})
SELECT {key}, 'TOTAL' AS aggregation_type, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS month,
  CAST(count(f.amount) AS BIGINT) AS transaction_count, CAST(coalesce(sum(f.amount), 0) AS DECIMAL(38,2)) AS total_amount
FROM ids LEFT JOIN f USING ({key}) GROUP BY {key}
UNION ALL
SELECT {key}, 'CATEGORY', category, NULL, CAST(count(*) AS BIGINT), CAST(sum(amount) AS DECIMAL(38,2))
FROM f GROUP BY {key}, category
UNION ALL
SELECT {key}, 'MONTH', NULL, strftime(occurred_at, '%Y-%m'), CAST(count(*) AS BIGINT), CAST(sum(amount) AS DECIMAL(38,2))
FROM f GROUP BY {key}, strftime(occurred_at, '%Y-%m')"""


SQL_CUSTOMER_FACTS = ("SELECT CAST(o_custkey AS VARCHAR) AS import_id, o_orderpriority AS category, "
                      "o_orderdate AS occurred_at, CAST(o_totalprice AS DECIMAL(19,2)) AS amount FROM orders")
# every customer is an import, and has a second one that never got a row
SQL_CUSTOMERS = ("SELECT CAST(c_custkey AS VARCHAR) AS import_id FROM customer "
                 "UNION ALL SELECT 'none-' || CAST(c_custkey AS VARCHAR) FROM customer")

# The same raw fields as derived.order_fields, built in SQL.
SQL_ORDER_FIELDS = f"""SELECT o_orderstatus AS import_id, o_orderkey, o_orderkey + 2 AS source_row,
  o_orderkey % {D.CORRUPTION_MOD} AS k, o_orderdate, CAST(o_totalprice AS DECIMAL(19,2)) AS price,
  CASE o_orderkey % {D.CORRUPTION_MOD} WHEN 2 THEN '   '
       WHEN 3 THEN 'ord-' || CAST(o_orderkey AS VARCHAR) || '-' || repeat('x', 64)
       ELSE 'ord-' || CAST(o_orderkey AS VARCHAR) END AS f_tid,
  CASE o_orderkey % {D.CORRUPTION_MOD} WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || 'Z'
       WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+03:00'
       WHEN 12 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.5z'
       ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS f_ts,
  CASE o_orderkey % {D.CORRUPTION_MOD} WHEN 6 THEN 'n/a'
       WHEN 7 THEN CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS VARCHAR) || '0'
       WHEN 8 THEN '123456789012345678.90' WHEN 9 THEN '0.00'
       WHEN 13 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(19,2)) * 100 AS DECIMAL(19,0)) AS VARCHAR) || 'E-2'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS VARCHAR) END AS f_amt,
  CASE o_orderkey % {D.CORRUPTION_MOD} WHEN 10 THEN ''
       WHEN 11 THEN rpad(o_orderpriority, 101, '*')
       WHEN 14 THEN o_orderpriority || ', especial'
       WHEN 15 THEN o_orderpriority || chr(10) || 'second line'
       ELSE o_orderpriority END AS f_cat,
  CASE o_orderkey % {D.CORRUPTION_MOD} WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS nf
FROM orders"""

_REASON_CASE = "CASE error_code " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.ERROR_REASONS.items()) + " END"

SQL_LADDER = f"""WITH b AS ({SQL_ORDER_FIELDS}),
p AS (SELECT *,
  regexp_full_match(f_ts, '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt]\\d{{2}}:\\d{{2}}(:\\d{{2}}([.]\\d{{0,9}})?)?(Z|z|[+-]\\d{{2}}(:\\d{{2}}(:\\d{{2}})?)?)') AS ts_shape,
  regexp_extract(f_ts, '([Zz]|[+-][0-9:]+)$', 1) AS ts_off,
  try_strptime(substr(f_ts, 1, 10) || ' ' || substr(f_ts, 12, 5) || ':' ||
    CASE WHEN substr(f_ts, 17, 1) = ':' THEN substr(f_ts, 18, 2) ELSE '00' END, '%Y-%m-%d %H:%M:%S') AS ts_base,
  regexp_full_match(f_amt, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AS amt_ok,
  regexp_extract(f_amt, '^([+-]?)([0-9]*)([.]([0-9]*))?([eE]([+-]?[0-9]+))?$', 2) AS a_int,
  regexp_extract(f_amt, '^([+-]?)([0-9]*)([.]([0-9]*))?([eE]([+-]?[0-9]+))?$', 4) AS a_frac,
  regexp_extract(f_amt, '^([+-]?)([0-9]*)([.]([0-9]*))?([eE]([+-]?[0-9]+))?$', 6) AS a_exp
FROM b),
q AS (SELECT *, length(a_frac) - COALESCE(TRY_CAST(NULLIF(a_exp, '') AS BIGINT), 0) AS a_scale,
  length(ltrim(a_int || a_frac, '0')) AS a_digits FROM p),
c AS (SELECT *, CASE
  WHEN nf <> 4 THEN 'COLUMN_COUNT'
  WHEN regexp_full_match(f_tid, '\\s*') THEN 'TRANSACTION_ID_REQUIRED'
  WHEN length(f_tid) > 64 THEN 'TRANSACTION_ID_TOO_LONG'
  WHEN NOT (ts_shape AND ts_base IS NOT NULL AND substr(f_ts, 1, 4) <> '0000'
            AND regexp_full_match(ts_off, '[Zz]|[+-]((0\\d|1[0-7])(:[0-5]\\d(:[0-5]\\d)?)?|18(:00(:00)?)?)'))
    THEN 'OCCURRED_AT_INVALID'
  WHEN NOT regexp_full_match(ts_off, '[Zz]|[+-]00(:00){{0,2}}') THEN 'OCCURRED_AT_NOT_UTC'
  WHEN NOT amt_ok THEN 'AMOUNT_INVALID'
  WHEN a_scale <> 2 THEN 'AMOUNT_SCALE_INVALID'
  WHEN greatest(a_digits, 1) > 19 THEN 'AMOUNT_PRECISION_INVALID'
  WHEN a_digits = 0 THEN 'AMOUNT_ZERO'
  WHEN regexp_full_match(f_cat, '\\s*') THEN 'CATEGORY_REQUIRED'
  WHEN length(f_cat) > 100 THEN 'CATEGORY_TOO_LONG'
  END AS error_code FROM q)
SELECT import_id, source_row, o_orderkey, k, error_code, {_REASON_CASE} AS reason,
  f_tid AS transaction_id,
  CASE WHEN k = 12 THEN o_orderdate + INTERVAL 500 MILLISECOND ELSE o_orderdate END AS occurred_at,
  price AS amount, f_cat AS category
FROM c"""


# --------------------------------------------------------------------------- Spark builders
def _ladder_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Records built from orders, split and validated by the library."""
    rec = D.order_fields(spark, sf).select("import_id", "source_row", "o_orderkey",
                                           raw_fields(F.col("record")).alias("fields"))
    return ladder.classify(rec, "fields", quoted=True).drop("fields")


def q_analytics_grouping_sets(spark, sf):
    facts = D.order_facts(spark, sf)
    return AN.import_analytics(facts, facts.select("import_id").distinct())


def _customer_imports(spark, sf):
    """Every customer is an import, and has a second one that never got a row."""
    key = F.col("c_custkey").cast("string")
    return D.table(spark, sf, "customer").select(
        F.explode(F.array(key, F.concat(F.lit("none-"), key))).alias("import_id"))


def q_analytics_zero_filled(spark, sf):
    facts = D.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("import_id"), F.col("o_orderpriority").alias("category"),
        D.ts("o_orderdate").alias("occurred_at"), F.col("o_totalprice").cast("decimal(19,2)").alias("amount"))
    return AN.import_analytics(facts, _customer_imports(spark, sf))


def q_analytics_signed(spark, sf):
    facts = D.refund_facts(spark, sf)
    return AN.import_analytics(facts)


def q_analytics_sql_grouping_sets(spark, sf):
    facts = D.order_facts(spark, sf)
    return AN.import_analytics_sql(facts, facts.select("import_id").distinct())


def q_analytics_rollup_check(spark, sf):
    return AN.rollup_check(q_analytics_grouping_sets(spark, sf))


def q_analytics_ordered(spark, sf):
    """The served analytics, each row with its place."""
    return AN.canonical_order(AN.import_analytics(D.refund_facts(spark, sf)))


def q_failure_reasons(spark, sf):
    """The documents' texts as failure reasons."""
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", LG.bounded_failure_reason(F.col("text")).alias("failure_reason"))


def q_category_share(spark, sf):
    return AN.category_share(q_analytics_signed(spark, sf))


def q_month_magnitude_share(spark, sf):
    return AN.month_magnitude_share(q_analytics_signed(spark, sf))


def _page_cols(df):
    return df.select("import_id", "id", "source_row", "transaction_id", iso("occurred_at").alias("occurred_at"),
                     "amount", "category", "next_cursor")


def q_transactions_first_page(spark, sf):
    return _page_cols(PG.keyset_page(D.order_facts(spark, sf), "F", "id", PAGE, 0))


def q_transactions_deep_page(spark, sf):
    facts = D.order_facts(spark, sf)
    # the client holds the cursor: resolve it once (one scalar)
    cursor = M.percentile_disc(facts.filter(F.col("import_id") == "O"), [], "id", 0.9, "c").first()["c"]
    return _page_cols(PG.keyset_page(facts, "O", "id", PAGE, int(cursor)))


def q_transactions_first_pages_all(spark, sf):
    return _page_cols(PG.first_pages(D.order_facts(spark, sf), "id", PAGE, 0))


def q_errors_page(spark, sf):
    rej = ladder.rejected(_ladder_orders(spark, sf), ["import_id", "source_row"])
    return PG.keyset_page(rej, "F", "source_row", PAGE, 0)


def q_validate_ladder(spark, sf):
    return _ladder_orders(spark, sf).select("import_id", "source_row", "error_code")


def q_accepted_rows(spark, sf):
    a = ladder.accepted(_ladder_orders(spark, sf), ["import_id", "source_row"])
    return a.select("import_id", "source_row", "transaction_id", iso("occurred_at").alias("occurred_at"),
                    "amount", "category")


def q_rejected_rows(spark, sf):
    return ladder.rejected(_ladder_orders(spark, sf), ["import_id", "source_row"])


def q_import_counts(spark, sf):
    c = _ladder_orders(spark, sf)
    return c.groupBy("import_id").agg(
        F.count_if(F.col("error_code").isNull()).alias("accepted_rows"),
        F.count_if(F.col("error_code").isNotNull()).alias("rejected_rows"),
        F.count("*").alias("processed_rows"))


def q_terminal_status(spark, sf):
    """A8 over the ladder counts of each import (no structural failure here)."""
    c = q_import_counts(spark, sf)
    return c.select("import_id", LG.terminal_status(F.col("rejected_rows"), F.lit(False)).alias("status"))


def q_error_code_counts(spark, sf):
    c = _ladder_orders(spark, sf).filter(F.col("error_code").isNotNull())
    return c.groupBy("import_id", "error_code").agg(F.count("*").alias("n"))


def _batch(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", D.ts("l_shipdate").alias("l_shipdate"))


def q_idempotent_insert(spark, sf):
    b = _batch(spark, sf)
    w = first_wins(b, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return w.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
                    iso("l_shipdate").alias("l_shipdate"))


def q_replay_counts(spark, sf):
    """First delivery: items shipped before 1998; redelivery: everything.
    Counters count rows actually inserted per delivery."""
    b = _batch(spark, sf)
    key = ["l_orderkey", "l_linenumber"]
    first = first_wins(b.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")), key, ["l_shipdate"])
    again = new_rows(first_wins(b, key, ["l_shipdate"]), first, key)
    c1 = first.groupBy("l_linestatus").agg(F.count("*").alias("inserted_first"))
    c2 = again.groupBy("l_linestatus").agg(F.count("*").alias("inserted_replay"))
    out = c1.join(c2, "l_linestatus", "full_outer")
    return out.select(F.col("l_linestatus").alias("import_id"),
                      F.coalesce("inserted_first", F.lit(0)).cast("long").alias("inserted_first"),
                      F.coalesce("inserted_replay", F.lit(0)).cast("long").alias("inserted_replay"),
                      (F.coalesce("inserted_first", F.lit(0)) + F.coalesce("inserted_replay", F.lit(0))).cast("long").alias("stored"))


def _jobs(spark, sf):
    return LG.current_jobs(D.job_events(spark, sf))


def q_import_status(spark, sf):
    return LG.status_view(_jobs(spark, sf)).drop("original_filename")


def q_completion_reconcile(spark, sf):
    li = D.table(spark, sf, "lineitem")
    o = D.table(spark, sf, "orders").filter(F.col("o_orderstatus") != "O")
    scan = (li.join(o, li.l_orderkey == o.o_orderkey, "left_semi")
            .groupBy(F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("import_id"))
            .agg(F.count_if(F.col("l_returnflag") != "R").alias("accepted_rows"),
                 F.count_if(F.col("l_returnflag") == "R").alias("rejected_rows")))
    return LG.completion_reconcile(_jobs(spark, sf), scan)


def q_stalled_imports(spark, sf):
    jobs = _jobs(spark, sf)
    now = D.table(spark, sf, "orders").agg(F.max(D.ts("o_orderdate")).alias("m")).first()["m"]
    out = LG.stalled_imports(jobs, F.lit(now), 30 * 86400, PAGE)
    return out.select("import_id", "status", iso("created_at").alias("created_at"),
                      iso("updated_at").alias("updated_at"))


def q_run_outcomes(spark, sf):
    jobs = _jobs(spark, sf).withColumn(
        "seconds", (F.unix_micros("updated_at") - F.unix_micros("created_at")) / F.lit(1e6))
    out = LG.outcome_metrics(jobs, "status", "seconds")
    return out.select(F.col("status").alias("outcome"), F.col("runs").cast("long").alias("runs"),
                      F.col("total_seconds").cast("double").alias("total_seconds"))


def q_throughput(spark, sf):
    t = LG.throughput(_jobs(spark, sf))
    return t.select("import_id", F.col("processed_rows").cast("long").alias("processed_rows"),
                    "seconds", "rows_per_second")


def q_ledger_audit(spark, sf):
    return LG.ledger_audit(_jobs(spark, sf)).select("import_id", "status", "consistent",
                                                   F.array_join("violations", ",").alias("violations"))


def q_record_audit(spark, sf):
    facts = D.order_facts(spark, sf)
    rej = ladder.rejected(_ladder_orders(spark, sf), ["import_id", "source_row"])
    # the ledger knows P under another name: its rows are orphans
    imports = D.table(spark, sf, "orders").select(
        F.regexp_replace("o_orderstatus", "P", "renamed").alias("import_id"))
    return LG.record_audit(facts, rej, imports)


def q_orphan_rows(spark, sf):
    # every fifth order names a customer that does not exist
    key = F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    o = D.table(spark, sf, "orders").select("o_orderkey", key.alias("o_custkey"))
    parent = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return LG.orphan_rows(o, parent, "o_custkey")


def q_existence_gate(spark, sf):
    """J1 for many imports: the rows of a known import (maybe none), null for an unknown one."""
    jobs = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("import_id"))
    rows = (D.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("import_id"))
            .agg(F.count("*").alias("n")))
    found = PG.existence(jobs, _customer_imports(spark, sf)).join(rows, "import_id", "left")
    return found.select("import_id", "known", F.when(F.col("known"), F.coalesce("n", F.lit(0))).alias("n_rows"))


def q_page_trimmed(spark, sf):
    """Stored texts are padded, a page shows them trimmed."""
    facts = D.order_facts(spark, sf)
    padded = facts.withColumns({c: F.concat(F.lit(" \t"), F.col(c), F.lit("\r\n ")) for c in ("transaction_id", "category")})
    return _page_cols(PG.import_page(facts, padded, "F", "id", PAGE, 0))


QUOTED_MAX = 4000


def q_quoted_field_lengths(spark, sf):
    """Quoted categories of 1 to 4000 characters, a third with
    escaped quotes and a third with line breaks."""
    o, key = D.table(spark, sf, "orders"), F.col("o_orderkey")
    n = (key % QUOTED_MAX + 1).cast("int")
    unit = F.element_at(F.array(F.lit("x"), F.lit('a"'), F.lit("b\n")), (key % 3 + 1).cast("int"))
    cat = F.substring(F.repeat(unit, n), F.lit(1), n)
    record = F.concat(F.lit("ord-"), key.cast("string"), F.lit(",2025-01-01T00:00:00Z,1.00,\""),
                      F.replace(cat, F.lit('"'), F.lit('""')), F.lit('"'))
    rec = o.select("o_orderkey", record.alias("record")).select(
        "o_orderkey", is_complete_record(F.col("record")).alias("complete"), raw_fields(F.col("record")).alias("fields"))
    return ladder.classify(rec.withColumn("text", unquote(F.get("fields", 3))), "fields", quoted=True).select(
        "o_orderkey", "complete", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "error_code")


def q_zero_filled_imports(spark, sf):
    a = q_analytics_zero_filled(spark, sf).filter(F.col("aggregation_type") == AN.TOTAL)
    return a.select("import_id", "transaction_count", "total_amount")


def q_latency_summary(spark, sf):
    ev = D.table(spark, sf, "events").select(F.col("event_type").alias("query"), F.col("value").alias("ms"))
    return M.latency_summary(ev, ["query"], "ms")


def q_deep_cursor_p90(spark, sf):
    p = M.percentile_disc(D.order_facts(spark, sf), ["import_id"], "id", 0.9, "p90_id")
    return p.select("import_id", F.col("p90_id").cast("long").alias("p90_id"))


def q_peak_by_group(spark, sf):
    ev = D.table(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("value"))
    return M.peak_by_group(ev, ["service"], "value", "peak")


def q_ledger_transitions(spark, sf):
    return LG.transition_audit(D.job_events(spark, sf)).select(
        "import_id", F.col("status_events").cast("long").alias("status_events"),
        F.col("illegal_steps").cast("long").alias("illegal_steps"), "first_illegal")


def q_snapshot_labels(spark, sf):
    jobs = _jobs(spark, sf)
    return jobs.select("import_id", "status", LG.snapshot_label(F.col("status")).alias("snapshot"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "analytics_grouping_sets": q_analytics_grouping_sets,
    "analytics_sql_grouping_sets": q_analytics_sql_grouping_sets,
    "analytics_zero_filled": q_analytics_zero_filled,
    "analytics_signed": q_analytics_signed,
    "analytics_rollup_check": q_analytics_rollup_check,
    "category_share": q_category_share,
    "month_magnitude_share": q_month_magnitude_share,
    "transactions_first_page": q_transactions_first_page,
    "transactions_deep_page": q_transactions_deep_page,
    "transactions_first_pages_all": q_transactions_first_pages_all,
    "errors_page": q_errors_page,
    "validate_ladder": q_validate_ladder,
    "accepted_rows": q_accepted_rows,
    "rejected_rows": q_rejected_rows,
    "import_counts": q_import_counts,
    "error_code_counts": q_error_code_counts,
    "terminal_status": q_terminal_status,
    "idempotent_insert": q_idempotent_insert,
    "replay_counts": q_replay_counts,
    "import_status": q_import_status,
    "completion_reconcile": q_completion_reconcile,
    "stalled_imports": q_stalled_imports,
    "run_outcomes": q_run_outcomes,
    "throughput": q_throughput,
    "ledger_audit": q_ledger_audit,
    "record_audit": q_record_audit,
    "orphan_rows": q_orphan_rows,
    "zero_filled_imports": q_zero_filled_imports,
    "existence_gate": q_existence_gate,
    "page_trimmed": q_page_trimmed,
    "quoted_field_lengths": q_quoted_field_lengths,
    "latency_summary": q_latency_summary,
    "analytics_ordered": q_analytics_ordered,
    "failure_reasons": q_failure_reasons,
    "deep_cursor_p90": q_deep_cursor_p90,
    "peak_by_group": q_peak_by_group,
    "snapshot_labels": q_snapshot_labels,
    "ledger_transitions": q_ledger_transitions,
}
