"""DuckDB oracles for the registered queries.

The shared CTE chain derives the roll, the attempts, their validation, the
journal (with reversals, exonerations and closed Januaries) and the parcel
status from the driver's ``orders``, ``customer`` and ``lineitem`` views,
written independently in SQL.  Each key appends its own CTEs and a final
SELECT; money is cast to DOUBLE at the edge, as the Spark side does.
"""

from __future__ import annotations

PCOLS = ["parcel_id", "owner_name", "property_address", "mailing_address", "bill_number",
         "assessment_value", "homestead_exclusion", "farmstead_exclusion", "face_tax_amount",
         "discount_amount", "penalty_amount", "tax_type", "bill_issue_date",
         "is_installment_plan", "is_interim", "status"]
JCOLS = ["transaction_id", "date_received", "postmark_date", "parcel_id", "transaction_type",
         "payment_method", "check_number", "amount_paid", "balance_remaining", "payment_period",
         "installment_number", "deposit_batch_id", "is_closed", "image_path", "notes",
         "validation_code", "reversed_transaction_id"]

AS_OF = "DATE '2000-06-30'"
RUN_TS = "2025-07-01T09:30:00"
DEFAULT_ISSUE = "DATE '2025-03-01'"
NL = "chr(10)"


def cols(names, alias=None):
    return ", ".join(f"{alias}.{n}" if alias else n for n in names)


def dend(d):
    return f"(CAST({d} + INTERVAL 2 MONTH AS DATE) - 1)"


def fend(d):
    return f"(CAST({d} + INTERVAL 4 MONTH AS DATE) - 1)"


def iss(d="bill_issue_date"):
    return f"COALESCE({d}, {DEFAULT_ISSUE})"


def dbl(x):
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def money_txt(x):
    return f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"


def fix2(x):
    return f"printf('%.2f', CAST({x} AS DOUBLE))"


def edge(sql, money):
    """Wrap a query so that money columns leave as DOUBLE."""
    if not money:
        return sql
    rep = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in money)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) edge_q"


def message_sql(semantics="literal"):
    if semantics == "literal":
        over = dbl("amount - expected_amount")
        under = dbl("expected_amount - amount")
        inst = "CAST(COALESCE(NULLIF(installment_num, 0), 1) AS VARCHAR)"
        pen = "COALESCE(CAST(installment_num AS VARCHAR), 'None')"
    else:
        over = fix2("amount - expected_amount")
        under = fix2("expected_amount - amount")
        inst = "CAST(COALESCE(installment_num, 1) AS VARCHAR)"
        pen = inst
    return f"""CASE validation_code
      WHEN 'ACCEPTED_FULL' THEN 'Exact Match (Full Payment)'
      WHEN 'REJECTED_INSTALLMENT_LATE' THEN 'Installment plan invalid during Penalty Period. Full penalty amount required.'
      WHEN 'ACCEPTED_INSTALLMENT' THEN 'Exact Match (Installment ' || {inst} || ')'
      WHEN 'ACCEPTED_INSTALLMENT_PENALTY' THEN 'Exact Match (Penalty Installment ' || {pen} || ')'
      WHEN 'REJECTED_OVER' THEN 'OVERPAYMENT of $' || {over} || '. Do not deposit. Issue Refund/Return Check.'
      ELSE 'UNDERPAYMENT of $' || {under} || '. Exact amount required or valid installment.' END"""


def validate_ctes(prefix, source):
    """CTEs ``{prefix}_v`` validating attempts in ``source`` against ``roll``."""
    return f""",
{prefix}_a AS (
  SELECT a.seq, a.parcel_id, a.amount, a.date, a.check_number, a.installment_num,
         r.face_tax_amount, r.discount_amount, r.penalty_amount, r.bill_issue_date,
         r.is_installment_plan,
         CASE WHEN a.date <= {dend(iss('r.bill_issue_date'))} THEN 'DISCOUNT'
              WHEN a.date <= {fend(iss('r.bill_issue_date'))} THEN 'FACE'
              ELSE 'PENALTY' END AS payment_period,
         CAST(round(r.face_tax_amount / 3, 2) AS DECIMAL(18,2)) AS inst
  FROM {source} a JOIN roll r ON a.parcel_id = r.parcel_id),
{prefix}_b AS (
  SELECT *, CASE payment_period WHEN 'DISCOUNT' THEN discount_amount
                                WHEN 'FACE' THEN face_tax_amount
                                ELSE penalty_amount END AS expected_amount
  FROM {prefix}_a),
{prefix}_c AS (
  SELECT *, CASE
      WHEN amount = expected_amount THEN 'ACCEPTED_FULL'
      WHEN COALESCE(is_installment_plan, false) AND payment_period = 'PENALTY'
           AND (installment_num IS NULL OR installment_num = 1) THEN 'REJECTED_INSTALLMENT_LATE'
      WHEN COALESCE(is_installment_plan, false) AND amount = inst THEN 'ACCEPTED_INSTALLMENT'
      WHEN COALESCE(is_installment_plan, false)
           AND amount = CAST(round(inst * 1.10, 2) AS DECIMAL(18,2)) THEN 'ACCEPTED_INSTALLMENT_PENALTY'
      WHEN amount > expected_amount THEN 'REJECTED_OVER'
      ELSE 'REJECTED_UNDER' END AS validation_code
  FROM {prefix}_b),
{prefix}_v AS (
  SELECT *, starts_with(validation_code, 'ACCEPTED') AS is_valid,
         {message_sql('literal')} AS message,
         {message_sql('corrected')} AS message_corrected
  FROM {prefix}_c)"""


def posted_cte(name, src, method=None, keep_inst=True, prefix="Rejected: "):
    meth = f"'{method}'" if method else "CASE WHEN check_number = 'CASH' THEN 'CASH' ELSE 'CHECK' END"
    inst = "installment_num" if keep_inst else "NULL"
    return f""",
{name} AS (
  SELECT seq AS transaction_id, date AS date_received, date AS postmark_date, parcel_id,
         CASE WHEN is_valid THEN 'PAYMENT' ELSE 'REJECTED_PAYMENT' END AS transaction_type,
         {meth} AS payment_method, check_number,
         CAST(amount AS DECIMAL(18,2)) AS amount_paid,
         CAST(CASE WHEN is_valid THEN 0 ELSE face_tax_amount END AS DECIMAL(18,2)) AS balance_remaining,
         CASE WHEN is_valid THEN payment_period END AS payment_period,
         CAST(CASE WHEN is_valid THEN {inst} END AS INTEGER) AS installment_number,
         CAST(NULL AS BIGINT) AS deposit_batch_id, false AS is_closed,
         CAST(NULL AS VARCHAR) AS image_path,
         CASE WHEN NOT is_valid THEN '{prefix}' || message || ' (' || validation_code || ')' END AS notes,
         validation_code, CAST(NULL AS BIGINT) AS reversed_transaction_id
  FROM {src})"""


def nsf_cte(name, only_payments=True):
    cond = "WHERE p.transaction_type = 'PAYMENT'" if only_payments else ""
    return f""",
{name} AS (
  SELECT q.new_id AS transaction_id, q.rev_date AS date_received, q.rev_date AS postmark_date,
         p.parcel_id, 'NSF_REVERSAL' AS transaction_type, 'ADJUSTMENT' AS payment_method,
         p.check_number, CAST(-p.amount_paid AS DECIMAL(18,2)) AS amount_paid,
         p.amount_paid AS balance_remaining, p.payment_period, p.installment_number,
         CAST(NULL AS BIGINT) AS deposit_batch_id, false AS is_closed,
         CAST(NULL AS VARCHAR) AS image_path,
         'NSF Reversal for Trans ID ' || CAST(q.orig_id AS VARCHAR) AS notes,
         CAST(NULL AS VARCHAR) AS validation_code, q.orig_id AS reversed_transaction_id
  FROM nsfreq q JOIN posted p ON p.transaction_id = q.orig_id {cond})"""


BASE = f"""WITH
roll AS (
  SELECT 'P-' || CAST(o.o_orderkey AS VARCHAR) AS parcel_id,
         c.c_name AS owner_name,
         CAST(o.o_orderkey AS VARCHAR) || ' Main St' AS property_address,
         CASE WHEN o.o_orderkey % 7 = 0 THEN CAST(c.c_custkey AS VARCHAR) || ' Rental Ave'
              ELSE CAST(o.o_orderkey AS VARCHAR) || ' Main St' END AS mailing_address,
         'B' || CAST(o.o_orderkey AS VARCHAR) AS bill_number,
         CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS assessment_value,
         CAST(0 AS DECIMAL(18,2)) AS homestead_exclusion,
         CAST(0 AS DECIMAL(18,2)) AS farmstead_exclusion,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS face_tax_amount,
         CAST(round(CAST(o.o_totalprice AS DECIMAL(18,2)) * 0.98, 2) AS DECIMAL(18,2)) AS discount_amount,
         CAST(round(CAST(o.o_totalprice AS DECIMAL(18,2)) * 1.10, 2) AS DECIMAL(18,2)) AS penalty_amount,
         CASE o.o_orderkey % 10 WHEN 0 THEN 'Per Capita' WHEN 1 THEN 'Fire'
              ELSE 'Real Estate' END AS tax_type,
         CAST(o.o_orderdate AS DATE) AS bill_issue_date,
         o.o_orderstatus = 'P' AS is_installment_plan,
         o.o_orderkey % 50 = 0 AS is_interim,
         'UNPAID' AS status,
         o.o_orderkey AS okey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
li AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
           l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax,
           l_returnflag, l_linestatus) AS rn
  FROM lineitem l),
att0 AS (
  SELECT li.l_orderkey * 1000 + li.rn AS seq, r.parcel_id, li.rn, li.l_suppkey,
         (li.l_orderkey + li.rn) % 8 AS k,
         CAST(r.bill_issue_date + CAST(li.l_partkey % 240 AS INTEGER) AS DATE) AS date,
         r.face_tax_amount, r.discount_amount, r.penalty_amount, r.bill_issue_date
  FROM li JOIN roll r ON r.okey = li.l_orderkey),
att1 AS (
  SELECT *, CASE WHEN date <= {dend('bill_issue_date')} THEN discount_amount
                 WHEN date <= {fend('bill_issue_date')} THEN face_tax_amount
                 ELSE penalty_amount END AS asked,
         CAST(round(face_tax_amount / 3, 2) AS DECIMAL(18,2)) AS third
  FROM att0),
attempts AS (
  SELECT seq, parcel_id,
         CAST(CASE WHEN k IN (0, 1) THEN asked WHEN k = 2 THEN asked - 0.01
                   WHEN k = 3 THEN asked + 10 WHEN k IN (4, 5, 7) THEN third
                   ELSE round(third * 1.10, 2) END AS DECIMAL(18,2)) AS amount,
         date,
         CASE WHEN rn % 3 = 0 THEN 'CASH' ELSE CAST(l_suppkey AS VARCHAR) END AS check_number,
         CAST(CASE k WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 END AS INTEGER) AS installment_num
  FROM att1){validate_ctes('val', 'attempts')}{posted_cte('posted', 'val_v')},
nsfreq AS (
  SELECT seq + 500 AS new_id, seq AS orig_id, CAST(date + 10 AS DATE) AS rev_date
  FROM attempts WHERE seq % 97 = 0){nsf_cte('nsf')},
exon AS (
  SELECT r.okey * 1000 + 999 AS transaction_id,
         CAST(r.bill_issue_date + 180 AS DATE) AS date_received,
         CAST(r.bill_issue_date + 180 AS DATE) AS postmark_date, r.parcel_id,
         'EXONERATION' AS transaction_type, 'NONE' AS payment_method,
         CAST(NULL AS VARCHAR) AS check_number, r.face_tax_amount AS amount_paid,
         CAST(0 AS DECIMAL(18,2)) AS balance_remaining, CAST(NULL AS VARCHAR) AS payment_period,
         CAST(NULL AS INTEGER) AS installment_number, CAST(NULL AS BIGINT) AS deposit_batch_id,
         false AS is_closed, CAST(NULL AS VARCHAR) AS image_path,
         'Exonerated by order of the board' AS notes, CAST(NULL AS VARCHAR) AS validation_code,
         CAST(NULL AS BIGINT) AS reversed_transaction_id
  FROM roll r
  WHERE r.okey % 101 = 0 AND NOT EXISTS (
    SELECT 1 FROM posted p WHERE p.parcel_id = r.parcel_id AND p.transaction_type = 'PAYMENT')),
journal0 AS (
  SELECT {cols(JCOLS)} FROM posted UNION ALL SELECT {cols(JCOLS)} FROM nsf
  UNION ALL SELECT {cols(JCOLS)} FROM exon),
journal AS (
  SELECT * REPLACE (is_closed OR month(date_received) = 1 AS is_closed),
         CAST(date_trunc('month', date_received) AS DATE) AS receipt_month
  FROM journal0),
ev AS (
  SELECT parcel_id,
    arg_max(transaction_type, transaction_id) FILTER (
      WHERE transaction_type IN ('PAYMENT', 'EXONERATION', 'RETURN', 'NSF_REVERSAL')) AS last_event,
    arg_max(transaction_type, transaction_id) FILTER (
      WHERE transaction_type IN ('EXONERATION', 'RETURN', 'NSF_REVERSAL')) AS last_flag_event,
    CAST(COALESCE(SUM(amount_paid) FILTER (
      WHERE transaction_type IN ('PAYMENT', 'NSF_REVERSAL')), 0) AS DECIMAL(18,2)) AS net_paid,
    CAST(COALESCE(SUM(amount_paid) FILTER (
      WHERE transaction_type = 'EXONERATION'), 0) AS DECIMAL(18,2)) AS exonerated
  FROM journal GROUP BY parcel_id),
livefull AS (
  SELECT parcel_id, count(*) AS live_full FROM journal
  WHERE transaction_type = 'PAYMENT' AND validation_code = 'ACCEPTED_FULL'
    AND transaction_id NOT IN (
      SELECT reversed_transaction_id FROM journal WHERE transaction_type = 'NSF_REVERSAL')
  GROUP BY parcel_id),
parcels AS (
  SELECT {cols([c for c in PCOLS if c != 'status'], 'r')},
    CASE WHEN e.last_event = 'EXONERATION' THEN 'EXONERATED'
         WHEN e.last_event = 'RETURN' THEN 'RETURNED'
         WHEN COALESCE(f.live_full, 0) > 0
              OR COALESCE(e.net_paid, 0) >= r.face_tax_amount THEN 'PAID'
         WHEN COALESCE(e.net_paid, 0) > 0 THEN 'PARTIAL'
         ELSE 'UNPAID' END AS status,
    e.net_paid, e.exonerated, e.last_flag_event, r.okey
  FROM roll r LEFT JOIN ev e ON e.parcel_id = r.parcel_id
  LEFT JOIN livefull f ON f.parcel_id = r.parcel_id),
parcels_lit AS (
  SELECT r.*,
    CASE e.last_flag_event WHEN 'EXONERATION' THEN 'EXONERATED' WHEN 'RETURN' THEN 'RETURNED'
         WHEN 'NSF_REVERSAL' THEN 'UNPAID' ELSE COALESCE(r.status, 'UNPAID') END AS status_lit
  FROM roll r LEFT JOIN ev e ON e.parcel_id = r.parcel_id)"""

PMONEY = ["assessment_value", "homestead_exclusion", "farmstead_exclusion", "face_tax_amount",
          "discount_amount", "penalty_amount"]
JMONEY = ["amount_paid", "balance_remaining"]


def q(extra, final, money=()):
    return edge(BASE + extra + "\n" + final, list(money))


ORACLE: dict[str, str] = {}

ORACLE["scan_parcels"] = q("", f"SELECT {cols(PCOLS)} FROM parcels", PMONEY)
ORACLE["scan_journal"] = q("", f"SELECT {cols(JCOLS)}, receipt_month FROM journal", JMONEY)
ORACLE["read_roll"] = q("", f"""SELECT {cols([c for c in PCOLS if c not in ('is_interim', 'status')])},
  false AS is_interim, 'UNPAID' AS status FROM roll""", PMONEY)
ORACLE["bill_schedule"] = q("", f"""SELECT parcel_id, {iss()} AS bill_issue_date,
  {dend(iss())} AS discount_end, {fend(iss())} AS face_end, {fend(iss())} + 1 AS penalty_start
  FROM roll""")
ORACLE["installment_schedule"] = q("", f"""SELECT parcel_id, CAST(n AS INTEGER) AS installment_no,
  CAST(round(face_tax_amount / 3, 2) AS DECIMAL(18,2)) AS installment_amount,
  CASE WHEN n < 3 THEN 'By Face Deadline' ELSE 'By Penalty Start' END AS due_rule,
  CASE WHEN n < 3 THEN {fend(iss())} ELSE {fend(iss())} + 1 END AS due_date
  FROM roll, (VALUES (1), (2), (3)) t(n) WHERE COALESCE(is_installment_plan, false)""",
                                   ["installment_amount"])
ORACLE["payment_period"] = q("", """SELECT seq AS transaction_id, parcel_id, date AS postmark_date,
  bill_issue_date, payment_period FROM val_v""")
ORACLE["expected_amount"] = q("", """SELECT seq AS transaction_id, payment_period, expected_amount
  FROM val_v""", ["expected_amount"])
ORACLE["validate_payments"] = q("", """SELECT seq AS transaction_id, parcel_id, amount, payment_period,
  expected_amount, validation_code, is_valid FROM val_v""", ["amount", "expected_amount"])
ORACLE["validation_summary"] = q("", """SELECT validation_code, count(*) AS attempts,
  CAST(SUM(amount) AS DECIMAL(18,2)) AS amount_total FROM val_v GROUP BY validation_code""",
                                 ["amount_total"])
ORACLE["validation_messages"] = q("", """SELECT seq AS transaction_id, validation_code, message
  FROM val_v""")
ORACLE["validation_messages_corrected"] = q("", """SELECT seq AS transaction_id, validation_code,
  message_corrected AS message FROM val_v""")

_PERIOD_ON = f"""CASE WHEN {AS_OF} <= {dend(iss())} THEN 'DISCOUNT'
                      WHEN {AS_OF} <= {fend(iss())} THEN 'FACE' ELSE 'PENALTY' END"""
_DUE = f"""CASE WHEN status NOT IN ('PAID', 'EXONERATED', 'RETURNED') THEN
             CASE {_PERIOD_ON} WHEN 'DISCOUNT' THEN discount_amount WHEN 'FACE' THEN face_tax_amount
                  ELSE penalty_amount END END"""
_DUE_COLS = f"""CASE WHEN status NOT IN ('PAID', 'EXONERATED', 'RETURNED') THEN {_PERIOD_ON} END AS period_name,
  CAST({_DUE} AS DECIMAL(18,2)) AS amount_due,
  CASE WHEN status = 'PAID' THEN 'This bill has been PAID IN FULL. No further action is required.'
       WHEN status = 'EXONERATED' THEN 'This bill has been EXONERATED. No balance is due.'
       WHEN status = 'RETURNED' THEN 'This bill remains UNPAID and has been RETURNED to the County.'
       ELSE 'This bill is currently ' || status || '. We are in the ' || ({_PERIOD_ON}) || ' period.'
            || {NL} || 'The total amount due TODAY is ' || {money_txt(_DUE)} || '.' END AS status_message"""
ORACLE["amount_due"] = q("", f"SELECT parcel_id, status, {_DUE_COLS} FROM parcels", ["amount_due"])

ORACLE["post_payments"] = q("", f"SELECT {cols(JCOLS)} FROM posted", JMONEY)
ORACLE["unknown_parcels"] = q(",\n" + """orph AS (
  SELECT seq, CASE WHEN seq % 991 = 0 THEN 'X-' || CAST(seq AS VARCHAR) ELSE parcel_id END AS parcel_id,
         amount, date, check_number, installment_num FROM attempts)""",
                              "SELECT * FROM orph WHERE parcel_id NOT IN (SELECT parcel_id FROM roll)",
                              ["amount"])
ORACLE["undated_attempts"] = q("", """SELECT seq, parcel_id, amount, CAST(NULL AS DATE) AS date, check_number,
  installment_num FROM attempts WHERE seq % 89 = 0 AND parcel_id IN (SELECT parcel_id FROM roll)""", ["amount"])
ORACLE["post_payments_undated"] = q("", f"SELECT {cols(JCOLS)} FROM posted WHERE transaction_id % 89 <> 0", JMONEY)
ORACLE["record_payments"] = q("", """SELECT seq AS transaction_id, date AS date_received,
  CAST(NULL AS DATE) AS postmark_date, parcel_id, 'PAYMENT' AS transaction_type,
  CAST(NULL AS VARCHAR) AS payment_method, check_number, amount AS amount_paid,
  CAST(0 AS DECIMAL(18,2)) AS balance_remaining, CAST(NULL AS VARCHAR) AS payment_period,
  CAST(NULL AS INTEGER) AS installment_number, CAST(NULL AS BIGINT) AS deposit_batch_id,
  false AS is_closed, CAST(NULL AS VARCHAR) AS image_path, CAST(NULL AS VARCHAR) AS notes,
  CAST(NULL AS VARCHAR) AS validation_code, CAST(NULL AS BIGINT) AS reversed_transaction_id
  FROM attempts""", JMONEY)
ORACLE["exonerations"] = q("", f"SELECT {cols(JCOLS)} FROM exon", JMONEY)
ORACLE["nsf_reversals"] = q("", f"SELECT {cols(JCOLS)} FROM nsf", JMONEY)
ORACLE["nsf_reversals_literal"] = q(nsf_cte("nsf_lit", only_payments=False),
                                    f"SELECT {cols(JCOLS)} FROM nsf_lit", JMONEY)
ORACLE["close_month"] = q("", """SELECT transaction_id, date_received,
  month(date_received) = 1 AS is_closed FROM journal""")
ORACLE["close_month_counts"] = q(",\n" + """yrs AS (SELECT DISTINCT CAST(year(date_received) AS INTEGER) AS year FROM journal),
jan AS (SELECT CAST(year(date_received) AS INTEGER) AS year, count(*) AS rows_closed
        FROM journal WHERE month(date_received) = 1 GROUP BY 1)""",
                                 """SELECT y.year, 1 AS month, make_date(y.year, 1, 1) AS close_month,
  COALESCE(j.rows_closed, 0) AS rows_closed FROM yrs y LEFT JOIN jan j ON j.year = y.year""")
_LOCKS = ",\nlocks AS (SELECT DISTINCT receipt_month AS lock_month FROM journal WHERE is_closed)"
ORACLE["locked_months"] = q(_LOCKS, "SELECT lock_month FROM locks")
ORACLE["month_lock_refused"] = q(_LOCKS, f"""SELECT {cols(JCOLS)} FROM posted
  WHERE transaction_type <> 'REJECTED_PAYMENT'
    AND CAST(date_trunc('month', date_received) AS DATE) IN (SELECT lock_month FROM locks)""",
                                 JMONEY)
# The stream's attempts name an unknown parcel in every 991st row.
_LOCKED = "CAST(date_trunc('month', date_received) AS DATE) IN (SELECT lock_month FROM locks)"
ORACLE["stream_payments"] = q(_LOCKS, f"""SELECT {cols(JCOLS)} FROM posted
  WHERE transaction_id % 991 <> 0 AND (transaction_type = 'REJECTED_PAYMENT' OR NOT {_LOCKED})""",
                              JMONEY)
ORACLE["stream_refused"] = q(_LOCKS, f"""SELECT {cols(JCOLS)} FROM posted
  WHERE transaction_id % 991 <> 0 AND transaction_type <> 'REJECTED_PAYMENT' AND {_LOCKED}""", JMONEY)
ORACLE["stream_unknown"] = q("", """SELECT seq, 'X-' || CAST(seq AS VARCHAR) AS parcel_id, amount, date,
  check_number, installment_num FROM attempts WHERE seq % 991 = 0""", ["amount"])
ORACLE["stream_dedupe"] = q("", """SELECT DISTINCT parcel_id, check_number, amount, installment_num,
  CASE WHEN check_number = 'CASH' THEN seq END AS cash_seq FROM attempts""", ["amount"])
ORACLE["parcel_status"] = q("", "SELECT parcel_id, status, net_paid, exonerated FROM parcels",
                            ["net_paid", "exonerated"])
ORACLE["parcel_status_literal"] = q("", "SELECT parcel_id, status_lit AS status FROM parcels_lit")
ORACLE["running_balance"] = q("", """SELECT j.transaction_id, j.parcel_id, j.date_received,
  j.transaction_type, j.amount_paid,
  CAST(SUM(j.amount_paid) OVER (PARTITION BY j.parcel_id ORDER BY j.date_received, j.transaction_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS net_paid_to_date,
  CAST(r.face_tax_amount - SUM(j.amount_paid) OVER (PARTITION BY j.parcel_id
       ORDER BY j.date_received, j.transaction_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance_remaining
  FROM journal j LEFT JOIN roll r ON r.parcel_id = j.parcel_id
  WHERE j.transaction_type IN ('PAYMENT', 'NSF_REVERSAL')""",
                              ["amount_paid", "net_paid_to_date", "balance_remaining"])


def _upsert(literal):
    revised = {"owner_name": "CASE WHEN okey % 12 = 0 THEN upper(owner_name) || ', \"Jr\"' || chr(10) || 'Estate' "
                             "ELSE upper(owner_name) END",
               "face_tax_amount": "CAST(face_tax_amount + 1 AS DECIMAL(18,2))",
               "is_interim": "false" if literal else "is_interim",
               "status": "'UNPAID'" if literal else "status"}
    fresh = {"parcel_id": "'P-N' || CAST(okey AS VARCHAR)", "is_interim": "false",
             "status": "'UNPAID'"}
    rev_cols = ", ".join(f"{revised.get(c, c)} AS {c}" for c in PCOLS)
    fresh_cols = ", ".join(f"{fresh.get(c, c)} AS {c}" for c in PCOLS)
    return f"""SELECT {cols(PCOLS)} FROM parcels WHERE okey % 4 <> 0
UNION ALL
SELECT {rev_cols} FROM parcels WHERE okey % 4 = 0
UNION ALL
SELECT {fresh_cols} FROM parcels WHERE okey % 16 = 0"""


ORACLE["upsert_parcels"] = q("", f"SELECT {cols(PCOLS)} FROM ({_upsert(False)}) u", PMONEY)
ORACLE["upsert_parcels_literal"] = q("", f"SELECT {cols(PCOLS)} FROM ({_upsert(True)}) u", PMONEY)

_REQ = ",\n" + """req AS (
  SELECT 'P-' || CAST(okey * 2 AS VARCHAR) AS parcel_id, 'Interim ' || owner_name AS owner_name,
         CAST(okey * 2 AS VARCHAR) || ' New Rd' AS property_address, assessment_value,
         face_tax_amount, discount_amount, penalty_amount,
         CAST(bill_issue_date + 30 AS DATE) AS bill_issue_date, okey * 10 AS seq, okey * 2 AS k2
  FROM parcels WHERE okey % 9 = 0)"""
ORACLE["add_interim"] = q(_REQ, f"""SELECT {cols(PCOLS)} FROM parcels
UNION ALL
SELECT parcel_id, owner_name, property_address, property_address AS mailing_address,
       'INT-' || parcel_id AS bill_number, assessment_value,
       CAST(0 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)), face_tax_amount, discount_amount,
       penalty_amount, 'Real Estate', bill_issue_date, false, true, 'UNPAID'
FROM req WHERE parcel_id NOT IN (SELECT parcel_id FROM parcels)""", PMONEY)
ORACLE["interim_rejects"] = q(_REQ, """SELECT parcel_id, seq, 'already exists' AS reason FROM req
  WHERE parcel_id IN (SELECT parcel_id FROM parcels)
UNION ALL
SELECT parcel_id, seq + 1 AS seq, 'duplicate request' AS reason FROM req WHERE k2 % 4 = 0""")

_AFTER = ",\n" + f"""after AS (
  SELECT {cols([c for c in PCOLS if c not in ('owner_name', 'mailing_address')])},
    CASE WHEN okey % 13 = 0 AND okey % 2 = 0 THEN upper(owner_name) ELSE owner_name END AS owner_name,
    CASE WHEN okey % 13 = 0 AND okey % 3 = 0 THEN CAST(okey AS VARCHAR) || ' Lake Rd'
         ELSE mailing_address END AS mailing_address
  FROM parcels)"""
ORACLE["update_parcels"] = q(_AFTER, f"SELECT {cols(PCOLS)} FROM after", PMONEY)
ORACLE["update_rejects"] = q("", """SELECT parcel_id, okey AS seq, 'no field to update' AS reason
  FROM parcels WHERE okey % 13 = 0 AND okey % 2 <> 0 AND okey % 3 <> 0
UNION ALL
SELECT 'P-M' || CAST(okey AS VARCHAR), okey + 1, 'parcel not found' FROM parcels WHERE okey % 131 = 0""")
ORACLE["orphan_transactions"] = q("", """SELECT * EXCLUDE (receipt_month) REPLACE (
  'X-' || CAST(transaction_id AS VARCHAR) AS parcel_id) FROM journal
  WHERE transaction_id % 991 = 0""", JMONEY)

_DETAIL = ",\ndetail AS (SELECT j.*, p.tax_type FROM journal j JOIN parcels p ON p.parcel_id = j.parcel_id)"
_TYPES = "transaction_type IN ('PAYMENT', 'NSF_REVERSAL')"
ORACLE["monthly_detail"] = q(_DETAIL, f"SELECT {cols(JCOLS)}, tax_type, receipt_month FROM detail",
                             JMONEY)


def _summary(types):
    where = f"AND {types}" if types else ""
    return f"""SELECT receipt_month, tax_type, payment_period,
  CAST(SUM(amount_paid) AS DECIMAL(18,2)) AS amount FROM detail
  WHERE tax_type IS NOT NULL AND payment_period IS NOT NULL {where}
  GROUP BY receipt_month, tax_type, payment_period"""


ORACLE["monthly_summary"] = q(_DETAIL, _summary(_TYPES), ["amount"])
ORACLE["monthly_summary_literal"] = q(_DETAIL, _summary(None), ["amount"])
ORACLE["monthly_summary_rollup"] = q(_DETAIL, f"""SELECT receipt_month, tax_type, payment_period,
  CAST(SUM(amount_paid) AS DECIMAL(18,2)) AS amount FROM detail
  WHERE tax_type IS NOT NULL AND payment_period IS NOT NULL AND {_TYPES}
  GROUP BY GROUPING SETS ((receipt_month, tax_type, payment_period), (receipt_month, tax_type),
                          (receipt_month))""", ["amount"])


def _remit(types):
    where = f"WHERE {types}" if types else ""
    return _DETAIL + f""",
totals AS (SELECT receipt_month, tax_type, CAST(SUM(amount_paid) AS DECIMAL(18,2)) AS total
           FROM detail {where} GROUP BY receipt_month, tax_type),
rules(tax_type, recipient, share, bank_name, account_number) AS (VALUES
  ('Real Estate', 'township', CAST(0.80 AS DECIMAL(9,6)), 'Township General Fund', 'N/A'),
  ('Real Estate', 'county', CAST(0.15 AS DECIMAL(9,6)), 'County Tax Account', 'N/A'),
  ('Real Estate', 'school', CAST(0.05 AS DECIMAL(9,6)), 'School District', 'N/A'),
  ('Per Capita', 'township', CAST(0.50 AS DECIMAL(9,6)), 'Township General Fund', 'N/A'),
  ('Per Capita', 'school', CAST(0.50 AS DECIMAL(9,6)), 'School District', 'N/A'))"""


_REMIT_FINAL = """SELECT t.receipt_month, r.recipient, r.bank_name, r.account_number,
  CAST(SUM(t.total * r.share) AS DECIMAL(18,4)) AS amount
  FROM totals t JOIN rules r ON r.tax_type = t.tax_type
  GROUP BY t.receipt_month, r.recipient, r.bank_name, r.account_number
UNION ALL
SELECT receipt_month, 'UNALLOCATED', NULL, NULL, CAST(SUM(total) AS DECIMAL(18,4)) FROM totals
  WHERE tax_type NOT IN (SELECT tax_type FROM rules) GROUP BY receipt_month
UNION ALL
SELECT receipt_month, 'TOTAL COLLECTED', NULL, NULL, CAST(SUM(total) AS DECIMAL(18,4)) FROM totals
  GROUP BY receipt_month"""
ORACLE["remittance_advice"] = q(_remit(_TYPES), _REMIT_FINAL, ["amount"])
ORACLE["remittance_advice_literal"] = q(_remit(None), _REMIT_FINAL, ["amount"])
ORACLE["monthly_adjustments"] = q(_DETAIL, """SELECT receipt_month,
  CAST(COALESCE(SUM(CASE WHEN transaction_type = 'EXONERATION' THEN amount_paid END), 0) AS DECIMAL(18,2)) AS exonerations,
  CAST(COALESCE(SUM(CASE WHEN transaction_type = 'RETURN' THEN amount_paid END), 0) AS DECIMAL(18,2)) AS returns
  FROM detail GROUP BY receipt_month""", ["exonerations", "returns"])
ORACLE["return_list"] = q("", f"SELECT {cols(PCOLS)} FROM parcels WHERE status IN ('UNPAID', 'PARTIAL')",
                          PMONEY)
ORACLE["turnover_report"] = q("", """SELECT parcel_id, owner_name, property_address, 2025 AS tax_year,
  face_tax_amount AS face_tax, penalty_amount AS penalty,
  CAST(face_tax_amount + penalty_amount AS DECIMAL(18,2)) AS total_amount_due,
  penalty_amount AS penalty_only_due FROM parcels WHERE status IN ('UNPAID', 'PARTIAL')""",
                              ["face_tax", "penalty", "total_amount_due", "penalty_only_due"])

SMEASURES = ["original_face", "interim_face", "penalties_collected", "returned_penalty",
             "cash_collected", "discounts_allowed", "exonerations", "returned_face"]
_SFIN = """SELECT *, CAST(original_face + interim_face + penalties_collected + returned_penalty AS DECIMAL(18,2)) AS total_charges,
  CAST(cash_collected + discounts_allowed + exonerations + returned_face + returned_penalty AS DECIMAL(18,2)) AS total_credits,
  CAST((original_face + interim_face + penalties_collected + returned_penalty)
       - (cash_collected + discounts_allowed + exonerations + returned_face + returned_penalty) AS DECIMAL(18,2)) AS difference,
  abs((original_face + interim_face + penalties_collected + returned_penalty)
       - (cash_collected + discounts_allowed + exonerations + returned_face + returned_penalty)) < 0.02 AS balanced
  FROM {src}"""
_PP = ",\n" + """pp0 AS (SELECT parcel_id, status, face_tax_amount, penalty_amount,
    COALESCE(net_paid, 0) AS net, COALESCE(exonerated, 0) AS exon, COALESCE(is_interim, false) AS interim
  FROM parcels),
pp AS (SELECT parcel_id, status, face_tax_amount, net AS net_paid, exon AS exonerated,
    CASE WHEN NOT interim THEN face_tax_amount ELSE 0 END AS original_face,
    CASE WHEN interim THEN face_tax_amount ELSE 0 END AS interim_face,
    greatest(net - face_tax_amount, 0) AS penalties_collected,
    CASE WHEN status IN ('UNPAID', 'RETURNED') THEN penalty_amount ELSE 0 END AS returned_penalty,
    net AS cash_collected,
    CASE WHEN status = 'PAID' AND net < face_tax_amount THEN face_tax_amount - net ELSE 0 END AS discounts_allowed,
    exon AS exonerations,
    CASE WHEN status IN ('UNPAID', 'RETURNED') THEN face_tax_amount
         WHEN status = 'PARTIAL' THEN face_tax_amount - net ELSE 0 END AS returned_face
  FROM pp0),
sagg AS (SELECT """ + ", ".join(f"CAST(SUM({m}) AS DECIMAL(18,2)) AS {m}" for m in SMEASURES) + " FROM pp)"
_SMONEY = SMEASURES + ["total_charges", "total_credits", "difference"]
ORACLE["settlement"] = q(_PP, _SFIN.format(src="sagg"), _SMONEY)
ORACLE["settlement_exceptions"] = q(_PP, "SELECT parcel_id, status, face_tax_amount, net_paid, "
                                    "exonerated, total_charges, total_credits, difference FROM ("
                                    + _SFIN.format(src="pp") + ") x WHERE NOT balanced",
                                    ["face_tax_amount", "net_paid", "exonerated", "total_charges",
                                     "total_credits", "difference"])
ORACLE["settlement_literal"] = q(",\n" + """rl AS (SELECT
    CAST(COALESCE(SUM(CASE WHEN NOT COALESCE(is_interim, false) THEN face_tax_amount END), 0) AS DECIMAL(18,2)) AS original_face,
    CAST(COALESCE(SUM(CASE WHEN COALESCE(is_interim, false) THEN face_tax_amount END), 0) AS DECIMAL(18,2)) AS interim_face,
    CAST(COALESCE(SUM(CASE WHEN status_lit IN ('UNPAID', 'RETURNED') THEN penalty_amount END), 0) AS DECIMAL(18,2)) AS returned_penalty,
    CAST(COALESCE(SUM(CASE WHEN status_lit IN ('UNPAID', 'RETURNED') THEN face_tax_amount END), 0) AS DECIMAL(18,2)) AS returned_face
  FROM parcels_lit),
jl AS (SELECT
    CAST(COALESCE(SUM(CASE WHEN r.face_tax_amount IS NOT NULL AND j.transaction_type = 'PAYMENT'
      AND j.payment_period = 'PENALTY' THEN j.amount_paid - r.face_tax_amount END), 0) AS DECIMAL(18,2)) AS penalties_collected,
    CAST(COALESCE(SUM(CASE WHEN j.transaction_type = 'PAYMENT' THEN j.amount_paid END), 0) AS DECIMAL(18,2)) AS cash_collected,
    CAST(COALESCE(SUM(CASE WHEN r.face_tax_amount IS NOT NULL AND j.transaction_type = 'PAYMENT'
      AND j.payment_period = 'DISCOUNT' THEN r.face_tax_amount - j.amount_paid END), 0) AS DECIMAL(18,2)) AS discounts_allowed,
    CAST(COALESCE(SUM(CASE WHEN j.transaction_type = 'EXONERATION' THEN j.amount_paid END), 0) AS DECIMAL(18,2)) AS exonerations
  FROM journal j LEFT JOIN roll r ON r.parcel_id = j.parcel_id),
sagg AS (SELECT rl.*, jl.* FROM rl, jl)""", _SFIN.format(src="sagg"), _SMONEY)

ORACLE["deposit_slip"] = q("", """SELECT date_received, check_number, amount_paid, parcel_id, transaction_id
  FROM journal WHERE payment_method = 'CHECK' AND transaction_type <> 'REJECTED_PAYMENT'""",
                           ["amount_paid"])
ORACLE["deposit_totals"] = q("", """SELECT date_received, count(*) AS check_count,
  CAST(SUM(amount_paid) AS DECIMAL(18,2)) AS total_amount FROM journal
  WHERE payment_method = 'CHECK' AND transaction_type <> 'REJECTED_PAYMENT' GROUP BY date_received""",
                             ["total_amount"])
ORACLE["deposit_totals_literal"] = q("", """SELECT date_received, count(*) AS check_count,
  CAST(SUM(amount_paid) AS DECIMAL(18,2)) AS total_amount FROM journal
  WHERE payment_method = 'CHECK' GROUP BY date_received""", ["total_amount"])
ORACLE["mailing_labels"] = q("", """SELECT owner_name AS name, mailing_address AS address, parcel_id
  FROM parcels""")
ORACLE["label_sheet"] = q(",\n" + """lab AS (SELECT row_number() OVER (ORDER BY parcel_id) AS label_no, parcel_id,
    COALESCE(owner_name, 'Resident') AS name, COALESCE(mailing_address, '') AS address FROM parcels),
lab2 AS (SELECT *, (label_no - 1) % 30 AS within FROM lab)""", """SELECT label_no, parcel_id, name, address,
  CAST(floor((label_no - 1) / 30) + 1 AS INTEGER) AS page,
  CAST(floor(within / 3) AS INTEGER) AS label_row, CAST(within % 3 AS INTEGER) AS label_col,
  round(CAST(0.1875 + CAST(within % 3 AS INTEGER) * 2.75 + 0.1 AS DOUBLE), 4) AS x_in,
  round(CAST(9.7 - CAST(floor(within / 3) AS INTEGER) * 1.0 + 0.6 AS DOUBLE), 4) AS y_in
  FROM lab2""")

_RATE = ("CASE WHEN CAST({f} AS DOUBLE) > 0 THEN CAST({c} AS DOUBLE) / CAST({f} AS DOUBLE) * 100.0 "
         "ELSE 0.0 END")
ORACLE["status_kpis"] = q(",\n" + """k AS (SELECT
    (SELECT count(*) FROM parcels) AS total_parcels,
    (SELECT CAST(COALESCE(SUM(face_tax_amount), 0) AS DECIMAL(18,2)) FROM parcels) AS total_face_value,
    (SELECT CAST(COALESCE(SUM(amount_paid) FILTER (WHERE transaction_type = 'PAYMENT'), 0) AS DECIMAL(18,2)) FROM journal) AS total_collected,
    (SELECT CAST(COALESCE(SUM(amount_paid) FILTER (WHERE transaction_type IN ('PAYMENT', 'NSF_REVERSAL')), 0) AS DECIMAL(18,2)) FROM journal) AS net_collected)""",
                          "SELECT total_parcels, total_face_value, total_collected, net_collected, "
                          + _RATE.format(c="total_collected", f="total_face_value") + " AS collection_rate, "
                          + _RATE.format(c="net_collected", f="total_face_value") + " AS net_collection_rate FROM k",
                          ["total_face_value", "total_collected", "net_collected"])
ORACLE["status_breakdown"] = q("", "SELECT status, count(*) AS parcel_count FROM parcels GROUP BY status")
ORACLE["status_by_tax_type"] = q("", """SELECT p.tax_type, CAST(SUM(j.amount_paid) AS DECIMAL(18,2)) AS collected,
  count(DISTINCT j.parcel_id) AS parcels_paid FROM journal j JOIN parcels p ON p.parcel_id = j.parcel_id
  WHERE j.transaction_type = 'PAYMENT' GROUP BY p.tax_type""", ["collected"])
ORACLE["dashboard_kpis"] = q(",\n" + """k AS (SELECT
    (SELECT CAST(COALESCE(SUM(face_tax_amount), 0) AS DECIMAL(18,2)) FROM parcels) AS total_face_value,
    (SELECT count(*) FROM parcels) AS total_parcels,
    (SELECT count(*) FILTER (WHERE status = 'PAID') FROM parcels) AS paid_parcels,
    (SELECT CAST(COALESCE(SUM(amount_paid) FILTER (WHERE transaction_type = 'PAYMENT'), 0) AS DECIMAL(18,2)) FROM journal) AS total_collected)""",
                             "SELECT total_face_value, total_collected, "
                             + _RATE.format(c="total_collected", f="total_face_value")
                             + " AS collection_rate, total_parcels, paid_parcels, "
                             "CAST(total_face_value - total_collected AS DECIMAL(18,2)) AS outstanding_balance FROM k",
                             ["total_face_value", "total_collected", "outstanding_balance"])
ORACLE["dashboard_revenue"] = q("", """SELECT p.tax_type, CAST(SUM(j.amount_paid) AS DECIMAL(18,2)) AS amount_paid
  FROM journal j LEFT JOIN parcels p ON p.parcel_id = j.parcel_id
  WHERE p.tax_type IS NOT NULL GROUP BY p.tax_type""", ["amount_paid"])
ORACLE["recent_activity"] = q("", """SELECT date_received, parcel_id, transaction_type, amount_paid,
  payment_method, check_number, transaction_id FROM journal""", ["amount_paid"])
ORACLE["lookup"] = q(",\n" + """hit AS (SELECT * FROM parcels
  WHERE parcel_id = 'Customer#000000042' OR owner_name ILIKE '%Customer#000000042%'
  ORDER BY CASE WHEN parcel_id = 'Customer#000000042' THEN 0 ELSE 1 END, parcel_id LIMIT 1)""",
                     f"""SELECT {cols(PCOLS)}, {dend(iss())} AS discount_end, {fend(iss())} AS face_end,
  {fend(iss())} + 1 AS penalty_start,
  CASE WHEN COALESCE(is_installment_plan, false) THEN CAST(round(face_tax_amount / 3, 2) AS DECIMAL(18,2)) END AS installment_amount,
  {_DUE_COLS} FROM hit""", PMONEY + ["installment_amount", "amount_due"])
_NOTE = ("CASE WHEN check_number IS NOT NULL AND check_number <> '' AND check_number <> 'CASH' "
         "THEN 'Ck#' || check_number || ' ' || COALESCE(notes, '') ELSE COALESCE(notes, '') END")
ORACLE["parcel_history"] = q("", f"""SELECT parcel_id, transaction_id, date_received, transaction_type,
  COALESCE(payment_method, '-') AS payment_method, amount_paid, {_NOTE} AS note
  FROM journal WHERE parcel_id IN (SELECT parcel_id FROM roll)""", ["amount_paid"])


def _pyquote(x):
    return f"replace(replace(url_encode({x}), '%2F', '/'), '%7E', '~')"


_SUBJECT = "'Tax Inquiry - Parcel ' || parcel_id"
_BODY = ("'Hello Tax Collector,' || chr(10) || chr(10) || 'I am writing regarding Parcel ' || parcel_id "
         "|| '.' || chr(10) || chr(10) || 'Please assist me with:' || chr(10) || '[ ] Requesting a receipt' "
         "|| chr(10) || '[ ] Updating my mailing address' || chr(10) || '[ ] Question about my bill' "
         "|| chr(10) || chr(10) || 'My phone number is: _________________' || chr(10) || chr(10) "
         "|| 'Thank you,' || chr(10) || COALESCE(owner_name, 'None')")


def _bill(bill_type, literal):
    face_by = (f"strftime(CAST({iss()} + INTERVAL 2 MONTH AS DATE), '%b %d')" if literal
               else f"strftime({fend(iss())}, '%b %d')")
    return f"""SELECT '{bill_type}' AS bill_type, parcel_id, owner_name, mailing_address, property_address,
  bill_number, '$' || {fix2('assessment_value')} AS assessed_value_text,
  '$' || {fix2('discount_amount')} AS discount_text, '$' || {fix2('face_tax_amount')} AS face_text,
  '$' || {fix2('penalty_amount')} AS penalty_text,
  strftime({dend(iss())}, '%b %d') AS discount_by, {face_by} AS face_by,
  strftime(CAST({iss()} + INTERVAL 4 MONTH AS DATE), '%b %d') AS penalty_from,
  CASE WHEN COALESCE(is_installment_plan, false)
       THEN '$' || {fix2('CAST(round(face_tax_amount / 3, 2) AS DECIMAL(18,2))')} END AS installment_text,
  'mailto:collector@example.com?subject=' || {_pyquote(_SUBJECT)} || '&body=' || {_pyquote(_BODY)} AS mailto_link,
  '{bill_type}_' || parcel_id || '_Bill_2025-07.pdf' AS file_name
  FROM parcels"""


ORACLE["bill_run"] = q("", _bill("Township_County", False))
ORACLE["bill_run_literal"] = q("", _bill("School", True))
_EQ = "'" + "=" * 40 + "'"
ORACLE["receipts"] = q("", f"""SELECT j.transaction_id, j.parcel_id, j.date_received, j.amount_paid,
  'Receipt_' || j.parcel_id || '_' || CAST(j.transaction_id AS VARCHAR) || '.txt' AS file_name,
  concat_ws(chr(10), {_EQ}, 'OFFICIAL TAX RECEIPT - MUNICIPALITY NAME', {_EQ},
    'Date: 2025-07-01 09:30:00', 'Receipt #: ' || CAST(j.transaction_id AS VARCHAR), '',
    'Parcel ID:      ' || j.parcel_id, 'Owner:          ' || COALESCE(p.owner_name, 'None'),
    'Property:       ' || COALESCE(p.property_address, 'None'), '',
    'Amount Paid:    $' || {fix2('j.amount_paid')},
    'Payment Period: ' || COALESCE(j.payment_period, 'None'),
    'Check Number:   ' || COALESCE(j.check_number, 'None'), '',
    'Status: ' || p.status, {_EQ}, 'Tax Collector: Tax Collector Name') AS receipt_text
  FROM journal j JOIN parcels p ON p.parcel_id = j.parcel_id
  WHERE j.transaction_type = 'PAYMENT'""", ["amount_paid"])

_PLAIN = {
    "A": ("We noticed the check amount was less than the total due. By law, we are required to collect "
          "the exact amount listed on the tax bill and cannot accept partial payments. Because this check "
          "was for a lower amount, we are unable to process it and must return it to you."),
    "B": ("We noticed the check amount was higher than the total due. Since we cannot accept extra funds "
          "or issue change from the tax account, we must return this check to you. Please simply write a "
          "new check for the exact amount shown below."),
    "C": ("It appears this payment was intended for an installment plan or a previous discount period, but "
          "it arrived after the deadline. As a result, the amount due has changed. We have to return this "
          "check so you can issue a new one for the current amount."),
    "D": ("We are unable to process this payment as submitted. Please review the specific reason below and "
          "issue a new check for the correct amount. If you have any questions, please contact our office."),
}
ORACLE["rejection_letters"] = q(",\n" + """rj AS (SELECT j.transaction_id, j.parcel_id, j.amount_paid, j.check_number,
    j.date_received,
    CASE WHEN starts_with(j.notes, 'Rejected: ') THEN substr(j.notes, 11)
         WHEN starts_with(j.notes, 'Rejected (Ingest): ') THEN substr(j.notes, 20)
         ELSE j.notes END AS reason
  FROM journal j WHERE j.transaction_type = 'REJECTED_PAYMENT'),
rj2 AS (SELECT *, CASE WHEN contains(upper(reason), 'UNDERPAYMENT') THEN 'A'
    WHEN contains(upper(reason), 'OVERPAYMENT') THEN 'B'
    WHEN contains(upper(reason), 'INSTALLMENT') OR contains(upper(reason), 'LATE') THEN 'C'
    ELSE 'D' END AS k FROM rj)""", """SELECT r.transaction_id, r.parcel_id, p.owner_name, p.mailing_address,
  r.date_received, r.amount_paid AS attempted_amount, r.check_number, r.reason AS rejection_reason,
  r.k AS plain_reason_key, CASE r.k """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PLAIN.items())
                                + """ END AS plain_reason,
  p.discount_amount, p.face_tax_amount, p.penalty_amount
  FROM rj2 r JOIN parcels p ON p.parcel_id = r.parcel_id""",
                                ["attempted_amount", "discount_amount", "face_tax_amount", "penalty_amount"])

_EXT = ",\n" + """ext AS (SELECT seq AS extraction_id, seq % 11 <> 0 AS has_memo, *,
    -- cut off, no JSON, an amount beyond any money, and a date in words
    NOT (seq % 13 = 0 OR seq % 29 = 0 OR seq % 19 = 0 OR (seq % 17 = 0 AND seq % 23 <> 0)) AS ok
  FROM attempts WHERE check_number <> 'CASH'),
ext_p AS (SELECT extraction_id,
    CASE WHEN ok THEN check_number END AS check_number,
    CASE WHEN ok THEN CAST(CAST(amount AS DOUBLE) AS DECIMAL(18,2)) END AS amount,
    CASE WHEN ok THEN (CASE WHEN seq % 23 = 0 THEN """ + AS_OF + """ ELSE date END) END AS postmark_date,
    CASE WHEN ok THEN 'Payer of record' END AS payer_name,
    CASE WHEN ok THEN 'On file' END AS payer_address,
    CASE WHEN ok AND has_memo THEN '2025 tax ' || parcel_id END AS memo,
    ok AS parse_ok,
    CASE WHEN ok THEN (CASE WHEN has_memo THEN parcel_id ELSE 'UNKNOWN (Please Enter)' END) END AS found_parcel_id
  FROM ext)"""
ORACLE["check_extractions"] = q(_EXT, "SELECT * FROM ext_p", ["amount"])
ORACLE["memo_parcel"] = q(_EXT, "SELECT extraction_id, memo, found_parcel_id FROM ext_p WHERE parse_ok")
ORACLE["ingest_payments"] = q(
    _EXT + ",\n" + """ing AS (SELECT extraction_id AS seq, found_parcel_id AS parcel_id, amount,
    postmark_date AS date, check_number, CAST(NULL AS INTEGER) AS installment_num
  FROM ext_p WHERE parse_ok AND found_parcel_id <> 'UNKNOWN (Please Enter)')"""
    + validate_ctes("ing", "ing") + posted_cte("ing_posted", "ing_v", method="CHECK", keep_inst=False,
                                               prefix="Rejected (Ingest): "),
    f"SELECT {cols(JCOLS)} FROM ing_posted", JMONEY)
ORACLE["review_queue"] = q(_EXT, """SELECT *, CASE WHEN NOT parse_ok THEN 'UNPARSABLE'
    WHEN found_parcel_id = 'UNKNOWN (Please Enter)' THEN 'NO_PARCEL_IN_MEMO'
    ELSE 'PARCEL_NOT_ON_ROLL' END AS review_reason
  FROM ext_p WHERE NOT parse_ok OR found_parcel_id = 'UNKNOWN (Please Enter)'
    OR found_parcel_id NOT IN (SELECT parcel_id FROM roll)""", ["amount"])
# Of accepted payments only, told apart by installment; cash repeats no check.
ORACLE["duplicate_payments"] = q("", """SELECT parcel_id, check_number, amount_paid, installment_number,
  count(*) AS times_recorded, min(transaction_id) AS first_transaction_id
  FROM journal WHERE transaction_type = 'PAYMENT' AND payment_method = 'CHECK'
  GROUP BY parcel_id, check_number, amount_paid, installment_number
  HAVING count(*) > 1""", ["amount_paid"])


def _diff(field):
    return f"""SELECT CAST(1 AS BIGINT) AS batch_id, CAST(NULL AS BIGINT) AS log_seq, '{RUN_TS}' AS timestamp,
  'tax_duplicate' AS table_name,
  b.parcel_id AS record_id, '{field}' AS field_name, COALESCE(b.{field}, 'None') AS old_value,
  COALESCE(a.{field}, 'None') AS new_value, 'UPDATE' AS action_type, 'CLI' AS user_context
  FROM roll b JOIN after a ON a.parcel_id = b.parcel_id WHERE b.{field} IS DISTINCT FROM a.{field}"""


_CHANGE = _AFTER + ",\nchlog AS (" + "\nUNION ALL\n".join(
    _diff(f) for f in ("status", "owner_name", "mailing_address")) + f"""
UNION ALL
SELECT CAST(1 AS BIGINT), transaction_id, '{RUN_TS}', 'transactions', CAST(transaction_id AS VARCHAR), 'amount_paid',
  '0.00', {dbl('amount_paid')}, 'INSERT', 'CLI' FROM journal)"""
ORACLE["change_log"] = q(_CHANGE, "SELECT * FROM chlog")


def _dash(x):
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '-' ELSE {x} END"


ORACLE["audit_tail"] = q(_CHANGE, f"""SELECT batch_id, replace(substr(timestamp, 1, 19), 'T', ' ') AS time,
  table_name, record_id, action_type, {_dash('field_name')} AS field, {_dash('old_value')} AS old,
  {_dash('new_value')} AS new FROM chlog
  ORDER BY batch_id DESC, log_seq DESC NULLS LAST, table_name DESC, record_id DESC, field_name DESC LIMIT 20""")
ORACLE["system_events"] = q(_REQ + ",\n" + """yrs AS (SELECT DISTINCT CAST(year(date_received) AS INTEGER) AS year FROM journal),
jan AS (SELECT CAST(year(date_received) AS INTEGER) AS year, count(*) AS n FROM journal
        WHERE month(date_received) = 1 GROUP BY 1)""", f"""SELECT '{RUN_TS}' AS timestamp, 'TRANSACTION' AS action,
  'Added transaction for ' || parcel_id || ': ' || {dbl('amount_paid')} AS details,
  CAST(transaction_id AS VARCHAR) AS subject_id FROM journal WHERE transaction_type <> 'NSF_REVERSAL'
UNION ALL
SELECT '{RUN_TS}', 'NSF_REVERSAL', 'Reversed transaction ' || CAST(reversed_transaction_id AS VARCHAR),
  CAST(transaction_id AS VARCHAR) FROM journal WHERE transaction_type = 'NSF_REVERSAL'
UNION ALL
SELECT '{RUN_TS}', 'CLOSE_MONTH',
  'Closed ' || CAST(COALESCE(j.n, 0) AS VARCHAR) || ' transactions for 1/' || CAST(y.year AS VARCHAR),
  strftime(make_date(y.year, 1, 1), '%Y-%m') FROM yrs y LEFT JOIN jan j ON j.year = y.year
UNION ALL
SELECT '{RUN_TS}', 'UPDATE_PARCEL', 'Updated info for ' || parcel_id, parcel_id FROM parcels
  WHERE okey % 13 = 0 AND (okey % 2 = 0 OR okey % 3 = 0)
UNION ALL
SELECT '{RUN_TS}', 'ADD_INTERIM', 'Added Interim Parcel ' || parcel_id, parcel_id FROM req
  WHERE parcel_id NOT IN (SELECT parcel_id FROM parcels)""")

ORACLE["labels_csv"] = q("", """SELECT COALESCE(owner_name, 'Resident') AS name,
  COALESCE(mailing_address, '') AS address FROM parcels""")
# The printed table: right-aligned columns, amounts with as many decimals as the
# day needs (one at least), two spaces before amounts.
ORACLE["deposit_slip_text"] = q(",\n" + """chk AS (
  SELECT date_received, transaction_id, check_number, amount_paid, parcel_id FROM journal
  WHERE payment_method = 'CHECK' AND transaction_type <> 'REJECTED_PAYMENT'),
day AS (SELECT date_received, count(*) AS n, SUM(amount_paid) AS total,
    bool_or(CAST(amount_paid * 100 AS BIGINT) % 10 <> 0) AS two,
    greatest(12, max(length(check_number))) AS wc, greatest(9, max(length(parcel_id))) AS wp
  FROM chk GROUP BY date_received),
shown AS (SELECT c.*, d.wc, d.wp, CASE WHEN d.two THEN CAST(amount_paid AS VARCHAR)
    ELSE regexp_replace(CAST(amount_paid AS VARCHAR), '0$', '') END AS amt
  FROM chk c JOIN day d ON d.date_received = c.date_received),
wide AS (SELECT date_received, greatest(11, max(length(amt))) AS wa FROM shown GROUP BY date_received)""",
    f"""SELECT date_received, CAST(section AS INTEGER) AS section, CAST(line_id AS BIGINT) AS line_id, value FROM (
  SELECT date_received, 1 AS section, 0 AS line_id, 'DEPOSIT SLIP - ' || strftime(date_received, '%Y-%m-%d') AS value FROM day
  UNION ALL SELECT date_received, 1, 1, 'Total Count: ' || CAST(n AS VARCHAR) FROM day
  UNION ALL SELECT date_received, 1, 2, 'Total Amount: ' || {money_txt('total')} FROM day
  UNION ALL SELECT date_received, 1, 3, '{"-" * 30}' FROM day
  UNION ALL SELECT d.date_received, 2, 4, lpad('check_number', CAST(wc AS INTEGER), ' ') || '  '
    || lpad('amount_paid', CAST(wa AS INTEGER), ' ') || ' ' || lpad('parcel_id', CAST(wp AS INTEGER), ' ')
    FROM day d JOIN wide w ON w.date_received = d.date_received
  UNION ALL SELECT s.date_received, 3, transaction_id, lpad(check_number, CAST(wc AS INTEGER), ' ') || '  '
    || lpad(amt, CAST(wa AS INTEGER), ' ') || ' ' || lpad(parcel_id, CAST(wp AS INTEGER), ' ')
    FROM shown s JOIN wide w ON w.date_received = s.date_received) slips""")
_KPI = ",\n" + """k AS (SELECT
    (SELECT count(*) FROM parcels) AS total_parcels,
    (SELECT CAST(COALESCE(SUM(face_tax_amount), 0) AS DECIMAL(18,2)) FROM parcels) AS face,
    (SELECT CAST(COALESCE(SUM(amount_paid) FILTER (WHERE transaction_type = 'PAYMENT'), 0) AS DECIMAL(18,2)) FROM journal) AS collected),
sb AS (SELECT status, count(*) AS n FROM parcels GROUP BY status),
tt AS (SELECT p.tax_type, CAST(SUM(j.amount_paid) AS DECIMAL(18,2)) AS collected,
         count(DISTINCT j.parcel_id) AS parcels_paid
       FROM journal j JOIN parcels p ON p.parcel_id = j.parcel_id
       WHERE j.transaction_type = 'PAYMENT' GROUP BY p.tax_type)"""
_RATE_K = _RATE.format(c="collected", f="face")
ORACLE["status_report_lines"] = q(_KPI, f"""SELECT CAST(section AS INTEGER) AS section,
  CAST(rank AS INTEGER) AS rank, line FROM (
  SELECT 1 AS section, 0 AS rank, '# Tax Collection Status Report' AS line
  UNION ALL SELECT 1, 1, '**Date:** 2025-07-01 09:30' || {NL}
  UNION ALL SELECT 1, 2, '## 1. High-Level Summary'
  UNION ALL SELECT 1, 3, '*   **Total Parcels:** ' || CAST(total_parcels AS VARCHAR) FROM k
  UNION ALL SELECT 1, 4, '*   **Total Face Value:** ' || {money_txt('face')} FROM k
  UNION ALL SELECT 1, 5, '*   **Total Collected (YTD):** ' || {money_txt('collected')} FROM k
  UNION ALL SELECT 1, 6, '*   **Collection Rate:** ' || printf('%.1f', {_RATE_K}) || '%' FROM k
  UNION ALL SELECT 1, 7, '## 2. Parcel Status Breakdown'
  UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, status),
    '*   **' || status || ':** ' || CAST(n AS VARCHAR) || ' parcels' FROM sb
  UNION ALL SELECT 3, 0, ''
  UNION ALL SELECT 3, 1, '## 3. Revenue by Tax Type'
  UNION ALL SELECT 3, 2, '| Tax Type | Parcels Paid | Amount Collected |'
  UNION ALL SELECT 3, 3, '| :--- | :---: | :---: |'
  UNION ALL SELECT 4, row_number() OVER (ORDER BY tax_type),
    '| ' || tax_type || ' | ' || CAST(parcels_paid AS VARCHAR) || ' | ' || {money_txt('collected')} || ' |'
    FROM tt
  UNION ALL SELECT 4, 1, '| (No Payments Yet) | - | - |' WHERE NOT EXISTS (SELECT 1 FROM tt)) lines""")

# Files written and read again.
ORACLE["monthly_csv"] = ORACLE["monthly_detail"]
ORACLE["return_list_csv"] = ORACLE["return_list"]
ORACLE["turnover_csv"] = q("", """SELECT parcel_id AS "Parcel ID", owner_name AS "Owner Name",
  property_address AS "Property Address", 2025 AS "Tax Year", face_tax_amount AS "Face Tax",
  penalty_amount AS "Penalty", CAST(face_tax_amount + penalty_amount AS DECIMAL(18,2)) AS "Total Amount Due"
  FROM parcels WHERE status IN ('UNPAID', 'PARTIAL')""", ['"Face Tax"', '"Penalty"', '"Total Amount Due"'])
ORACLE["closed_version"] = q("", f"""SELECT {cols([c for c in JCOLS if c != 'is_closed'])},
  month(date_received) = 1 AS is_closed, receipt_month FROM journal""", JMONEY)
ORACLE["import_roll"] = ORACLE["upsert_parcels_literal"]

# --- Replay, step by step: which reversals stand depends on the months' locks and
# the other way round.  Passes settle from the front; the last two must agree.
_PASSES = 6


def _replay_steps() -> str:
    ctes = [""",
cl AS (
  SELECT make_date(CAST(year(date) AS INTEGER), 1, 1) AS m,
         CAST(floor(floor((min(seq) + max(seq)) / 2) / 1000) AS BIGINT) * 1000 + 700 AS close_seq
  FROM attempts WHERE month(date) = 1 GROUP BY year(date)),
lockable AS (
  SELECT x.*, CAST(date_trunc('month', date_received) AS DATE) AS m
  FROM (SELECT * FROM posted UNION ALL SELECT * FROM exon) x),
n0 AS (
  SELECT q.new_id, q.orig_id, q.rev_date, CAST(date_trunc('month', q.rev_date) AS DATE) AS m
  FROM nsfreq q JOIN posted p ON p.transaction_id = q.orig_id WHERE p.transaction_type = 'PAYMENT')"""]
    for k in range(1, _PASSES + 1):
        ctes.append(f"""
l{k} AS (
  SELECT c.m, min(c.close_seq) AS lock_start
  FROM cl c JOIN (SELECT m, min(id) AS first_id FROM (
      SELECT m, transaction_id AS id FROM lockable UNION ALL SELECT m, new_id FROM n{k - 1}) r
    GROUP BY m) f ON f.m = c.m AND c.close_seq > f.first_id
  GROUP BY c.m),
n{k} AS (
  SELECT n.* FROM n0 n JOIN lockable o ON o.transaction_id = n.orig_id
  LEFT JOIN l{k} l ON l.m = o.m
  WHERE l.lock_start IS NULL OR l.lock_start > o.transaction_id)""")
    k = _PASSES
    ctes.append(f"""
settled AS (
  SELECT CASE WHEN (SELECT count(*) FROM n{k}) = (SELECT count(*) FROM n{k - 1}) THEN 1
              ELSE error('more replay passes are needed') END AS ok),
split AS (
  SELECT o.*, COALESCE(o.transaction_type <> 'REJECTED_PAYMENT' AND l.lock_start < o.transaction_id, false) AS refused
  FROM lockable o LEFT JOIN l{k} l ON l.m = o.m),
rj AS (
  SELECT {cols(JCOLS)}, m FROM split WHERE NOT refused
  UNION ALL
  SELECT {cols(JCOLS, 'x')}, n.m FROM nsf x JOIN n{k} n ON n.new_id = x.transaction_id)""")
    return ",".join(ctes)


ORACLE["replay_journal"] = q(_replay_steps(), f"""SELECT {cols([c for c in JCOLS if c != 'is_closed'], 'rj')},
  COALESCE(c.last_close > rj.transaction_id, false) AS is_closed
  FROM rj JOIN settled ON ok = 1
  LEFT JOIN (SELECT m, max(close_seq) AS last_close FROM cl GROUP BY m) c ON c.m = rj.m""", JMONEY)
ORACLE["replay_refused"] = q(_replay_steps(),
                             f"SELECT {cols(JCOLS)} FROM split JOIN settled ON ok = 1 WHERE refused", JMONEY)
# Other ways to the same rows: buckets by parcel, and a state kept by batches.
for _key in ("monthly_summary", "status_by_tax_type", "settlement"):
    ORACLE["colocated_" + _key] = ORACLE[_key]
ORACLE["status_from_batches"] = ORACLE["parcel_status"]
ORACLE["settlement_from_batches"] = ORACLE["settlement"]
ORACLE["change_log_by_bucket"] = ORACLE["change_log"]
ORACLE["payer_sketches"] = q(",\n" + """spans AS (
  SELECT unnest([strftime(j.date_received, '%Y-%m'), strftime(j.date_received, '%Y'), 'all']) AS span,
         p.tax_type, j.parcel_id
  FROM journal j JOIN parcels p ON p.parcel_id = j.parcel_id WHERE j.transaction_type = 'PAYMENT')""",
                             """SELECT span, tax_type, count(DISTINCT parcel_id) AS parcels_paid,
  true AS sketch_within_3_percent FROM spans GROUP BY span, tax_type""")
