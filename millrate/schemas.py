"""Fixed Spark schemas of the roll, the journal and their inputs."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
SHARE = T.DecimalType(9, 6)

# Status, transaction type, period and method domains (fixed values).
STATUSES = ("UNPAID", "PARTIAL", "PAID", "RETURNED", "EXONERATED")
TRANSACTION_TYPES = ("PAYMENT", "EXONERATION", "RETURN", "NSF_REVERSAL", "REJECTED_PAYMENT")
PERIODS = ("DISCOUNT", "FACE", "PENALTY")
METHODS = ("CHECK", "CASH", "NONE", "ADJUSTMENT")
TAX_TYPES = ("Real Estate", "Per Capita", "Fire")

ROLL_CSV_REQUIRED = (
    "parcel_id", "owner_name", "property_address", "bill_number",
    "assessment_value", "face_tax_amount", "discount_amount", "penalty_amount",
    "tax_type",
)
ROLL_CSV_OPTIONAL = (
    "mailing_address", "homestead_exclusion", "farmstead_exclusion",
    "bill_issue_date", "is_installment_plan",
)

PARCELS = T.StructType([
    T.StructField("parcel_id", T.StringType(), False),
    T.StructField("owner_name", T.StringType()),
    T.StructField("property_address", T.StringType()),
    T.StructField("mailing_address", T.StringType()),
    T.StructField("bill_number", T.StringType()),
    T.StructField("assessment_value", MONEY),
    T.StructField("homestead_exclusion", MONEY),
    T.StructField("farmstead_exclusion", MONEY),
    T.StructField("face_tax_amount", MONEY),
    T.StructField("discount_amount", MONEY),
    T.StructField("penalty_amount", MONEY),
    T.StructField("tax_type", T.StringType()),
    T.StructField("bill_issue_date", T.DateType()),
    T.StructField("is_installment_plan", T.BooleanType()),
    T.StructField("is_interim", T.BooleanType()),
    T.StructField("status", T.StringType()),
])
PARCEL_COLUMNS = tuple(f.name for f in PARCELS.fields)

JOURNAL = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("date_received", T.DateType()),
    T.StructField("postmark_date", T.DateType()),
    T.StructField("parcel_id", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("check_number", T.StringType()),
    T.StructField("amount_paid", MONEY),
    T.StructField("balance_remaining", MONEY),
    T.StructField("payment_period", T.StringType()),
    T.StructField("installment_number", T.IntegerType()),
    T.StructField("deposit_batch_id", T.LongType()),
    T.StructField("is_closed", T.BooleanType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("notes", T.StringType()),
    # Additions of this engine: the validation outcome of a posted attempt
    # and, on an NSF row, the id it reverses (so status can find it).
    T.StructField("validation_code", T.StringType()),
    T.StructField("reversed_transaction_id", T.LongType()),
])
JOURNAL_COLUMNS = tuple(f.name for f in JOURNAL.fields)

ATTEMPTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("parcel_id", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("date", T.DateType()),
    T.StructField("check_number", T.StringType()),
    T.StructField("installment_num", T.IntegerType()),
])

CHECK_EXTRACTION = T.StructType([
    T.StructField("check_number", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("postmark_date", T.StringType()),
    T.StructField("payer_name", T.StringType()),
    T.StructField("payer_address", T.StringType()),
    T.StructField("memo", T.StringType()),
])

CHANGE_LOG = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("log_seq", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("field_name", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("new_value", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("user_context", T.StringType()),
])
