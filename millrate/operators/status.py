"""Parcel status from journal events, and running balances.

Status is an aggregate per parcel (partial aggregation before the
shuffle, so a parcel with a third of all rows still combines map-side),
followed by one join back to the roll.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.functions import rules
from millrate.operators.util import running_sum
from millrate.schemas import MONEY, PARCEL_COLUMNS

_STATUS_TYPES = ("PAYMENT", "EXONERATION", "RETURN", "NSF_REVERSAL")
_MONEY_TYPES = ("PAYMENT", "NSF_REVERSAL")


# Event types packed into the low bits of the transaction id, so "latest
# event" is a plain max over longs (hash aggregation with a map-side combine)
# instead of max_by over strings (sort-based aggregation).
_EVENT_CODES = {"PAYMENT": 1, "EXONERATION": 2, "RETURN": 3, "NSF_REVERSAL": 4}
_CODE_BITS = 8


def _packed_event(types: tuple[str, ...]) -> F.Column:
    t = F.col("transaction_type")
    code = F.lit(None).cast("long")
    for name in types:
        code = F.when(t == name, F.lit(_EVENT_CODES[name])).otherwise(code)
    return F.col("transaction_id") * _CODE_BITS + code


def _unpack_event(packed: F.Column) -> F.Column:
    code = F.pmod(packed, F.lit(_CODE_BITS))
    out = F.lit(None).cast("string")
    for name, value in _EVENT_CODES.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def event_groups(journal: DataFrame, *more_keys: str) -> DataFrame:
    """The journal summed by (parcel, payment id), and by ``more_keys`` if given.

    A full payment and its reversals share a group; all other rows of a parcel
    share the group without an id.
    """
    t = F.col("transaction_type")
    full = (t == "PAYMENT") & (F.col("validation_code") == "ACCEPTED_FULL")
    target = F.when(full, F.col("transaction_id")).when(
        t == "NSF_REVERSAL", F.col("reversed_transaction_id"))
    return journal.withColumn("_target", target).groupBy("parcel_id", "_target", *more_keys).agg(
        F.max(_packed_event(_STATUS_TYPES)).alias("_last"),
        F.sum(F.when(t.isin(*_MONEY_TYPES), F.col("amount_paid"))).alias("_net"),
        F.sum(F.when(t == "EXONERATION", F.col("amount_paid"))).alias("_exonerated"),
        F.count(F.when(full, F.lit(1))).alias("_full"),
        F.count(F.when((t == "NSF_REVERSAL") & F.col("reversed_transaction_id").isNotNull(),
                       F.lit(1))).alias("_reversals"))


def merge_groups(groups: DataFrame, *more_keys: str) -> DataFrame:
    """Groups of the same keys from several batches as one."""
    return groups.groupBy("parcel_id", "_target", *more_keys).agg(
        F.max("_last").alias("_last"),
        *[F.sum(c).cast("decimal(28,2)").alias(c) for c in ("_net", "_exonerated")],
        *[F.sum(c).alias(c) for c in ("_full", "_reversals")])


def events_of_groups(groups: DataFrame) -> DataFrame:
    """Per parcel: its groups, each (parcel, payment id) once, added up."""
    agg = groups.groupBy("parcel_id").agg(
        F.max("_last").alias("_last"),
        F.coalesce(F.sum("_net"), F.lit(0)).cast(MONEY).alias("net_paid"),
        F.coalesce(F.sum("_exonerated"), F.lit(0)).cast(MONEY).alias("exonerated"),
        F.sum(F.when(F.col("_reversals") == 0, F.col("_full")).otherwise(F.lit(0))).alias("live_full"))
    return agg.select("parcel_id", _unpack_event(F.col("_last")).alias("last_event"),
                      "net_paid", "exonerated", "live_full")


def parcel_events(journal: DataFrame) -> DataFrame:
    """Per parcel: latest status event, net money, exonerated amount, and
    ``live_full``, the accepted-in-full payments that no NSF row reverses.

    One scan of the journal.  Rows that name no payment combine before the
    shuffle, and a parcel with many payments is still spread over tasks.
    """
    return events_of_groups(event_groups(journal))


def latest_flags(journal: DataFrame) -> DataFrame:
    """Per parcel: the latest exoneration, return or reversal."""
    return journal.groupBy("parcel_id").agg(
        F.max(_packed_event(("EXONERATION", "RETURN", "NSF_REVERSAL"))).alias("_last")).select(
        "parcel_id", _unpack_event(F.col("_last")).alias("last_flag_event"))


def parcel_status(parcels: DataFrame, journal: DataFrame,
                  semantics: str = "corrected") -> DataFrame:
    """The roll with ``status`` derived from the journal.

    corrected: latest EXONERATION/RETURN wins; otherwise PAID when an
    accepted-in-full payment stands (not reversed) or net money reaches the
    face amount, PARTIAL when some money stands, else UNPAID.
    literal: payments never change status; the latest EXONERATION, RETURN
    or NSF_REVERSAL sets EXONERATED, RETURNED or UNPAID.
    """
    p = parcels.select(*PARCEL_COLUMNS)
    if semantics == "literal":
        j = p.join(latest_flags(journal), "parcel_id", "left")
        # The status the latest flagged row sets (D10, literal), else unchanged.
        status = F.coalesce(rules.status_event("last_flag_event", F.lit(None), "literal"),
                            F.col("status"), F.lit("UNPAID"))
        return j.withColumn("status", status).select(*PARCEL_COLUMNS)
    return status_of_events(p, parcel_events(journal))


def status_of_events(parcels: DataFrame, events: DataFrame) -> DataFrame:
    """The corrected status of each parcel from its :func:`parcel_events`."""
    j = parcels.select(*PARCEL_COLUMNS).join(events, "parcel_id", "left")
    net = F.coalesce(F.col("net_paid"), F.lit(0))
    status = (F.when(F.col("last_event") == "EXONERATION", F.lit("EXONERATED"))
              .when(F.col("last_event") == "RETURN", F.lit("RETURNED"))
              .when((F.coalesce(F.col("live_full"), F.lit(0)) > 0)
                    | (net >= F.col("face_tax_amount")), F.lit("PAID"))
              .when(net > 0, F.lit("PARTIAL"))
              .otherwise(F.lit("UNPAID")))
    return j.withColumn("status", status).select(*PARCEL_COLUMNS, "net_paid", "exonerated")


def running_balance(journal: DataFrame, parcels: DataFrame,
                    partitions: int | None = None) -> DataFrame:
    """Net paid to date and open balance after each money row of a parcel.

    Order within a parcel is (date_received, transaction_id); the running
    total is computed without a per-parcel window so a hot parcel is split
    across tasks.
    """
    money = journal.filter(F.col("transaction_type").isin(*_MONEY_TYPES)).select(
        "transaction_id", "parcel_id", "date_received", "transaction_type", "amount_paid")
    rs = running_sum(money, "parcel_id", ["date_received", "transaction_id"], "amount_paid",
                     "net_paid_to_date", partitions)
    face = parcels.select("parcel_id", "face_tax_amount")
    return rs.join(face, "parcel_id", "left").select(
        "transaction_id", "parcel_id", "date_received", "transaction_type", "amount_paid",
        F.col("net_paid_to_date").cast(MONEY).alias("net_paid_to_date"),
        (F.col("face_tax_amount") - F.col("net_paid_to_date")).cast(MONEY)
        .alias("balance_remaining"))
