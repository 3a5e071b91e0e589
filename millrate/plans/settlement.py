"""Annual settlement: charges against credits (R4, A13).

The reference runs seven scans; here the corrected report is one
aggregate over the per-parcel status table, and the literal report is one
aggregate over the roll plus one over the journal (joined to the roll for
the face amount), combined by a union and a final sum — no cross join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate import config
from millrate.operators.status import parcel_status
from millrate.schemas import MONEY

MEASURES = ("original_face", "interim_face", "penalties_collected", "returned_penalty",
            "cash_collected", "discounts_allowed", "exonerations", "returned_face")

def _zero() -> F.Column:
    return F.lit(Decimal("0.00")).cast(MONEY)


def _sum(cond, value) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, value)), _zero())


def _finish(parts: DataFrame) -> DataFrame:
    """Totals, difference and the balanced flag from the eight measures."""
    charges = (F.col("original_face") + F.col("interim_face") + F.col("penalties_collected")
               + F.col("returned_penalty"))
    credits = (F.col("cash_collected") + F.col("discounts_allowed") + F.col("exonerations")
               + F.col("returned_face") + F.col("returned_penalty"))
    out = parts.select(*[F.col(m).cast(MONEY).alias(m) for m in MEASURES])
    out = out.withColumn("total_charges", charges.cast(MONEY)) \
        .withColumn("total_credits", credits.cast(MONEY))
    out = out.withColumn("difference", (F.col("total_charges") - F.col("total_credits"))
                         .cast(MONEY))
    return out.withColumn("balanced", F.abs("difference") < F.lit(config.SETTLEMENT_TOLERANCE))


def per_parcel_settlement(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Each parcel's terms of the corrected identity (see ``settlement``)."""
    return settlement_terms(parcel_status(parcels, journal, "corrected"))


def settlement_terms(st: DataFrame) -> DataFrame:
    """The terms of parcels whose status and sums are known."""
    face, pen = F.col("face_tax_amount"), F.col("penalty_amount")
    net = F.coalesce(F.col("net_paid"), _zero())
    exon = F.coalesce(F.col("exonerated"), _zero())
    status = F.col("status")
    returned = status.isin("UNPAID", "RETURNED")
    interim = F.coalesce(F.col("is_interim"), F.lit(False))
    return st.select(
        "parcel_id", "status", "face_tax_amount", "penalty_amount",
        net.alias("net_paid"), exon.alias("exonerated"),
        F.when(~interim, face).otherwise(_zero()).alias("original_face"),
        F.when(interim, face).otherwise(_zero()).alias("interim_face"),
        F.greatest(net - face, _zero()).alias("penalties_collected"),
        F.when(returned, pen).otherwise(_zero()).alias("returned_penalty"),
        net.alias("cash_collected"),
        F.when((status == "PAID") & (net < face), face - net).otherwise(_zero())
        .alias("discounts_allowed"),
        exon.alias("exonerations"),
        F.when(returned, face).when(status == "PARTIAL", face - net).otherwise(_zero())
        .alias("returned_face"),
    )


def settlement(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Corrected settlement: balances per parcel by construction.

    charges = face (original + interim) + money above face + returned
    penalties; credits = net money + discounts (PAID below face) +
    exonerations + returned face (UNPAID/RETURNED: face; PARTIAL: face - net)
    + the same returned penalties.
    """
    return settlement_totals(per_parcel_settlement(parcels, journal))


def settlement_totals(pp: DataFrame) -> DataFrame:
    """The terms of all parcels added up."""
    return _finish(pp.agg(*[F.sum(m).alias(m) for m in MEASURES]))


def settlement_exceptions(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Parcels whose own charges and credits differ (e.g. odd exonerations)."""
    pp = _finish_rows(per_parcel_settlement(parcels, journal))
    return pp.filter(~F.col("balanced")).select(
        "parcel_id", "status", "face_tax_amount", "net_paid", "exonerated",
        "total_charges", "total_credits", "difference")


def _finish_rows(pp: DataFrame) -> DataFrame:
    charges = (F.col("original_face") + F.col("interim_face") + F.col("penalties_collected")
               + F.col("returned_penalty"))
    credits = (F.col("cash_collected") + F.col("discounts_allowed") + F.col("exonerations")
               + F.col("returned_face") + F.col("returned_penalty"))
    return pp.withColumn("total_charges", charges.cast(MONEY)) \
        .withColumn("total_credits", credits.cast(MONEY)) \
        .withColumn("difference", (charges - credits).cast(MONEY)) \
        .withColumn("balanced", F.abs(charges - credits) < F.lit(config.SETTLEMENT_TOLERANCE))


def settlement_literal(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """The reference's formulas, imbalance included.

    Discounts are face - amount of DISCOUNT-period payments, penalties are
    amount - face of PENALTY-period payments (installments make these
    negative), returns cover UNPAID/RETURNED parcels only, and cash ignores
    reversals.
    """
    st = parcel_status(parcels, journal, "literal")
    status = F.col("status")
    returned = status.isin("UNPAID", "RETURNED")
    interim = F.coalesce(F.col("is_interim"), F.lit(False))
    face, pen = F.col("face_tax_amount"), F.col("penalty_amount")
    roll_part = st.agg(
        _sum(~interim, face).alias("original_face"),
        _sum(interim, face).alias("interim_face"),
        _sum(returned, pen).alias("returned_penalty"),
        _sum(returned, face).alias("returned_face"),
    )
    t, per, amt = F.col("transaction_type"), F.col("payment_period"), F.col("amount_paid")
    j = journal.select("parcel_id", "transaction_type", "payment_period", "amount_paid") \
        .join(parcels.select("parcel_id", "face_tax_amount"), "parcel_id", "left")
    on_roll = F.col("face_tax_amount").isNotNull()
    journal_part = j.agg(
        _sum(on_roll & (t == "PAYMENT") & (per == "PENALTY"), amt - face)
        .alias("penalties_collected"),
        _sum(t == "PAYMENT", amt).alias("cash_collected"),
        _sum(on_roll & (t == "PAYMENT") & (per == "DISCOUNT"), face - amt)
        .alias("discounts_allowed"),
        _sum(t == "EXONERATION", amt).alias("exonerations"),
    )

    def widen(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(m) if m in df.columns else _zero()).cast("decimal(38,2)")
                           .alias(m) for m in MEASURES])

    both = widen(roll_part).unionByName(widen(journal_part))
    return _finish(both.agg(*[F.sum(m).alias(m) for m in MEASURES]))
