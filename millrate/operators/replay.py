"""Replay an ordered batch of commands with one-at-a-time semantics (M11).

Commands (``seq`` orders them): ``pay`` (parcel_id, amount, date,
check_number, installment_num), ``exonerate`` (parcel_id, amount, date,
reason), ``nsf`` (tx_id, date) and ``close_month`` (month, year).

Sequentially, a month is locked once a close of it runs after at least one
of its rows exists; locked months refuse accepted payments and
exonerations (rejected attempts and NSF rows are always written).  So

  lock_start(m) = min close seq of m that follows the first row of m,

and an accepted row at ``seq`` is refused iff ``lock_start(month) < seq``.
An NSF row exists iff the row its chain of NSF commands starts from was not
refused.  (``corrected`` lets an NSF command reverse a payment only, once;
``literal`` also an NSF row.)  So whether a close locks its month is an "or": a
row other than an NSF row comes before it, or an earlier close of the month locked
it, or an NSF row that came before it exists, which is the "not" of another close.

The commands are first reduced to these conditions, one table with a row per pair
of closes at most, and then solved in rounds.  A round puts known values in place
and lets a condition that rests on a single other one point to what that one points
to, so chains of months that open and close one another shrink by half a round.
Conditions on several open ones wait for one of them to be true or all to be known.
The batch itself is not read again until its rows are split by the locks.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.functions import rules
from millrate.operators import posting
from millrate.schemas import JOURNAL_COLUMNS, MONEY
from millrate.session import cut_lineage, drop_table


#: What a reversal takes over from the row it reverses: no other column is shuffled.
_REVERSED = ("transaction_id", "parcel_id", "transaction_type", "check_number", "amount_paid", "payment_period",
             "installment_number", "_m")


def _follow(links: DataFrame) -> DataFrame:
    """Links from NSF commands to their first rows: ``root`` leaves the NSF commands
    after as many rounds as the longest chain has binary digits."""
    while True:
        further = links.select(F.col("seq").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"))
        moved = links.join(further, "root", "left")
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return links
        shorter = cut_lineage(moved.select(
            "seq", "tx_id", "date", F.coalesce("_next", "root").alias("root"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        drop_table(links)
        links = shorter


def _candidates(nsf_cmds: DataFrame, originals: DataFrame, semantics: str) -> DataFrame:
    """NSF commands that write a row if their ``root`` stands, with its columns."""
    links = nsf_cmds.filter(F.col("tx_id") < F.col("seq")).select(
        "seq", "tx_id", "date", F.col("tx_id").alias("root"), F.lit(1).cast("long").alias("depth"))
    if semantics == "literal":
        links = _follow(cut_lineage(links))
    j = links.join(originals.select(
        F.col("transaction_id").alias("root"), "parcel_id", "transaction_type", "check_number", "amount_paid",
        "payment_period", "installment_number", F.col("_m").alias("root_month")), "root", "inner")
    if semantics == "corrected":
        j = j.filter(F.col("transaction_type") == "PAYMENT")
        first = j.groupBy("tx_id").agg(F.min("seq").alias("seq"))
        j = j.join(first, ["tx_id", "seq"], "left_semi")
    return cut_lineage(j.withColumn("_m", rules.month_start("date")))


def _nsf_rows(candidates: DataFrame) -> DataFrame:
    """The journal rows of candidates whose root stands; each link turns the sign."""
    undone = F.when(F.col("depth") % 2 == 1, F.col("amount_paid")).otherwise(-F.col("amount_paid"))
    return candidates.select(
        F.col("seq").alias("transaction_id"), F.col("date").alias("date_received"),
        F.col("date").alias("postmark_date"), "parcel_id",
        F.lit("NSF_REVERSAL").alias("transaction_type"), F.lit("ADJUSTMENT").alias("payment_method"),
        "check_number", (-undone).cast(MONEY).alias("amount_paid"),
        undone.cast(MONEY).alias("balance_remaining"), "payment_period",
        "installment_number", F.lit(None).cast("long").alias("deposit_batch_id"),
        F.lit(False).alias("is_closed"), F.lit(None).cast("string").alias("image_path"),
        F.concat(F.lit("NSF Reversal for Trans ID "), F.col("tx_id").cast("string")).alias("notes"),
        F.lit(None).cast("string").alias("validation_code"),
        F.col("tx_id").alias("reversed_transaction_id"))


def _conditions(candidates: DataFrame, first_fixed: DataFrame, closes: DataFrame) -> DataFrame:
    """What each close rests on: rows (node, known, to, negated).  ``node`` is a
    close; it locks its month iff a row is ``known`` to be true, or the close
    ``to`` does (does not, if negated) lock its own."""
    by_month = closes.groupBy("_m").agg(F.sort_array(F.collect_list("close_seq")).alias("closes"))

    def condition(known: F.Column, to: F.Column | None = None, negated: bool | None = None) -> list[F.Column]:
        return [known.cast("boolean").alias("known"), (F.lit(None) if to is None else to).cast("long").alias("to"),
                F.lit(negated).cast("boolean").alias("negated")]

    node = F.col("close_seq").alias("node")
    fixed = closes.join(first_fixed, "_m", "left").select(
        node, *condition(F.coalesce(F.col("first_seq") < F.col("close_seq"), F.lit(False))))
    spans = by_month.select(F.explode(F.arrays_zip(
        F.slice("closes", 2, F.greatest(F.size("closes") - 1, F.lit(0))).alias("close_seq"),
        F.slice("closes", 1, F.greatest(F.size("closes") - 1, F.lit(0))).alias("earlier"))).alias("s"))
    earlier = spans.select(F.col("s.close_seq").alias("node"), *condition(F.lit(None), F.col("s.earlier"), False))
    # An NSF row counts from the first close of its month after it; its root is
    # refused by the last close of the root's month before the root, if that locks.
    c = candidates.join(by_month, "_m", "inner").withColumn(
        "node", F.array_min(F.filter("closes", lambda x: x > F.col("seq")))).filter(
        F.col("node").isNotNull()).drop("closes")
    roots = by_month.select(F.col("_m").alias("root_month"), "closes")
    c = c.join(roots, "root_month", "left").withColumn("to", F.when(
        F.col("transaction_type") != "REJECTED_PAYMENT",
        F.array_max(F.filter("closes", lambda x: x < F.col("root")))))
    reversals = c.select("node", F.when(F.col("to").isNull(), F.lit(True)).alias("known"), "to",
                         F.when(F.col("to").isNotNull(), F.lit(True)).alias("negated")).distinct()
    return fixed.unionByName(earlier).unionByName(reversals)


def _simplify(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, conditions left).  ``state``: per close its ``value`` if known, else,
    if it rests on one other close alone, that (``next``, ``turned``)."""
    pairs = cut_lineage(rows.groupBy("node", "to").agg(
        F.max("known").alias("known"), F.min("negated").alias("lo"), F.max("negated").alias("hi")))
    one = pairs.groupBy("node").agg(
        F.max(F.when(F.col("lo") != F.col("hi"), F.lit(True)).otherwise(F.col("known"))).alias("known"),
        F.count("to").alias("open"), F.min("to").alias("to"), F.min("lo").alias("negated"))
    value = F.when(F.col("known"), F.lit(True)).when(F.col("open") == 0, F.lit(False))
    alone = value.isNull() & (F.col("open") == 1)
    state = one.select("node", value.alias("value"), F.when(alone, F.col("to")).alias("next"),
                       F.when(alone, F.col("negated")).alias("turned"))
    left = pairs.filter(F.col("to").isNotNull()).join(
        state.filter(F.col("value").isNull()), "node", "left_semi").select("node", "to", F.col("lo").alias("negated"))
    state, left = cut_lineage(state), cut_lineage(left)
    drop_table(pairs)
    return state, left


def _solve(conditions: DataFrame) -> DataFrame:
    """(node, value) of every close."""
    state, left = _simplify(conditions)
    while not left.isEmpty():
        target = state.select(F.col("node").alias("to"), "value", "next", "turned")
        put = left.join(target, "to", "left").select(
            "node", F.when(F.col("value").isNotNull(), F.col("value") != F.col("negated")).alias("known"),
            F.when(F.col("value").isNull(), F.coalesce("next", "to")).alias("to"),
            F.when(F.col("value").isNull(), F.col("negated") != F.coalesce("turned", F.lit(False))).alias("negated"))
        newer, still = _simplify(put)
        both = cut_lineage(newer.unionByName(state.filter(F.col("value").isNotNull())))
        for old in (state, left, newer):
            drop_table(old)
        state, left = both, still
    return state.select("node", "value")


def replay(commands: DataFrame, parcels: DataFrame, semantics: str = "corrected",
           default_issue: _dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(journal, refused): the outcome of running the commands in ``seq`` order."""
    cmd = F.col("command")
    pays = commands.filter(cmd == "pay").select(
        "seq", "parcel_id", F.col("amount").cast(MONEY).alias("amount"), "date",
        F.coalesce("check_number", F.lit("CASH")).alias("check_number"),
        F.col("installment_num").cast("int").alias("installment_num"))
    posted = posting.post_payments(pays, parcels, default_issue)
    exons = posting.exonerate(commands.filter(cmd == "exonerate").select(
        "seq", "parcel_id", "amount", "date", "reason"))
    lockable = posted.unionByName(exons).withColumn(
        "_m", rules.month_start("date_received"))
    lockable = cut_lineage(lockable)
    nsf_cmds = commands.filter(cmd == "nsf").select("seq", "tx_id", "date")
    closes = commands.filter(cmd == "close_month").select(
        F.col("seq").alias("close_seq"),
        F.make_date("year", "month", F.lit(1)).alias("_m"))

    # Each month's first written (non-NSF) row, and the rows NSF commands point at.
    first_fixed = lockable.groupBy("_m").agg(F.min("transaction_id").alias("first_seq"))
    wanted = nsf_cmds.select(F.col("tx_id").alias("transaction_id")).distinct()
    originals = cut_lineage(lockable.select(*_REVERSED).join(wanted, "transaction_id", "left_semi"))
    candidates = _candidates(nsf_cmds, originals, semantics)
    locking = _solve(_conditions(candidates, first_fixed, closes)).filter("value")
    locks = cut_lineage(closes.join(locking, F.col("close_seq") == F.col("node"), "left_semi").groupBy("_m").agg(
        F.min("close_seq").alias("lock_start")))
    # Rows meet a table of months, a calendar's worth: it is broadcast, they stay where they are.

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        j = rows.join(F.broadcast(locks), "_m", "left")
        refused_cond = (F.col("transaction_type") != "REJECTED_PAYMENT") & \
            F.col("lock_start").isNotNull() & (F.col("lock_start") < F.col("transaction_id"))
        return j.filter(~refused_cond).drop("lock_start"), j.filter(refused_cond).drop("lock_start")

    standing = split(originals)[0].select(F.col("transaction_id").alias("root"))
    nsf = _nsf_rows(candidates.join(standing, "root", "left_semi"))
    kept, refused = split(lockable)
    journal = kept.drop("_m").unionByName(nsf)
    last_close = closes.groupBy("_m").agg(F.max("close_seq").alias("_last"))
    journal = journal.withColumn("_m", rules.month_start("date_received")) \
        .join(F.broadcast(last_close), "_m", "left") \
        .withColumn("is_closed", F.coalesce(F.col("_last") > F.col("transaction_id"), F.lit(False)))
    return journal.select(*JOURNAL_COLUMNS), refused.drop("_m").select(*JOURNAL_COLUMNS)

