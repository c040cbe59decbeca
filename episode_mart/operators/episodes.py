"""Episodes: a patient's interval from one referral date to the next.

Windows work on one row per patient and day, so a window over a patient never sees more rows than
there are days, however many referrals, payers or transactions the patient has, and no fact is
compared with every episode of its patient.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episode_mart.functions.text import match_key
from episode_mart.operators.skew import HOT_ROWS, join_by_key
from episode_mart.schemas import MONEY, UNITS

# Exclusive end of an episode nothing follows.
OPEN_END = datetime.date(9999, 12, 31)
SELF_PAY = "Self-Pay"


def _day(c: Column) -> Column:
    # A fact on the open end itself is outside every episode, like a fact without a date.
    return F.when(c < F.lit(OPEN_END), c)


def episodes(referrals: DataFrame) -> DataFrame:
    """One row per patient and referral date: next date, visit number, number of referrals.

    Referrals on the same date share the lowest visit number of the date. A referral without
    a date counts before all others but forms no episode.
    """
    by_date = Window.partitionBy("patient_key").orderBy("referral_date")
    before = by_date.rowsBetween(Window.unboundedPreceding, -1)
    days = (
        referrals.select(match_key(F.col("patient_id")).alias("patient_key"), "referral_date")
        .where(F.col("patient_key").isNotNull())
        .groupBy("patient_key", "referral_date")
        .agg(F.count("*").alias("referrals"))
    )
    return days.select(
        "patient_key",
        "referral_date",
        F.coalesce(F.lead("referral_date").over(by_date), F.lit(OPEN_END)).alias("next_date"),
        (F.coalesce(F.sum("referrals").over(before), F.lit(0)) + 1).cast("int").alias("visit_number"),
        "referrals",
    ).where(F.col("referral_date").isNotNull())


def with_visit_number(referrals: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Referrals with their visit number; null where patient or date is."""
    numbered = episodes(referrals).select("patient_key", "referral_date", "visit_number", "referrals")
    keyed = referrals.withColumn("patient_key", match_key(F.col("patient_id")))
    return join_by_key(keyed, numbered, ["patient_key", "referral_date"], "referrals", hot_rows)


def _with_marks(days: DataFrame, eps: DataFrame, attributes: list[str]) -> DataFrame:
    """The days and one mark per episode on the day it begins; ``is_fact`` tells them apart."""
    marks = eps.select(
        "patient_key",
        F.col("referral_date").alias("day"),
        F.struct(*attributes).alias("_begun"),
        F.lit(0).alias("is_fact"),
    )
    return marks.unionByName(days.withColumn("is_fact", F.lit(1)), allowMissingColumns=True)


def carry_forward(days: DataFrame, eps: DataFrame, attributes: list[str]) -> DataFrame:
    """Give each patient-day the attributes of the latest episode that has begun.

    ``days`` has ``patient_key``, ``day`` and further columns. The result holds the days and
    one mark per episode (``is_fact`` tells them apart) with ``episode``, a struct of the
    attributes, and ``patient_seen``: whether the patient has any day in ``days``.
    """
    return _carried(_with_marks(days, eps, attributes))


def _carried(both: DataFrame) -> DataFrame:
    """``carry_forward`` over days and marks, one row each."""
    patient = Window.partitionBy("patient_key")
    # Same order as the running frame, so one sort serves all; a mark precedes its day's facts.
    by_day = patient.orderBy("day", "is_fact")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return both.select(
        *[c for c in both.columns if c != "_begun"],
        F.last("_begun", ignorenulls=True).over(so_far).alias("episode"),
        (F.coalesce(F.lead("is_fact").over(by_day), F.lit(0)) == 0).alias("_nothing_next"),
        (F.max("is_fact").over(whole) == 1).alias("patient_seen"),
    ).select(
        "*", ((F.col("is_fact") == 0) & F.col("_nothing_next")).alias("is_empty")
    ).drop("_nothing_next")


def _days_of(transactions: DataFrame, *columns: str) -> DataFrame:
    return transactions.select(
        match_key(F.col("patient_number_updated")).alias("patient_key"),
        _day(F.col("from_dos")).alias("day"), *columns,
    ).where(F.col("patient_key").isNotNull())


def daily_activity(transactions: DataFrame) -> DataFrame:
    """Balance, units and lines per patient, day and payer; combined before the shuffle.

    Payers are grouped as spelled: only sums and counts are kept, so the combine is a hash
    aggregate. Spellings of one payer meet per episode.
    """
    return (
        _days_of(transactions, "insurance_name", "remaining_balance", "units")
        .withColumnRenamed("insurance_name", "payer")
        .groupBy("patient_key", "day", "payer")
        .agg(
            F.sum("remaining_balance").cast(MONEY).alias("balance"),
            F.sum("units").cast(UNITS).alias("units"),
            F.count("payer").alias("lines"),
        )
    )


def episode_activity(referrals: DataFrame, transactions: DataFrame) -> DataFrame:
    """Balance, units and lines per episode and payer, empty episodes included.

    Rows are sent to their patient once: there a day's payers are put into one row, so the window still has one
    row per day and sees no payer, and all that follows groups by the patient and more.
    """
    attributes = ["referral_date", "next_date", "visit_number", "referrals"]
    lines = daily_activity(transactions).select(
        "patient_key", "day", F.struct("payer", "balance", "units", "lines").alias("_line"))
    days = (
        _with_marks(lines, episodes(referrals), attributes)
        .repartition("patient_key")
        .groupBy("patient_key", "day", "is_fact")
        .agg(F.collect_list("_line").alias("_lines"), F.max("_begun").alias("_begun"))
    )
    return (
        _carried(days)
        .where(F.col("episode").isNotNull() & ((F.col("is_fact") == 1) | F.col("is_empty")))
        .select("patient_key", "episode", "patient_seen", F.explode_outer("_lines").alias("_line"))
        .select("patient_key", "episode", "patient_seen", "_line.*")
        .withColumn("payer_key", match_key(F.col("payer")))
        .groupBy("patient_key", "episode", "payer_key")
        .agg(
            F.min("payer").alias("payer"),
            F.sum("balance").cast(MONEY).alias("balance"),
            F.sum("units").cast(UNITS).alias("units"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
            F.first("patient_seen").alias("patient_seen"),
        )
    )


def episode_balance(referrals: DataFrame, transactions: DataFrame) -> DataFrame:
    """Sum of transaction balances per episode, zero without transactions; summed per day first."""
    attributes = ["referral_date", "next_date", "visit_number", "referrals"]
    days = _days_of(transactions, "remaining_balance").groupBy("patient_key", "day").agg(
        F.sum("remaining_balance").cast(MONEY).alias("balance"))
    placed = carry_forward(days, episodes(referrals), attributes)
    return (
        placed.where(F.col("episode").isNotNull() & ((F.col("is_fact") == 1) | F.col("is_empty")))
        .groupBy("patient_key", "episode")
        .agg(F.coalesce(F.sum("balance"), F.lit(0)).cast(MONEY).alias("remaining_balance"))
        .select("patient_key", "episode.*", "remaining_balance")
    )


def _day_counts(facts: DataFrame) -> DataFrame:
    return (
        facts.where(F.col("patient_key").isNotNull() & F.col("day").isNotNull())
        .groupBy("patient_key", "day")
        .agg(F.count("*").alias("facts"))
    )


def day_map(facts: DataFrame, eps: DataFrame, attributes: list[str]) -> DataFrame:
    """Episode attributes of each (``patient_key``, ``day``) among the facts, with the fact count."""
    return (
        carry_forward(_day_counts(facts), eps, attributes)
        .where("facts > 0")  # the days; with their number they are the counts that tell hot keys, shuffled once for both
        .select("patient_key", "day", "facts", *[F.col("episode")[a].alias(a) for a in attributes])
    )


def with_days(facts: DataFrame, patient: str, date: str) -> DataFrame:
    return facts.withColumns({
        "patient_key": match_key(F.col(patient)), "day": _day(F.col(date)),
    })


def assign_episodes(
    facts: DataFrame,
    eps: DataFrame,
    patient: str,
    date: str,
    attributes: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stamp the attributes of its episode on every fact; null where no episode covers it.

    The facts are shuffled once, on patient and day.
    """
    keyed = with_days(facts, patient, date)
    mapped = day_map(keyed, eps, attributes)
    return join_by_key(keyed, mapped, ["patient_key", "day"], "facts", hot_rows, counts=_day_counts(keyed)).drop("day")
