"""Measures of one transaction, in exact decimals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from episode_mart.schemas import MONEY

# The parts of each total.
PAYMENT_PARTS = ["personal_payments", "insurance_payments", "intl_payments"]
ADJUSTMENT_PARTS = [
    "charity", "intl_adjustment", "patient_balance_deemed_uncollectible",
    "charity_write_off", "financial_hardship", "appeals_exhausted_not_med_necessary",
    "deceased_patient", "no_authorization_obtained", "noncovered_service",
    "no_transfer_agreement_inpat", "outof_network", "prompt_pay_adjustment",
    "other_adjustments",
]
CHARITY_PARTS = ["charity", "charity_write_off", "financial_hardship"]
PATIENT_DIRECTIVE_PARTS = ["patient_balance_deemed_uncollectible", "deceased_patient"]
PAYER_DIRECTIVE_PARTS = [
    "appeals_exhausted_not_med_necessary", "no_authorization_obtained",
    "noncovered_service", "no_transfer_agreement_inpat", "outof_network",
]
# Null means zero in the cleaned table for these.
ZERO_DEFAULTS = [
    "charges", "personal_payments", "insurance_payments", "intl_payments",
    "contractual_adjustment", "refunds",
]
# The current file layout no longer carries these; the cleaned table keeps them at zero.
RETIRED = [
    "bal_trans_from_tiger", "bankruptcy", "indigent_charity", "bundled_ncci_edit",
    "charge_error", "global_period_not_billable", "charges_not_receivedfrom_site_timely",
    "g6017_not_covered", "mue_max_units_exceeded", "small_balance_adjustment",
    "collection_agency_payments", "collection_agency_refunds", "collection_agency_transfers",
    "collection_agency_adjustment", "collection_agency_fee_adjustment",
]


def or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(MONEY)


def total(parts: list[str]) -> Column:
    # Addition widens decimals; the cast back raises on overflow like a money column would.
    return reduce(add, [or_zero(p) for p in parts]).cast(MONEY)


def allowed() -> Column:
    return (or_zero("charges") - or_zero("contractual_adjustment")).cast(MONEY)


def total_payments() -> Column:
    return F.coalesce(F.col("payments"), total(PAYMENT_PARTS)).cast(MONEY)


def total_adjustments() -> Column:
    return F.coalesce(F.col("adjustments"), total(ADJUSTMENT_PARTS)).cast(MONEY)


def remaining_balance() -> Column:
    return (
        allowed() - total_payments() - total_adjustments() - or_zero("refunds")
    ).cast(MONEY)


def measures() -> dict[str, Column]:
    """Every measure by column name, over the raw money columns."""
    return {
        **{name: or_zero(name) for name in ZERO_DEFAULTS},
        "allowed": allowed(),
        "total_payments": total_payments(),
        "total_adjustments": total_adjustments(),
        "remaining_balance": remaining_balance(),
        "charity_adjs": total(CHARITY_PARTS),
        "other_adjs": or_zero("other_adjustments"),
        "international_adjs": F.col("intl_adjustment"),
        "patient_directive": total(PATIENT_DIRECTIVE_PARTS),
        "payer_directive": total(PAYER_DIRECTIVE_PARTS),
    }
