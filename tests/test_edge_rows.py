"""Edge rows with expected values, derived by reading the original rules."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from episode_mart.functions import coerce, money, text
from episode_mart.functions.dates import age_years
from episode_mart.operators import episodes as ep
from episode_mart.operators import payers
from episode_mart.operators.align import conform
from episode_mart.operators.rules import correct_ids, exclude_ids
from episode_mart.plans.clean import clean_referrals, clean_transactions
from episode_mart.plans.enrich import enriched_episodes, enrich_denials, enrich_referrals, enrich_transactions
from episode_mart.schemas import DAILY_TRANSACTIONS, RAW
from episode_mart.sources.tables import publish

D = datetime.date


def column(spark, values, function, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


IDS = [
    ("T-1001", "T1001", "T1001"), ("86-1234", "1234", "861234"), ("861234", "1234", "861234"),
    ("868612", "8612", "868612"), ("85777", "777", "85777"), ("85", "", "85"),
    ("86SNY-42", "SYN-42", "SYN-YN42"), ("86sny42", "SYN-42", "SYN-YN42"),
    ("SYN9", "SYN-9", "SYN-9"), ("SNYDER", "SYN-DER", "SYN-DER"), ("Sx", "SYN-", "SYN-"),
    ("  861", "  861", "  861"), (None, None, None), ("", "", ""), ("861234  ", "1234", "861234  "),
]


def test_identifiers(spark):
    assert column(spark, [i for i, _, _ in IDS], text.normalize_tx_id) == [t for _, t, _ in IDS]
    assert column(spark, [i for i, _, _ in IDS], text.normalize_rf_id) == [r for _, _, r in IDS]


NAMES = [
    ("Doe, Jane Q", "DOE", "JANE", "Q", "DOE,"),
    ("Doe,Jane Q", "DOE", "ANE", "Q", "DOE,JANE"),
    ("Doe,  Jane Q", "DOE", "JAN", "Q", "DOE,"),
    ("Doe, Jane", "DOE", "JANE", "", "DOE,"),
    ("Doe,", "DOE", "", "", "DOE,"),
    (",Jane", "", "ANE", "", ",JANE"),
    ("Doe Jane", None, None, None, "DOE"),
    ("  doe , jane  q r ", "DOE", "JANE", "Q R", ""),
    (None, None, None, None, None),
]


@pytest.mark.parametrize("place, function", list(enumerate(
    [text.last_name, text.first_name, text.middle_name, text.first_word], start=1)))
def test_names(spark, place, function):
    assert column(spark, [n[0] for n in NAMES], function) == [n[place] for n in NAMES]


def test_corrections_do_not_chain(spark):
    rules = spark.createDataFrame(
        [("post", "A", "B"), ("post", "B", "C"), ("post", "C", "D"), ("pre", "X", "Y")],
        "stage string, from_id string, to_id string")
    df = spark.createDataFrame([(v,) for v in ["A", "B", "C", "X", "a ", None]], "id string")
    got = [r.id for r in correct_ids(df, rules, "post", "id").collect()]
    assert sorted(got, key=str) == sorted(["B", "C", "D", "X", "B", None], key=str)


def test_exclusions_drop_null(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x ",), (None,)], "patient_number string")
    listed = spark.createDataFrame([("1",), ("X",)], "raw_id string")
    assert [r.patient_number for r in exclude_ids(df, listed).collect()] == ["2"]
    nothing = spark.createDataFrame([], "raw_id string")
    assert exclude_ids(df, nothing).count() == 3


def measures_of(spark, **values):
    row = {k: Decimal(v) if v is not None else None for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} decimal(19,4)" for k in row))
    return conform(df, RAW["TransactionsRaw"]).withColumns(money.measures()).first()


def test_measures(spark):
    r = measures_of(spark, payments=None, personal_payments=10, insurance_payments=None, intl_payments=5)
    assert r.total_payments == 15 and r.total_adjustments == 0 and r.insurance_payments == 0
    assert measures_of(spark, payments=7, personal_payments=10).total_payments == 7
    assert measures_of(spark, charges=None, contractual_adjustment=30).allowed == -30
    r = measures_of(spark, intl_adjustment=None, charity=None)
    assert r.international_adjs is None and r.charity is None and r.charity_adjs == 0
    r = measures_of(spark, charges=100, contractual_adjustment=10, payments=20, refunds=5,
                    charity=1, prompt_pay_adjustment=2, other_adjustments=3)
    assert r.total_adjustments == 6 and r.remaining_balance == 59
    assert r.other_adjs == 3


def test_age(spark):
    day = [("2000-02-29", "2023-02-28", 23), ("2000-02-29", "2023-02-27", 22),
           ("1990-06-15", "2026-06-14", 35), ("1990-06-15", "2026-06-15", 36)]
    df = spark.createDataFrame(day, "b string, a string, n int")
    got = df.select((age_years(F.to_date("b"), F.to_date("a")) == F.col("n")).alias("ok")).collect()
    assert all(r.ok for r in got)


def test_publish_rounds_truncates_and_checks_width(spark):
    df = spark.sql("""select cast(2.345 as decimal(19,4)) a, cast(-2.345 as decimal(19,4)) b,
                      cast(-3.9 as decimal(18,6)) u""")
    r = df.select(F.col("a").cast("decimal(12,2)"), F.col("b").cast("decimal(12,2)"), F.col("u").cast("int")).first()
    assert [str(r.a), str(r.b), r.u] == ["2.35", "-2.35", -3]
    from pyspark.sql import types as T
    narrow = T.StructType([T.StructField("s", T.StringType(), True, {"label": "S", "width": 3})])
    assert publish(spark.createDataFrame([("abc",)], "s string"), narrow).first().s == "abc"
    with pytest.raises(Exception, match="longer than 3"):
        publish(spark.createDataFrame([("abcd",)], "s string"), narrow).collect()


def test_coercion(spark):
    assert column(spark, ["Yes", " t ", "on", "1", "1.0", "No", "off", "0", "", "maybe", "2", None],
                  coerce.to_bool) == [True] * 5 + [False] * 3 + [None] * 4
    assert column(spark, ["12", "12.0", " 7 ", "1e3", "12.5", "abc", "99999999999", "", "1d", "NaN"],
                  coerce.to_int) == [12, 12, 7, 1000] + [None] * 6
    stamps = column(spark, ["1752-12-31", "1753-01-01", "2/29/2024", "2/29/2023", "3/4/2024 1:05 PM",
                            "20240305", "5-Mar-2024", "2024-03-05T01:02:03", "soon", None],
                    lambda c: F.date_format(coerce.to_datetime(c), "yyyy-MM-dd HH:mm:ss"))
    assert stamps == [None, "1753-01-01 00:00:00", "2024-02-29 00:00:00", None, "2024-03-04 13:05:00",
                      "2024-03-05 00:00:00", "2024-03-05 00:00:00", "2024-03-05 01:02:03", None, None]
    assert column(spark, ["1752-12-31", "2024-03-05 23:59:59"], coerce.to_date) == [
        D(1752, 12, 31), D(2024, 3, 5)]
    schema = RAW["TransactionsRaw"]
    assert column(spark, ["x" * 300], lambda c: coerce.coerce(c, schema["insurance_name"])) == ["x" * 300]
    assert column(spark, ["x" * 300], lambda c: coerce.coerce(c, DAILY_TRANSACTIONS["insurance_name"])) == ["x" * 255]
    assert column(spark, ["8601234.0", "86-1.0"], lambda c: coerce.coerce(c, schema["patient_number"])) == [
        "8601234", "86-1.0"]
    assert column(spark, ["1.23456", "$3"], lambda c: coerce.coerce(c, schema["charges"])) == [
        Decimal("1.2346"), None]


@pytest.fixture(scope="module")
def episode_rows(spark):
    rf = spark.createDataFrame(
        [("P", D(2024, 1, 10)), ("P", D(2024, 3, 1)), ("p ", D(2024, 3, 1)), ("P", None),
         ("Q", D(2024, 1, 1)), ("N", D(2024, 1, 1)), (None, D(2024, 1, 1))],
        "patient_id string, referral_date date")
    tx = spark.createDataFrame(
        [("P", D(2024, 1, 9), 5, "A", 1), ("P", D(2024, 1, 10), 10, "A", 1),
         ("P", D(2024, 2, 29), 20, "B", 9), ("P", D(2024, 3, 1), 40, None, 1), ("P", None, 80, "A", 1),
         ("Q", D(2023, 1, 1), 7, "A", 1), ("P", D(9999, 12, 31), 160, "A", 1), (None, D(2024, 1, 10), 1, "A", 1)],
        "patient_number_updated string, from_dos date, b int, insurance_name string, u int"
    ).select("*", F.col("b").cast("decimal(19,4)").alias("remaining_balance"),
             F.col("u").cast("decimal(18,6)").alias("units"))
    return rf, tx


def test_visit_numbers(spark, episode_rows):
    rf, _ = episode_rows
    got = {(r.patient_id, r.referral_date): r.visit_number for r in ep.with_visit_number(rf).collect()}
    assert got == {("P", None): None, ("P", D(2024, 1, 10)): 2, ("P", D(2024, 3, 1)): 3,
                   ("p ", D(2024, 3, 1)): 3, ("Q", D(2024, 1, 1)): 1, ("N", D(2024, 1, 1)): 1,
                   (None, D(2024, 1, 1)): None}


def test_balances_and_payers(spark, episode_rows):
    rf, tx = episode_rows
    got = {(r.patient_key, r.referral_date): (r.remaining_balance, r.updated_primary, r.updated_secondary)
           for r in payers.episode_totals(rf, tx).collect()}
    assert got == {
        ("P", D(2024, 1, 10)): (30, "B", "A"),
        ("P", D(2024, 3, 1)): (40, "Self-Pay", None),   # unnamed payer on top
        ("Q", D(2024, 1, 1)): (0, "Self-Pay", None),    # transactions, none in the episode
        ("N", D(2024, 1, 1)): (0, None, None),          # no transactions at all
    }


def test_facts_outside_episodes(spark, episode_rows):
    rf, tx = episode_rows
    got = ep.assign_episodes(tx, ep.episodes(rf), "patient_number_updated", "from_dos",
                             ["referral_date"], hot_rows=1)
    by_balance = {r.b: r.referral_date for r in got.collect()}
    assert by_balance == {5: None, 10: D(2024, 1, 10), 20: D(2024, 1, 10), 40: D(2024, 3, 1), 80: None,
                          7: None, 160: None, 1: None}


def test_payer_rank(spark):
    rf = spark.createDataFrame([("P", D(2024, 1, 1))], "patient_id string, referral_date date")
    lines = ([("ZED", 50)] + [("MID", 4)] * 8 + [("mid ", 8)] + [("ABC", 4), ("abc", 3), ("ABC", 3)]
             + [(None, 3), (None, 2)])
    tx = spark.createDataFrame([("P", D(2024, 1, 2), p, u) for p, u in lines],
                               "patient_number_updated string, from_dos date, insurance_name string, u int"
                               ).select("*", F.col("u").cast("decimal(18,6)").alias("units"),
                                        F.lit(0).cast("decimal(19,4)").alias("remaining_balance"))
    ranked = payers.rank_payers(ep.episode_activity(rf, tx)).orderBy("payer_rank").collect()
    assert [(r.payer_key, int(r.units), r.lines) for r in ranked] == [
        ("ZED", 50, 1), ("MID", 40, 9), ("ABC", 10, 3), (None, 5, 0)]
    top = payers.episode_totals(rf, tx).first()
    assert (top.updated_primary, top.updated_secondary) == ("ZED", "ABC")


def test_crosswalk_duplicates_and_case(spark):
    crosswalk = spark.createDataFrame(
        [("Acme", "B", "b", "r2"), ("ACME ", "A", "z", "r1"), ("Other", "C", None, None)],
        "insurance_product_detail string, category_type string, insurance_cat_abv string, payer_roll_up string")
    df = spark.createDataFrame([("acme",), ("none",), (None,)], "payer string")
    got = {r.payer: (r.insurance_cat, r.insurance_abv, r.payer_roll_up)
           for r in payers.with_payer(df, crosswalk, "payer").collect()}
    assert got == {"acme": ("A", "z", "r1"), "none": (None,) * 3, None: (None,) * 3}


def test_stages_end_in_their_layouts(spark):
    raw_tx = spark.createDataFrame(
        [("86-7", "Doe, Jane Q", D(2024, 1, 5), "Acme", Decimal(100))],
        "patient_number string, patient_full_name string, from_dos date, insurance_name string, charges decimal(19,4)"
    ).withColumn("units", F.lit(2).cast("decimal(18,6)"))
    raw_rf = spark.createDataFrame([("7", "Jane Doe", D(2024, 1, 1))],
                                   "patient_id string, patient_name string, referral_date date")
    none = spark.createDataFrame([], "raw_id string")
    rules = spark.createDataFrame([], "stage string, from_id string, to_id string")
    crosswalk = spark.createDataFrame(
        [("Acme", "Cat", "C", "Roll")],
        "insurance_product_detail string, category_type string, insurance_cat_abv string, payer_roll_up string")
    tx = clean_transactions(raw_tx, none, rules, D(2026, 1, 1))
    assert [c for c in tx.columns if c != "patient_key"] == DAILY_TRANSACTIONS.names
    assert len(DAILY_TRANSACTIONS) == 81
    rf = clean_referrals(raw_rf)
    eps = enriched_episodes(rf, tx, crosswalk)
    t = enrich_transactions(tx, eps).first()
    assert set(tx.columns) == set(enrich_transactions(tx, eps).columns)
    assert (t.trans_mrn, t.primary_insurance, t.insurance_abv, t.insurance_cat, t.payer_roll_up) == (
        "7-1", "Acme", "C", "Cat", "Roll")
    r = enrich_referrals(rf, eps).first()
    assert (r.remaining_balance, r.updated_primary, r.primary_insurance_cat, r.trans_mrn, r.first_name) == (
        100, "Acme", "Cat", "7-1", "JANE")
    denials = spark.createDataFrame([("7", D(2024, 2, 1)), ("8", D(2024, 2, 1)), ("s-7", None)],
                                    "patient_account string, dos date")
    assert {d.patient_account: d.visit_number for d in enrich_denials(denials, eps).collect()} == {
        "7": 1, "8": None, "s-7": None}
    assert enrich_denials(denials, eps, normalize=True).columns == ["patient_account", "dos", "visit_number"]
