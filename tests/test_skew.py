"""Episode assignment and keyed joins against brute force, with hot keys and copies."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from episode_mart.operators import episodes as ep
from episode_mart.operators import patients
from episode_mart.operators.payers import episode_totals
from episode_mart.operators.skew import hot_keys_of, join_by_key

D = datetime.date


def random_rows(seed):
    rng = random.Random(seed)

    def day():
        return None if rng.random() < 0.1 else D(2024, 1, 1) + datetime.timedelta(days=rng.randrange(40))

    def patient():
        # One patient holds about half of all rows.
        return rng.choice(["hot"] * 5 + ["a", "B", "b ", "c", None])

    referrals = [(patient(), day()) for _ in range(40)]
    copies = [("hot", D(2024, 1, 20), 3)] * 60
    facts = [(patient(), day(), rng.randrange(100)) for _ in range(150)] + copies
    return referrals, facts


def key(p):
    return p.rstrip(" ").upper() if p is not None else None


def expected_start(referrals, patient, day):
    starts = sorted({d for p, d in referrals if key(p) == key(patient) and p is not None and d is not None})
    begun = [d for d in starts if day is not None and d <= day]
    return begun[-1] if begun and day < ep.OPEN_END else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_equals_brute_force(spark, seed):
    referrals, facts = random_rows(seed)
    rf = spark.createDataFrame(referrals, "patient_id string, referral_date date").repartition(3)
    fx = spark.createDataFrame(facts, "patient_number_updated string, from_dos date, v int").repartition(5)
    want = sorted((str(p), str(d), v, str(expected_start(referrals, p, d))) for p, d, v in facts)
    for hot_rows in (2, 50, 1_000_000):
        got = ep.assign_episodes(fx, ep.episodes(rf), "patient_number_updated", "from_dos",
                                 ["referral_date"], hot_rows)
        assert sorted((str(r.patient_number_updated), str(r.from_dos), r.v, str(r.referral_date))
                      for r in got.collect()) == want


def test_balances_add_up_and_episodes_are_disjoint(spark):
    referrals, facts = random_rows(7)
    rf = spark.createDataFrame(referrals, "patient_id string, referral_date date")
    tx = spark.createDataFrame(facts, "patient_number_updated string, from_dos date, v int").select(
        "*", F.col("v").cast("decimal(19,4)").alias("remaining_balance"),
        F.lit(1).cast("decimal(18,6)").alias("units"), F.lit("X").alias("insurance_name"))
    totals = episode_totals(rf, tx)
    assigned = sum(v for p, d, v in facts if expected_start(referrals, p, d))
    assert totals.agg(F.sum("remaining_balance")).first()[0] == assigned
    by_patient = {}
    for r in totals.collect():
        by_patient.setdefault(r.patient_key, []).append((r.referral_date, r.next_date))
    for spans in by_patient.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == ep.OPEN_END


def test_hot_keys_are_salted_and_the_rest_stays_exact(spark):
    facts = spark.createDataFrame([("x", i) for i in range(20)] + [("y", 1)] * 9 + [("z", 0), (None, 5)],
                                  "k string, v int").repartition(6)
    lookup = spark.createDataFrame([("x", 20, "X"), ("y", 9, "Y"), ("z", 1, None)], "k string, n int, name string")
    for hot_keys in (1, 2, 10):
        got = join_by_key(facts, lookup, ["k"], "n", hot_rows=4, hot_keys=hot_keys)
        assert got.columns == ["k", "v", "name"]
        counts = {r.k: (r["count"], r.name) for r in got.groupBy("k", "name").count().collect()}
        assert counts == {"x": (20, "X"), "y": (9, "Y"), "z": (1, None), None: (1, None)}


def test_demographics_equal_chained_left_joins(spark):
    rng = random.Random(5)
    ids = ["hot"] * 4 + ["a", "b", "c", "d", None]

    def rows(n, *values):
        return [(rng.choice(ids), *(rng.choice(v) for v in values)) for _ in range(n)]

    ai = rows(12, ["X", "Y"], ["Y", "N"])
    dob = rows(4, [D(2000, 1, 1), D(2001, 1, 1)])
    rp, ar = rows(3, ["S"]), rows(3, ["R"])
    want = []
    for p in {r[0] for t in (ai, dob, rp, ar) for r in t}:
        def of(t, width):
            found = [r[1:] for r in t if p is not None and r[0] == p]
            return found or [(None,) * width]
        want += [(p, d[0], a[0], r[0], i[0], i[1])
                 for d in of(dob, 1) for r in of(rp, 1) for a in of(ar, 1) for i in of(ai, 2)]
    frame = spark.createDataFrame
    for hot_rows in (2, 1_000_000):
        got = patients.demographics(
            frame(ai, "patient_id string, company_name string, primary_flag string"),
            frame(dob, "patient_id string, date_of_birth date"),
            frame(rp, "patient_id string, status_icon string"),
            frame(ar, "patient_id string, status_icon string"), hot_rows)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


@pytest.fixture
def no_aqe(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def spread(df, key, value):
    """Rows of a key in each partition."""
    return [r["count"] for r in df.where(F.col(key) == value).groupBy(F.spark_partition_id()).count().collect()]


def test_a_hot_key_in_one_input_partition_is_spread(no_aqe):
    facts = no_aqe.range(2_000).select(F.lit("x").alias("k"), "id").coalesce(1)
    lookup = no_aqe.createDataFrame([("x", 2_000, "X")], "k string, n long, name string")
    joined = join_by_key(facts, lookup, ["k"], "n", hot_rows=100)
    parts = spread(joined, "k", "x")
    assert sum(parts) == 2_000 and len(parts) >= 10 and max(parts) <= 500


def test_all_hot_keys_are_split_and_unkeyed_rows_are_not_shuffled(no_aqe):
    facts = no_aqe.range(40_000).select((F.col("id") % 2_000).cast("string").alias("k"), "id").unionByName(
        no_aqe.range(5).select(F.lit(None).cast("string").alias("k"), "id"))
    lookup = facts.groupBy("k").agg(F.count("*").alias("n")).where("k is not null").withColumn("name", F.upper("k"))
    hot = hot_keys_of(lookup, ["k"], "n", 5)
    assert hot.count() == 2_000 and hot.agg(F.min("_salts")).first()[0] == 4
    joined = join_by_key(facts, lookup, ["k"], "n", hot_rows=5)
    assert joined.count() == 40_005 and joined.where("k is null and name is null").count() == 5
    split = joined.where("k is not null").select("k", F.spark_partition_id().alias("p")).distinct().groupBy("k").count()
    assert split.where("count > 1").count() > 1_900


def test_a_patient_with_many_rows_on_both_sides_is_spread(no_aqe):
    one = no_aqe.range(2_000)
    birth = one.select(F.lit("p").alias("patient_id"), F.date_add(F.lit(D(2000, 1, 1)), F.col("id").cast("int")).alias("date_of_birth"))
    few = no_aqe.createDataFrame([("p", "S"), ("p", "T"), ("q", "S")], "patient_id string, status_icon string")
    insurance = no_aqe.createDataFrame([("p", "X", "Y")], "patient_id string, company_name string, primary_flag string")
    got = patients.demographics(insurance, birth, few, few, hot_rows=100)
    parts = spread(got, "patient_id", "p")
    assert sum(parts) == 8_000 and len(parts) >= 10 and max(parts) <= 2_000
    assert got.where("patient_id = 'q'").count() == 1


def test_the_patient_window_sees_no_payer(spark):
    rf = spark.createDataFrame([("a", D(2024, 1, 1))], "patient_id string, referral_date date")
    tx = spark.createDataFrame([("a", D(2024, 1, 2), "X", 1, 1)], "patient_number_updated string, from_dos date, "
                               "insurance_name string, remaining_balance int, units int")
    for df in (ep.episode_activity(rf, tx), ep.episode_balance(rf, tx)):
        windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
        assert windows and not any("payer" in w or "insurance" in w for w in windows)
