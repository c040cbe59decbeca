"""One query per operator over the given tables; names are those of the operator inventory."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episode_mart.checks.adapters import spark_view
from episode_mart.functions import coerce, money, text
from episode_mart.functions.dates import age_years
from episode_mart.operators import episodes as ep
from episode_mart.operators import patients, payers
from episode_mart.operators.align import align, conform, validate
from episode_mart.operators.keys import with_key
from episode_mart.operators.profile import column_profiles, sample_head
from episode_mart.operators.rules import correct_ids, exclude_ids
from episode_mart.plans import catalog, clean, enrich, ingest, marts
from episode_mart.plans.refresh import read_mart, refresh
from episode_mart.schemas import RAW
from episode_mart.sources import versions
from episode_mart.sources.files import read_csv, read_files, scan_folder
from episode_mart.sources.tables import scratch_dir, shuffles_freed, table_schema, write

AS_OF = datetime.date(2026, 1, 1)
ROW = ("l_orderkey", "l_linenumber")
Query = Callable[[SparkSession, str], DataFrame]


# --- inputs -----------------------------------------------------------------

def _measured(view: DataFrame) -> DataFrame:
    df = conform(view, RAW["TransactionsRaw"], ROW)
    return df.withColumns(money.measures())


def _transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with normalized id and measures, without rule tables."""
    return _measured(spark_view(spark, sf, "raw_transactions")).withColumn(
        "patient_number_updated", text.normalize_tx_id(F.col("patient_number")))


def _staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows written and read back, as the refresh does with its stage tables: what reads them more than once
    does not make them anew each time, and the shuffles behind them take no disk any more."""
    path = scratch_dir(spark)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """What episodes take from the transactions, as a stage table."""
    return _staged(spark, _transactions(spark, sf).select(
        *ROW, "patient_number_updated", "from_dos", "insurance_name", "units", "remaining_balance"))


def _referrals(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "raw_referrals").withColumn(
        "patient_id", text.normalize_rf_id(F.col("patient_id")))


def _enriched(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    return _staged(spark, enrich.enriched_episodes(
        _referrals(spark, sf), _facts(spark, sf) if facts is None else facts, spark_view(spark, sf, "payer_crosswalk")))


def _cleaned(spark: SparkSession, sf: str, view: str = "wide_transactions") -> DataFrame:
    return clean.clean_transactions(
        spark_view(spark, sf, view), spark_view(spark, sf, "id_exclusions"),
        spark_view(spark, sf, "id_corrections"), AS_OF, ROW, lambda ids: _staged(spark, ids))


def _export(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions as the text columns of an inbound file."""
    return spark_view(spark, sf, "raw_transactions").select(
        F.col("patient_number").alias(" PATIENTNUMBER"),
        F.col("patient_full_name").alias("Patient Full-Name"),
        F.date_format("from_dos", "M/d/yyyy").alias("FromDos"),
        F.col("insurance_name").alias("Insurence Name"),
        F.col("l_orderkey").cast("string").alias("voucher "),
        F.col("l_linenumber").cast("string").alias("Modifier"),
        F.col("units").cast("string").alias("Units"),
        F.col("charges").cast("string").alias("charges"),
        F.col("payments").cast("string").alias("Payments"),
        F.lit("x").alias("Internal Remark"),
    )


_EXPORTED = ["patient_number", "patient_full_name", "from_dos", "insurance_name", "voucher",
             "modifier", "units", "charges", "payments"]


def _write_csv(df: DataFrame, path: str) -> None:
    """As many files as the rows need: none holds more than a partition of the advisory size."""
    df.hint("rebalance").write.option("header", True).option("escape", '"').csv(path)


# --- sources and sinks --------------------------------------------------------

def scan(spark, sf):
    """Four exported files of lines. An export is a folder of as many parts as its rows need, and counts once."""
    folder = scratch_dir(spark)
    by_rows = F.pmod(F.xxhash64("`voucher `", "Modifier"), F.lit(4))
    _export(spark, sf).withColumn("export", by_rows).hint("rebalance").write.partitionBy("export").csv(folder)
    found = scan_folder(spark, folder, ["*.csv", "*.xlsx"])
    lines = spark.read.text([r.path for r in found.collect()])
    export = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return lines.agg(F.count("*").alias("lines"), F.count_distinct(export).alias("files"))


def csv_round_trip(spark, sf):
    folder = scratch_dir(spark)
    export = _export(spark, sf)
    _write_csv(export, folder)
    df = read_csv(spark, [folder], export.columns)
    return align(df, RAW["TransactionsRaw"]).select(_EXPORTED)


def csv_line_breaks(spark, sf):
    """As ``csv_round_trip``, with names over two lines: quoted values that hold line breaks."""
    folder = scratch_dir(spark)
    export = _export(spark, sf)
    name = "Patient Full-Name"
    _write_csv(export.withColumn(name, F.replace(F.col(f"`{name}`"), F.lit(", "), F.lit(",\n"))), folder)
    files = read_files(spark, [r.path for r in scan_folder(spark, folder, ["*.csv"]).collect()])
    frames = [align(df, RAW["TransactionsRaw"]).select(_EXPORTED) for df in files.frames]
    return reduce(DataFrame.unionByName, frames)


def coercion_losses(spark, sf):
    """Texts of a loaded folder that became null, by column."""
    base = scratch_dir(spark)
    _write_csv(spark_view(spark, sf, "texts").select(
        F.col("l_orderkey").cast("string").alias("PatientNumber"), F.col("int_text").alias("Voucher"),
        F.col("number_text").alias("Charges"), F.col("number_text").alias("NPI"), F.col("date_text").alias("FromDOS")), f"{base}/in")
    ingest.load_table(spark, {"folder": f"{base}/in", "target_table": "TransactionsRaw", "file_patterns": ["*.csv"]}, base)
    return ingest.lost_values(spark, base, "TransactionsRaw")


def ingest_all(spark, sf):
    base = scratch_dir(spark)
    _write_csv(_export(spark, sf), f"{base}/inbound/TransactionsRaw")
    _write_csv(spark_view(spark, sf, "patient_dob"), f"{base}/inbound/PatientDOB")
    specs = [
        {"folder": f"{base}/inbound/TransactionsRaw", "target_table": "db.dbo.TransactionsRaw",
         "file_patterns": ["*.csv"], "upload_mode": "append"},
        {"folder": f"{base}/inbound/PatientDOB", "target_table": "db.dbo.[PatientDOB]",
         "file_patterns": ["*.csv"], "upload_mode": "delete"},
        {"folder": f"{base}/inbound/AtRisk", "target_table": "AtRisk"},
        {"folder": f"{base}/inbound/Unset", "target_table": ""},
    ]
    for _ in range(2):  # loading the same folders again changes nothing
        ingest.ingest_all(spark, specs, base)
    try:  # nor does a load that writes its rows and then fails to commit
        ingest.commit_load(spark, base, "TransactionsRaw", versions.Snapshot(),
                           ingest.raw_table(spark, base, "TransactionsRaw"), False)
    except versions.Conflict:
        pass
    tables = [
        ingest.raw_table(spark, base, "TransactionsRaw").select(
            F.lit("TransactionsRaw").alias("table_name"), F.col("patient_number").alias("patient"),
            F.col("from_dos").alias("day"), F.col("charges").cast("decimal(19,4)").alias("charges")),
        ingest.raw_table(spark, base, "PatientDOB").select(
            F.lit("PatientDOB"), F.col("patient_id"), F.col("date_of_birth"),
            F.lit(None).cast("decimal(19,4)")),
        ingest.raw_table(spark, base, "AtRisk").select(
            F.lit("AtRisk"), F.col("patient_id"), F.lit(None).cast("date"),
            F.lit(None).cast("decimal(19,4)")),
    ]
    return tables[0].union(tables[1]).union(tables[2])


def sink(spark, sf, mode):
    path = scratch_dir(spark)
    df = spark_view(spark, sf, "denial_data")
    for _ in range(2):
        write(df, path, mode)
    return versions.read_table(spark, path)


def clean_and_save(spark, sf):
    base = scratch_dir(spark)
    dob = spark_view(spark, sf, "patient_dob").select(
        F.col("date_of_birth").alias("Date of Birth"), F.col("patient_id").alias("patient id"),
        F.lit("r").alias("Remark"))
    _write_csv(dob, f"{base}/in")
    ingest.clean_and_save(spark, f"{base}/in/*.csv", f"{base}/out")
    out = read_csv(spark, [f"{base}/out"], ["PatientId", "DateOfBirth"])
    return align(out, RAW["PatientDOB"])


def route_by_name(spark, sf):
    base = scratch_dir(spark)
    for name, view in [("Payer Crosswalk", "payer_crosswalk"), ("ICD crosswalk", "icd_crosswalk"),
                       ("Patient DOB 2026", "patient_dob"), ("research_patient", "research_patient"),
                       ("at-risk list", "at_risk"), ("Active Insurance", "active_insurance"),
                       ("Referrals", "raw_referrals")]:
        spark_view(spark, sf, view).select(F.lit("row")).write.text(f"{base}/{name}.txt")
    lines = spark.read.text(f"{base}/*.txt").select(
        F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -2).alias("file_name"))
    per_file = lines.groupBy("file_name").agg(F.count("*").alias("lines"))
    return ingest.route_by_name(per_file, "file_name")


def surrogate_key(spark, sf):
    keyed = with_key(spark, f"{sf}/lineitem.parquet", "row_id")
    return keyed.select("row_id")


def catalog_schema(spark, sf):
    """Columns of a registered table with what they hold."""
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("episode_mart_lineitem")
    columns = table_schema(spark, "episode_mart_lineitem").select("position", "column_name", "data_type")
    return columns.join(
        column_profiles(spark.table("episode_mart_lineitem")).select("column_name", "rows", "nulls"), "column_name")


def catalog_tables(spark, sf):
    """The engine's own tables after some loads, one of them in two parts that are compacted."""
    base = scratch_dir(spark)
    for table, view in _LOADED.items():
        df = spark_view(spark, sf, view)
        odd = F.pmod(F.xxhash64(*df.columns), F.lit(2)) == 1
        for part in ([df.where(odd), df.where(~odd)] if table == "AtRisk" else [df]):
            _load(spark, base, table, part)
    ingest.compact(spark, base, "AtRisk")
    return catalog.list_tables(spark, base, rows=True).select("layer", "table_name", "version", "loads", "rows")


# --- alignment, coercion, profile ---------------------------------------------

def _aligned(spark, sf) -> DataFrame:
    return align(_export(spark, sf), RAW["TransactionsRaw"])


def align_exact(spark, sf):
    return _aligned(spark, sf).select("patient_number", "from_dos", "voucher", "modifier", "charges")


def align_fuzzy(spark, sf):
    return _aligned(spark, sf).select("patient_full_name", "insurance_name", "voucher", "modifier")


def align_missing(spark, sf):
    return _aligned(spark, sf).select("voucher", "modifier", "bill_date", "npi", "refunds", "procedure_code")


def align_extra(spark, sf):
    df = _aligned(spark, sf)
    unexpected = [c for c in df.columns if c not in RAW["TransactionsRaw"].names]
    return df.select("voucher", "modifier", F.lit(len(df.columns)).alias("columns"),
                     F.lit(len(unexpected)).alias("unexpected"))


def _coerced(name: str, column: str, function) -> Query:
    def query(spark, sf):
        return spark_view(spark, sf, "texts").select(
            *ROW, function(F.col(column)).alias(name))
    return query


def coerce_number(spark, sf):
    cents = F.col("number_text")
    return spark_view(spark, sf, "texts").select(
        *ROW,
        coerce.coerce(cents, RAW["TransactionsRaw"]["npi"]).alias("as_float"),
        coerce.coerce(cents, RAW["TransactionsRaw"]["charges"]).alias("as_money"))


def validate_headers(spark, sf):
    file = spark_view(spark, sf, "active_insurance").select(
        F.col("patient_id").alias("PATIENTID"), F.col("company_name").alias("Company Nam"),
        F.col("primary_flag").alias("Zone"))
    return validate(file, "ActiveInsurance")


def _profiled(spark, sf) -> DataFrame:
    return column_profiles(spark_view(spark, sf, "raw_transactions"),
                           {"patient_full_name": 14, "patient_number": 6})


def profile_empty_rows(spark, sf):
    view = spark_view(spark, sf, "raw_transactions").select(
        "patient_full_name", "insurance_name", "payments", "refunds", "charity", "personal_payments")
    return column_profiles(view).select("empty_rows").distinct()


def head(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return sample_head(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), 10, "o_orderkey")


# --- transactions ---------------------------------------------------------------

def tx_exclude(spark, sf):
    return exclude_ids(spark_view(spark, sf, "raw_transactions"),
                       spark_view(spark, sf, "id_exclusions")).select("patient_number", *ROW)


def _wide(*columns: str) -> Query:
    def query(spark, sf):
        return _measured(spark_view(spark, sf, "wide_transactions")).select(*ROW, *columns)
    return query


def tx_constants(spark, sf):
    return _cleaned(spark, sf).select(*ROW, *money.RETIRED, "practice_name", "date_uploaded")


def id_correct_pre(spark, sf):
    return correct_ids(spark_view(spark, sf, "raw_transactions"),
                       spark_view(spark, sf, "id_corrections"), "pre", "patient_number"
                       ).select("patient_number", *ROW)


def id_correct_post(spark, sf):
    return correct_ids(_transactions(spark, sf), spark_view(spark, sf, "id_corrections"),
                       "post", "patient_number_updated").select("patient_number_updated", *ROW)


def name_parse(spark, sf):
    name = F.col("patient_full_name")
    return spark_view(spark, sf, "raw_transactions").select(
        *ROW, text.last_name(name).alias("last_name"), text.first_name(name).alias("first_name"),
        text.middle_name(name).alias("middle_name"))


# --- episodes ---------------------------------------------------------------------

def episode_balance(spark, sf):
    return ep.episode_balance(_referrals(spark, sf), _transactions(spark, sf)).select(
        "patient_key", "referral_date", "next_date", "remaining_balance")


def _visits(spark, sf) -> DataFrame:
    return ep.episodes(_referrals(spark, sf))


def tx_assign_episode(spark, sf):
    facts = _staged(spark, _transactions(spark, sf).select(*ROW, "patient_number_updated", "from_dos"))
    return ep.assign_episodes(
        facts, _visits(spark, sf), "patient_number_updated", "from_dos",
        ["referral_date", "visit_number"],
    ).select(*ROW, "patient_key", "from_dos", "referral_date", "visit_number")


def tx_assign_episode_window(spark, sf):
    facts = ep.with_days(_transactions(spark, sf), "patient_number_updated", "from_dos")
    return ep.day_map(facts, _visits(spark, sf), ["referral_date", "visit_number"])


def denial_assign_episode(spark, sf):
    return enrich.enrich_denials(spark_view(spark, sf, "denial_data"), _visits(spark, sf))


def visit_key(spark, sf):
    return ep.with_visit_number(_referrals(spark, sf)).select(
        "referral_key", text.visit_key(F.col("patient_id"), F.col("visit_number")).alias("trans_mrn"))


def _rf_payer(prefix: str) -> Query:
    def query(spark, sf):
        enriched = enrich.enrich_referrals(_referrals(spark, sf), _enriched(spark, sf))
        return enriched.select("referral_key", f"updated_{prefix}",
                               *[f"{prefix}_{c}" for c in payers.CATEGORIES])
    return query


def tx_payer_lookup(spark, sf):
    view = spark_view(spark, sf, "raw_transactions").select(*ROW, "insurance_name")
    return payers.with_payer(view, spark_view(spark, sf, "payer_crosswalk"), "insurance_name")


def rf_with_transactions(spark, sf):
    return payers.with_transactions(_referrals(spark, sf), _transactions(spark, sf)).select(
        "referral_key", "patient_id")


def payer_units(spark, sf):
    return payers.payer_units(_referrals(spark, sf), _facts(spark, sf))


def payer_rank(spark, sf):
    activity = ep.episode_activity(_referrals(spark, sf), _facts(spark, sf))
    return payers.rank_payers(activity).select(
        "patient_key", "episode.referral_date", "payer", "payer_rank")


def top_payers(spark, sf):
    return payers.episode_totals(_referrals(spark, sf), _facts(spark, sf)).select(
        "patient_key", "referral_date", "updated_primary", "updated_secondary")


# --- marts and pipelines ------------------------------------------------------------

def _four_lists(spark, sf) -> list[DataFrame]:
    return [spark_view(spark, sf, v) for v in
            ("active_insurance", "patient_dob", "research_patient", "at_risk")]


def mart_fractions(spark, sf):
    return marts.mart_fractions(conform(spark_view(spark, sf, "fractions"), RAW["Fractions"]))


def mart_referrals(spark, sf):
    dobs = spark_view(spark, sf, "patient_dob").select(
        text.match_key(F.col("patient_id")).alias("patient_key"), F.col("date_of_birth").alias("_dob"))
    referrals = clean.clean_referrals(spark_view(spark, sf, "raw_referrals"))
    with_dob = referrals.join(dobs, "patient_key", "left").withColumn("dob", F.col("_dob"))
    return marts.mart_referrals(enrich.enrich_referrals(with_dob, _enriched(spark, sf)), AS_OF)


def mart_billing(spark, sf):
    return marts.mart_billing(_cleaned(spark, sf))


def age(spark, sf):
    return spark_view(spark, sf, "patient_dob").select(
        "patient_id", age_years(F.col("date_of_birth"), F.lit(AS_OF)).alias("age"))


def clean_transactions(spark, sf):
    return _cleaned(spark, sf).select(
        *ROW, "patient_number", "patient_number_updated", "last_name", "first_name", "middle_name",
        "from_dos", "allowed", "total_payments", "total_adjustments", "remaining_balance")


def rf_clean(spark, sf):
    return clean.referral_rows(spark_view(spark, sf, "raw_referrals"), ("referral_key",)).select(
        "referral_key", "patient_id", "patient_name", "referral_date", "final_approval", "state",
        "dob", "at_risk", "sim_date")


def clean_referrals(spark, sf):
    return clean.clean_referrals(spark_view(spark, sf, "raw_referrals"), ("referral_key",)).select(
        "referral_key", "patient_id", "first_name", "referral_date", "visit_number", "trans_mrn")


def enrich_referrals(spark, sf):
    return enrich.enrich_referrals(_referrals(spark, sf), _enriched(spark, sf)).select(
        "referral_key", "remaining_balance", "updated_primary", "updated_secondary",
        "primary_insurance_cat", "secondary_insurance_cat")


def enrich_transactions(spark, sf):
    facts = _facts(spark, sf)
    return enrich.enrich_transactions(facts, _enriched(spark, sf, facts)).select(
        *ROW, "patient_number_updated", "visit_number", "trans_mrn", "primary_insurance",
        "secondary_insurance", "insurance_abv", "insurance_cat", "payer_roll_up")


_LOADED = {
    "TransactionsRaw": "raw_transactions", "ReferralRaw": "raw_referrals", "DenialData": "denial_data",
    "PayerCrosswalk": "payer_crosswalk", "ActiveInsurance": "active_insurance", "PatientDOB": "patient_dob",
    "AtRisk": "at_risk", "ResearchPatient": "research_patient", "Fractions": "fractions", "ICD_Crosswalk": "icd_crosswalk"}


def _load(spark, base, table, df) -> None:
    ingest.commit_load(spark, base, table, ingest.loads(spark, base, table), conform(df, RAW[table], absent=False), False)


def _load_rules(spark, sf, base) -> None:
    for rules in ("id_exclusions", "id_corrections"):
        write(spark_view(spark, sf, rules), f"{base}/rules/{rules}", "replace")


def _billing(spark, base) -> DataFrame:
    """The billing table without its generated key."""
    return read_mart(spark, base, "RCB_Billing").select(
        "patient_number", "dos", "insurance_name", "insurance_abv", "units", "charges",
        "total_payments", "remaining_balance")


def refreshed(spark, sf):
    """Loaded raw tables through all stages."""
    base = scratch_dir(spark)
    for table, view in _LOADED.items():
        _load(spark, base, table, spark_view(spark, sf, view))
    _load_rules(spark, sf, base)
    refresh(spark, base, AS_OF, labels=False)
    return _billing(spark, base)


def refreshed_by_changes(spark, sf):
    """The same rows in two loads of transactions, the second with some patients' rows, and a refresh after each."""
    base = scratch_dir(spark)
    late = F.pmod(F.xxhash64("patient_number"), F.lit(97)) == 0
    for table, view in _LOADED.items():
        df = spark_view(spark, sf, view)
        _load(spark, base, table, df.where(~late) if table == "TransactionsRaw" else df)
    _load_rules(spark, sf, base)
    refresh(spark, base, AS_OF, labels=False)
    _load(spark, base, "TransactionsRaw", spark_view(spark, sf, "raw_transactions").where(late))
    refresh(spark, base, AS_OF, labels=False)
    return _billing(spark, base)


QUERIES: dict[str, Query] = {
    # sources and sinks
    "scan_folder": scan,
    "csv_round_trip": csv_round_trip,
    "csv_line_breaks": csv_line_breaks,
    "coercion_losses": coercion_losses,
    "ingest_all": ingest_all,
    "sink_append": partial(sink, mode="append"),
    "sink_replace": partial(sink, mode="replace"),
    "clean_and_save": clean_and_save,
    "route_by_name": route_by_name,
    "surrogate_key": surrogate_key,
    "catalog_schema": catalog_schema,
    "catalog_tables": catalog_tables,
    # alignment, coercion, profile
    "align_exact": align_exact,
    "align_fuzzy": align_fuzzy,
    "align_missing": align_missing,
    "align_extra": align_extra,
    "coerce_int": _coerced("as_int", "int_text", coerce.to_int),
    "coerce_number": coerce_number,
    "coerce_bool": _coerced("as_bool", "bool_text", coerce.to_bool),
    "coerce_datetime": _coerced(
        "as_text", "date_text", lambda c: F.date_format(coerce.to_datetime(c), "yyyy-MM-dd HH:mm:ss")),
    "coerce_date": _coerced("as_date", "date_text", coerce.to_date),
    "coerce_datetime_range": _coerced(
        "in_range", "date_text", lambda c: coerce.to_datetime(c).isNotNull()),
    "coerce_truncate": _coerced("as_text", "number_text", lambda c: coerce.to_text(c, 5)),
    "validate_headers": validate_headers,
    "profile_rows": lambda spark, sf: _profiled(spark, sf).select("column_name", "rows"),
    "profile_nulls": lambda spark, sf: _profiled(spark, sf).select("column_name", "nulls"),
    "profile_sparse_columns": lambda spark, sf: _profiled(spark, sf).where("is_sparse").select("column_name"),
    "profile_overwidth": lambda spark, sf: _profiled(spark, sf).select("column_name", "over_width"),
    "profile_empty_rows": profile_empty_rows,
    "sample_head": head,
    # transactions
    "tx_exclude": tx_exclude,
    "tx_measures": _wide(*money.ZERO_DEFAULTS, "allowed"),
    "tx_constants": tx_constants,
    "tx_total_payments": _wide("total_payments"),
    "tx_total_adjustments": _wide("total_adjustments"),
    "tx_remaining_balance": _wide("remaining_balance"),
    "tx_adjustment_groups": _wide("charity_adjs", "other_adjs", "international_adjs",
                                  "patient_directive", "payer_directive"),
    "id_correct_pre": id_correct_pre,
    "id_tx_normalize": lambda spark, sf: _transactions(spark, sf).select(
        *ROW, "patient_number", "patient_number_updated"),
    "id_rf_normalize": lambda spark, sf: _referrals(spark, sf).select("referral_key", "patient_id"),
    "id_correct_post": id_correct_post,
    "name_parse": name_parse,
    "name_first_word": lambda spark, sf: spark_view(spark, sf, "raw_referrals").select(
        "referral_key", text.first_word(F.col("patient_name")).alias("first_name")),
    "visit_key": visit_key,
    # episodes and payers
    "episodes": lambda spark, sf: _visits(spark, sf).drop("referrals"),
    "rf_visit_number": lambda spark, sf: ep.with_visit_number(_referrals(spark, sf)).select(
        "referral_key", "patient_id", "referral_date", "visit_number"),
    "episode_balance": episode_balance,
    "tx_assign_episode": tx_assign_episode,
    "tx_assign_episode_window": tx_assign_episode_window,
    "denial_assign_episode": denial_assign_episode,
    "payer_units": payer_units,
    "payer_rank": payer_rank,
    "top_payers": top_payers,
    "rf_payer_primary": _rf_payer("primary"),
    "rf_payer_secondary": _rf_payer("secondary"),
    "tx_payer_lookup": tx_payer_lookup,
    "rf_with_transactions": rf_with_transactions,
    # marts
    "mart_fractions": mart_fractions,
    "mart_icd": lambda spark, sf: marts.mart_icd(spark_view(spark, sf, "icd_crosswalk")),
    "mart_referrals": mart_referrals,
    "mart_payer": lambda spark, sf: marts.mart_payer(spark_view(spark, sf, "payer_crosswalk")),
    "mart_billing": mart_billing,
    "mart_patients": lambda spark, sf: marts.mart_patients(patients.demographics(*_four_lists(spark, sf))),
    "all_patients": lambda spark, sf: patients.all_patients(*_four_lists(spark, sf)),
    "age_years": age,
    # pipelines
    "rf_clean": rf_clean,
    "clean_transactions": clean_transactions,
    "clean_referrals": clean_referrals,
    "enrich_referrals": enrich_referrals,
    "enrich_transactions": enrich_transactions,
    "refresh": refreshed,
    "refresh_changes": refreshed_by_changes,
}
