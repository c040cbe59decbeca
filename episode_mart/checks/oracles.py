"""The queries' results in plain SQL over the given tables, written independently of the engine."""

from __future__ import annotations

import re

from episode_mart.checks.adapters import VIEWS, oracle_view

_AS_OF = "date '2026-01-01'"
_M = "decimal(19,4)"


def _tx_id(c: str) -> str:
    """Normalized billing id, step by step."""
    syn = f"regexp_replace(replace({c}, '-', ''), 'SNY', 'SYN', 'gi')"
    bare = f"(case when left({syn}, 2) in ('86', '85') then substr({syn}, 3) else {syn} end)"
    return f"(case when upper(left({bare}, 1)) = 'S' then 'SYN-' || substr({bare}, 4) else {bare} end)"


_PAYMENT = f"""cast(coalesce(payments, coalesce(personal_payments, 0)
    + coalesce(insurance_payments, 0) + coalesce(intl_payments, 0)) as {_M})"""
_ADJUSTMENT = f"""cast(coalesce(adjustments, coalesce(charity, 0) + coalesce(intl_adjustment, 0)
    + coalesce(patient_balance_deemed_uncollectible, 0) + coalesce(charity_write_off, 0)
    + coalesce(financial_hardship, 0) + coalesce(appeals_exhausted_not_med_necessary, 0)
    + coalesce(deceased_patient, 0) + coalesce(no_authorization_obtained, 0)
    + coalesce(noncovered_service, 0) + coalesce(no_transfer_agreement_inpat, 0)
    + coalesce(outof_network, 0) + coalesce(prompt_pay_adjustment, 0)
    + coalesce(other_adjustments, 0)) as {_M})"""
_ALLOWED = f"cast(coalesce(charges, 0) - coalesce(contractual_adjustment, 0) as {_M})"
_BALANCE = f"cast({_ALLOWED} - {_PAYMENT} - {_ADJUSTMENT} - coalesce(refunds, 0) as {_M})"

# Absent from the narrow transactions view.
_ABSENT = ", ".join(f"cast(null as {_M}) as {c}" for c in [
    "intl_payments", "intl_adjustment", "patient_balance_deemed_uncollectible",
    "charity_write_off", "financial_hardship", "appeals_exhausted_not_med_necessary",
    "deceased_patient", "no_authorization_obtained", "noncovered_service",
    "no_transfer_agreement_inpat", "outof_network", "prompt_pay_adjustment", "other_adjustments"])

_CTES = {
    **{name: oracle_view(name) for name in VIEWS},
    "tx": f"""
select *, {_tx_id("patient_number")} as pid, {_BALANCE} as balance
from (select *, {_ABSENT} from raw_transactions)""",
    "rf": """
select * replace (case when syn like '%S%' then 'SYN-' || substr(syn, 4) else syn end as patient_id)
from (select *, replace(replace(patient_id, '-', ''), 'SNY', 'SYN') as syn from raw_referrals)""",
    "visits": """
select *, rank() over (partition by patient_id order by referral_date) as visit_number from rf""",
    "ep": """
select distinct patient_id, referral_date, visit_number,
       coalesce((select min(n.referral_date) from rf n
                 where n.patient_id = visits.patient_id and n.referral_date > visits.referral_date),
                date '9999-12-31') as next_date
from visits""",
    "ep_tx": """
select ep.patient_id, ep.referral_date, ep.next_date, ep.visit_number,
       tx.insurance_name, tx.units, tx.balance
from ep left join tx on tx.pid = ep.patient_id
  and tx.from_dos >= ep.referral_date and tx.from_dos < ep.next_date""",
    "pay": """
select patient_id, referral_date, insurance_name, cast(sum(units) as decimal(18,6)) as units,
       count(insurance_name) as lines
from ep_tx group by all""",
    "ranked": """
select *, row_number() over (partition by patient_id, referral_date
         order by units desc nulls last, lines, insurance_name nulls last) as payer_rank
from pay""",
    "top": """
select patient_id, referral_date,
       case when patient_id in (select pid from tx where pid is not null)
            then coalesce(max(case when payer_rank = 1 then insurance_name end), 'Self-Pay') end as updated_primary,
       min(case when payer_rank >= 2 then insurance_name end) as updated_secondary
from ranked group by patient_id, referral_date""",
    "totals": f"""
select patient_id, referral_date, cast(coalesce(sum(balance), 0) as {_M}) as remaining_balance
from ep_tx group by all""",
    "xwalk": """
select insurance_product_detail as payer, min(category_type) as cat, min(insurance_cat_abv) as abv,
       min(payer_roll_up) as roll from payer_crosswalk group by all""",
    "rf_top": """
select rf.*, visits.visit_number, totals.remaining_balance, top.updated_primary, top.updated_secondary,
       p.cat as p_cat, p.abv as p_abv, p.roll as p_roll, s.cat as s_cat, s.abv as s_abv, s.roll as s_roll
from rf join visits using (referral_key)
left join totals on totals.patient_id = rf.patient_id and totals.referral_date = rf.referral_date
left join top on top.patient_id = rf.patient_id and top.referral_date = rf.referral_date
left join xwalk p on p.payer = top.updated_primary
left join xwalk s on s.payer = top.updated_secondary""",
    # Cleaned transactions with rule tables; chains of corrections are not followed.
    "kept": """
select * from wide_transactions where patient_number not in (select raw_id from id_exclusions)""",
    "kept_narrow": """
select * from raw_transactions where patient_number not in (select raw_id from id_exclusions)""",
    "clean_ids": f"""
select n.raw, coalesce(post.to_id, n.norm) as pid
from (select r.raw, {_tx_id("coalesce(pre.to_id, r.raw)")} as norm
      from (select distinct patient_number as raw from raw_transactions) r
      left join id_corrections pre on pre.stage = 'pre' and pre.from_id = r.raw) n
left join id_corrections post on post.stage = 'post' and post.from_id = n.norm""",
    "clean_tx": f"""
select kept.*, clean_ids.pid, {_ALLOWED} as allowed, {_PAYMENT} as total_payments,
       {_ADJUSTMENT} as total_adjustments, {_BALANCE} as remaining_balance
from kept join clean_ids on kept.patient_number = clean_ids.raw""",
    "refresh_tx": f"""
select k.*, clean_ids.pid, {_PAYMENT} as total_payments, {_BALANCE} as balance
from (select *, {_ABSENT} from kept_narrow) k join clean_ids on k.patient_number = clean_ids.raw""",
    "refresh_in": """
select t.*, ep.referral_date from refresh_tx t left join ep on t.pid = ep.patient_id
  and t.from_dos >= ep.referral_date and t.from_dos < ep.next_date""",
    "refresh_pay": """
select pid, referral_date, insurance_name, sum(units) as units, count(insurance_name) as lines
from refresh_in where referral_date is not null group by pid, referral_date, insurance_name""",
    "refresh_rank": """
select pid, referral_date, insurance_name,
       row_number() over (partition by pid, referral_date
         order by units desc, lines, insurance_name nulls last) as payer_rank
from refresh_pay""",
    "refresh_top": """
select pid, referral_date, coalesce(insurance_name, 'Self-Pay') as primary_payer
from refresh_rank where payer_rank = 1""",
    "parsed": """
select l_orderkey, l_linenumber, p, patient_full_name as name,
       trim(substr(patient_full_name, p + 2)) as given
from (select *, strpos(patient_full_name, ',') as p from raw_transactions)""",
    "people": """
select patient_id from active_insurance union select patient_id from patient_dob
union select patient_id from research_patient union select patient_id from at_risk""",
}


def _sql(select: str) -> str:
    """Put the needed views in front of a select."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", body):
                visit(_CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select.strip()
    return "with " + ",\n".join(f"{n} as ({_CTES[n].strip()})" for n in needed) + "\n" + select.strip()


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


_TX_COLUMNS = ["patient_number", "patient_full_name", "l_orderkey", "l_linenumber", "from_dos",
               "insurance_name", "units", "charges", "contractual_adjustment", "payments",
               "adjustments", "refunds", "personal_payments", "insurance_payments", "charity"]


def _per_column(value: str, name: str) -> str:
    return _union([f"select '{c}' as column_name, {value.format(c=c)} as {name} from raw_transactions"
                   for c in _TX_COLUMNS])


_DATE = """case when l_linenumber in (1, 2, 3) then cast(l_shipdate as date) {early} end"""
_CENTS = "cast(l_extendedprice as decimal(12,2))"

_RETIRED = ["bal_trans_from_tiger", "bankruptcy", "indigent_charity", "bundled_ncci_edit",
            "charge_error", "global_period_not_billable", "charges_not_receivedfrom_site_timely",
            "g6017_not_covered", "mue_max_units_exceeded", "small_balance_adjustment",
            "collection_agency_payments", "collection_agency_refunds", "collection_agency_transfers",
            "collection_agency_adjustment", "collection_agency_fee_adjustment"]

# Columns and types of the reporting tables, written out apart from the engine's own list.
_MART_COLUMNS = {
    "Referral_Masterlist": [
        ("varchar", """patient_name patient_mrn"""),
        ("int", """age visit_number"""),
        ("date", """referral_date"""),
        ("varchar", """state disease_site referring_hospital referring_physician attending_physician
            primary_insurance secondary_insruance insurance_approval final_approval reason_code"""),
        ("date", """consult_date sim_date intake_acceptance_date decision_date insurance_decision_date"""),
        ("varchar", """inquiry_source"""),
    ],
    "AriaData": [
        ("varchar", """patient_id"""),
        ("date", """patient_dob"""),
        ("varchar", """at_risk research_patient_flag active_insurance primary_flag"""),
    ],
    "Fractions": [
        ("varchar", """patient_id activity_name"""),
        ("date", """activity_start_date"""),
        ("varchar", """treatment_status icd_10_diagnosis resource primary_oncologist"""),
    ],
    "ICD_Crosswalk": [
        ("varchar", """prefix icd_10_code description icd_10_diagosis_category icd_10_sub_category"""),
    ],
    "Payer_Crosswalk": [
        ("varchar", """insurance_name insurance_category_abv insurance_category insurance_roll_up"""),
    ],
    "RCB_Billing": [
        ("date", """payment_date_updated payment_date_voided voucher_date_updated voucher_date_voided"""),
        ("varchar", """account_type insurance_abv insurance_name patient_number patient_full_name"""),
        ("date", """dos"""),
        ("int", """voucher"""),
        ("date", """bill_date re_bill_date"""),
        ("varchar", """billing_provider"""),
        ("double", """npi"""),
        ("varchar", """patient_subscriber_id procedure_code procedure_description modifier diagnosis_code"""),
        ("int", """units"""),
        ("decimal(12,2)", """charges personal_payments insurance_payments intl_payments contractual_adjustments
            charity refund_amounts allowed total_payments total_adjustments bal_trans_from_tiger
            intl_adjustment bankruptcy patient_balance_deemed_uncollectible charity_write_off
            indigent_charity bundled_ncci_edit charge_error global_period_not_billable
            appeals_exhausted_not_med_necessary charges_not_receivedfrom_site_timely
            deceased_patient financial_hardship g6017_not_covered mue_max_units_exceeded
            no_authorization_obtained noncovered_service no_transfer_agreement_inpat
            outof_network prompt_pay_adjustment small_balance_adjustment
            collection_agency_payments collection_agency_refunds collection_agency_transfers
            collection_agency_adjustment collection_agency_fee_adjustment all_other_adjustments
            remaining_balance"""),
        ("date", """date_uploaded"""),
    ],
}


def _mart(mart: str, source: str, **values: str) -> str:
    """All columns of a mart; those without a value are null."""
    columns = [f"cast({values.get(name, 'null')} as {kind}) as {name}"
               for kind, names in _MART_COLUMNS[mart] for name in names.split()]
    return f"select {', '.join(columns)} from {source}"


_BILLING = {
    **{c: c for c in ["account_type", "insurance_name", "patient_full_name", "voucher", "bill_date",
                      "npi", "procedure_code", "charity", "intl_adjustment",
                      "patient_balance_deemed_uncollectible", "charity_write_off",
                      "appeals_exhausted_not_med_necessary", "deceased_patient",
                      "financial_hardship", "no_authorization_obtained", "noncovered_service",
                      "no_transfer_agreement_inpat", "outof_network", "prompt_pay_adjustment",
                      "allowed", "total_payments", "total_adjustments", "remaining_balance"]},
    **{c: f"coalesce({c}, 0)" for c in ["charges", "personal_payments", "insurance_payments",
                                        "intl_payments"]},
    **{c: "0" for c in _RETIRED},
    "patient_number": "pid", "dos": "from_dos", "units": "trunc(units)",
    "contractual_adjustments": "coalesce(contractual_adjustment, 0)",
    "refund_amounts": "coalesce(refunds, 0)",
    "all_other_adjustments": "coalesce(other_adjustments, 0)", "date_uploaded": _AS_OF,
}

_AGE = """datediff('year', {b}, date '2026-01-01')
    - case when {b} + to_years(cast(datediff('year', {b}, date '2026-01-01') as int)) > date '2026-01-01' then 1 else 0 end"""

_EXPORTED = """select patient_number, patient_full_name, from_dos, insurance_name,
  cast(l_orderkey as int) as voucher, cast(l_linenumber as varchar) as modifier,
  cast(units as decimal(18,6)) as units, charges, payments from raw_transactions"""

_ASSIGNED = """from tx left join ep on tx.pid = ep.patient_id
  and tx.from_dos >= ep.referral_date and tx.from_dos < ep.next_date"""

_SELECTS = {
    "scan_folder": "select count(*) as lines, 4 as files from raw_transactions",
    "csv_round_trip": _EXPORTED,
    "catalog_tables": _union([
        f"select 'raw' as layer, '{table}' as table_name, {3 if table == 'AtRisk' else 1} as version, 1 as loads, count(*) as rows from {view}"
        for table, view in [
            ("TransactionsRaw", "raw_transactions"), ("ReferralRaw", "raw_referrals"), ("DenialData", "denial_data"),
            ("PayerCrosswalk", "payer_crosswalk"), ("ActiveInsurance", "active_insurance"), ("PatientDOB", "patient_dob"),
            ("AtRisk", "at_risk"), ("ResearchPatient", "research_patient"), ("Fractions", "fractions"), ("ICD_Crosswalk", "icd_crosswalk")]]),
    "csv_line_breaks": _EXPORTED.replace("patient_full_name,", "replace(patient_full_name, ', ', ',' || chr(10)) as patient_full_name,"),
    "coercion_losses": _union([
        f"select '{column}' as column_name, count(*) as lost from texts where l_linenumber in ({lines})"
        for column, lines in [("voucher", "3, 5, 6"), ("charges", "3, 5"), ("npi", "3, 5"), ("from_dos", "5, 6")]]),
    "ingest_all": f"""
select 'TransactionsRaw' as table_name, patient_number as patient, from_dos as day, charges from raw_transactions
union all
select 'PatientDOB', patient_id, date_of_birth, cast(null as {_M}) from patient_dob""",
    "sink_append": "select * from denial_data union all select * from denial_data",
    "sink_replace": "select * from denial_data",
    "clean_and_save": "select patient_id, date_of_birth from patient_dob",
    "route_by_name": _union([
        f"select '{file}.txt' as file_name, count(*) as lines, '{table}' as target_table from {view}"
        for file, table, view in [
            ("Payer Crosswalk", "PayerCrosswalk", "payer_crosswalk"),
            ("ICD crosswalk", "ICD_Crosswalk", "icd_crosswalk"),
            ("Patient DOB 2026", "PatientDOB", "patient_dob"),
            ("research_patient", "ResearchPatient", "research_patient"),
            ("at-risk list", "AtRisk", "at_risk"),
            ("Active Insurance", "ActiveInsurance", "active_insurance"),
            ("Referrals", "ReferralRaw", "raw_referrals")]]),
    "catalog_schema": _union([
        f"""select {i} as position, '{c}' as column_name, '{t}' as data_type, count(*) as rows,
  count(*) - count({c}) as nulls from lineitem"""
        for i, (c, t) in enumerate([
            ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")], start=1)]),
    "surrogate_key": "select row_number() over () as row_id from lineitem",
    "align_exact": f"select patient_number, from_dos, voucher, modifier, charges from ({_EXPORTED})",
    "align_fuzzy": f"select patient_full_name, insurance_name, voucher, modifier from ({_EXPORTED})",
    "align_missing": f"""select voucher, modifier, cast(null as date) as bill_date, cast(null as double) as npi,
  cast(null as {_M}) as refunds, cast(null as varchar) as procedure_code from ({_EXPORTED})""",
    "align_extra": f'select voucher, modifier, 49 as "columns", 0 as unexpected from ({_EXPORTED})',
    "coerce_int": """select l_orderkey, l_linenumber,
  case when l_linenumber in (1, 2, 4) then cast(l_partkey as int) end as as_int from texts""",
    "coerce_number": f"""select l_orderkey, l_linenumber,
  case l_linenumber when 1 then cast({_CENTS} as double) when 2 then -cast({_CENTS} as double)
       when 4 then 1000 end as as_float,
  case l_linenumber when 1 then cast({_CENTS} as {_M}) when 2 then -cast({_CENTS} as {_M})
       when 4 then cast(1000 as {_M}) end as as_money from texts""",
    "coerce_bool": """select l_orderkey, l_linenumber,
  case when l_linenumber in (1, 2, 7) then true when l_linenumber in (3, 4) then false end as as_bool from texts""",
    "coerce_datetime": f"""select l_orderkey, l_linenumber,
  strftime({_DATE.format(early="")}, '%Y-%m-%d')
  || case when l_linenumber = 2 then ' 13:45:10' else ' 00:00:00' end as as_text from texts""",
    "coerce_date": f"""select l_orderkey, l_linenumber,
  {_DATE.format(early="when l_linenumber = 4 then date '1752-12-31'")} as as_date from texts""",
    "coerce_datetime_range": """select l_orderkey, l_linenumber, l_linenumber in (1, 2, 3) as in_range from texts""",
    "coerce_truncate": "select l_orderkey, l_linenumber, left(number_text, 5) as as_text from texts",
    "validate_headers": _union([
        f"""select {source} as column_name, {expected} as expected_name, '{status}' as status,
  {'count(*)' if rows else 'null'} as rows, {'0' if rows else 'null'} as empty_rows,
  {'0' if rows else 'null'} as nulls, {'false' if rows else 'null'} as is_sparse,
  {'0' if rows else 'null'} as over_width, false as file_is_valid from {'active_insurance' if rows else '(select 1)'}"""
        for source, expected, status, rows in [
            ("'PATIENTID'", "'PatientId'", "exact", True),
            ("'Company Nam'", "'CompanyName'", "fuzzy", True),
            ("'Zone'", "null", "extra", True),
            ("null", "'PrimaryFlag'", "missing", False)]]),
    "profile_rows": _per_column("count(*)", "rows"),
    "profile_nulls": _per_column("count(*) - count({c})", "nulls"),
    "profile_sparse_columns": "select column_name from ("
        + _per_column("(count(*) - count({c})) * 10 > count(*) * 8", "sparse") + ") where sparse",
    "profile_overwidth": _union([
        f"""select '{c}' as column_name, {f"count(*) filter (where length({c}) > {w})" if w else "count(*) * 0"}
  as over_width from raw_transactions"""
        for c in _TX_COLUMNS
        for w in [{"patient_full_name": 14, "patient_number": 6}.get(c)]]),
    "profile_empty_rows": """select count(*) as empty_rows from raw_transactions
  where coalesce(patient_full_name, insurance_name) is null
    and coalesce(payments, refunds, charity, personal_payments) is null""",
    "sample_head": "select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 10",
    "tx_exclude": "select patient_number, l_orderkey, l_linenumber from kept_narrow",
    "tx_measures": f"""select l_orderkey, l_linenumber, coalesce(charges, 0) as charges,
  coalesce(personal_payments, 0) as personal_payments, coalesce(insurance_payments, 0) as insurance_payments,
  coalesce(intl_payments, 0) as intl_payments, coalesce(contractual_adjustment, 0) as contractual_adjustment,
  coalesce(refunds, 0) as refunds, {_ALLOWED} as allowed from wide_transactions""",
    "tx_constants": f"""select l_orderkey, l_linenumber,
  {', '.join(f"cast(0 as {_M}) as {c}" for c in _RETIRED)},
  cast(null as varchar) as practice_name, {_AS_OF} as date_uploaded from kept""",
    "tx_total_payments": f"select l_orderkey, l_linenumber, {_PAYMENT} as total_payments from wide_transactions",
    "tx_total_adjustments": f"select l_orderkey, l_linenumber, {_ADJUSTMENT} as total_adjustments from wide_transactions",
    "tx_remaining_balance": f"select l_orderkey, l_linenumber, {_BALANCE} as remaining_balance from wide_transactions",
    "tx_adjustment_groups": f"""select l_orderkey, l_linenumber,
  cast(coalesce(charity, 0) + coalesce(charity_write_off, 0) + coalesce(financial_hardship, 0) as {_M}) as charity_adjs,
  coalesce(other_adjustments, 0) as other_adjs, intl_adjustment as international_adjs,
  cast(coalesce(patient_balance_deemed_uncollectible, 0) + coalesce(deceased_patient, 0) as {_M}) as patient_directive,
  cast(coalesce(appeals_exhausted_not_med_necessary, 0) + coalesce(no_authorization_obtained, 0)
    + coalesce(noncovered_service, 0) + coalesce(no_transfer_agreement_inpat, 0)
    + coalesce(outof_network, 0) as {_M}) as payer_directive from wide_transactions""",
    "id_correct_pre": """select coalesce(c.to_id, t.patient_number) as patient_number, l_orderkey, l_linenumber
  from raw_transactions t left join id_corrections c on c.stage = 'pre' and c.from_id = t.patient_number""",
    "id_tx_normalize": "select l_orderkey, l_linenumber, patient_number, pid as patient_number_updated from tx",
    "id_rf_normalize": "select referral_key, patient_id from rf",
    "id_correct_post": """select coalesce(c.to_id, tx.pid) as patient_number_updated, l_orderkey, l_linenumber
  from tx left join id_corrections c on c.stage = 'post' and c.from_id = tx.pid""",
    "name_parse": """select l_orderkey, l_linenumber,
  case when p > 0 then upper(trim(left(name, p - 1))) end as last_name,
  case when p > 0 then upper(trim(substr(name, p + 2, strpos(given || ' ', ' ') - 1))) end as first_name,
  case when p > 0 then upper(trim(substr(given, strpos(given || ' ', ' ') + 1))) end as middle_name
  from parsed""",
    "name_first_word": """select referral_key, upper(split_part(patient_name, ' ', 1)) as first_name from raw_referrals""",
    "visit_key": "select referral_key, patient_id || '-' || visit_number as trans_mrn from visits",
    "episodes": "select patient_id as patient_key, referral_date, next_date, visit_number from ep",
    "rf_visit_number": "select referral_key, patient_id, referral_date, visit_number from visits",
    "episode_balance": """select totals.patient_id as patient_key, referral_date, next_date, remaining_balance
  from totals join ep using (patient_id, referral_date)""",
    "tx_assign_episode": f"""select l_orderkey, l_linenumber, pid as patient_key, from_dos, referral_date,
  visit_number {_ASSIGNED}""",
    "tx_assign_episode_window": f"""select pid as patient_key, from_dos as day, count(*) as facts,
  referral_date, visit_number {_ASSIGNED} group by all""",
    "denial_assign_episode": """select d.*, ep.visit_number from denial_data d
  left join ep on d.patient_account = ep.patient_id and d.dos >= ep.referral_date and d.dos < ep.next_date""",
    "payer_units": "select patient_id as patient_key, referral_date, insurance_name as payer, units, lines from pay",
    "payer_rank": "select patient_id as patient_key, referral_date, insurance_name as payer, payer_rank from ranked",
    "top_payers": "select patient_id as patient_key, referral_date, updated_primary, updated_secondary from top",
    "rf_payer_primary": """select referral_key, updated_primary, p_abv as primary_insurance_abv,
  p_cat as primary_insurance_cat, p_roll as primary_payer_roll_up from rf_top""",
    "rf_payer_secondary": """select referral_key, updated_secondary, s_abv as secondary_insurance_abv,
  s_cat as secondary_insurance_cat, s_roll as secondary_payer_roll_up from rf_top""",
    "tx_payer_lookup": """select l_orderkey, l_linenumber, insurance_name, abv as insurance_abv,
  cat as insurance_cat, roll as payer_roll_up
  from raw_transactions left join xwalk on xwalk.payer = insurance_name""",
    "rf_with_transactions": """select referral_key, patient_id from rf
  where exists (select 1 from tx where tx.pid = rf.patient_id)""",
    "mart_fractions": _mart("Fractions", "fractions", patient_id="patient_id1", activity_name="activity_name",
                            activity_start_date="start_date", treatment_status="status",
                            icd_10_diagnosis="icd_10", resource="staff_resource"),
    "mart_icd": _mart("ICD_Crosswalk", "icd_crosswalk", prefix="prefix", icd_10_code="latest_dx",
                      description="descr", icd_10_diagosis_category="roll_up_high_level",
                      **{"icd_10_sub_category": "icd_second_level"}),
    "mart_referrals": _mart(
        "Referral_Masterlist",
        "rf_top left join patient_dob d on upper(d.patient_id) = upper(rf_top.patient_id)",
        patient_name="patient_name", patient_mrn="rf_top.patient_id", age=_AGE.format(b="d.date_of_birth"),
        visit_number="visit_number", referral_date="referral_date", primary_insurance="updated_primary",
        secondary_insruance="updated_secondary", final_approval="final_approval"),
    "mart_payer": _mart("Payer_Crosswalk", "payer_crosswalk", insurance_name="insurance_product_detail",
                        insurance_category_abv="insurance_cat_abv", insurance_category="category_type",
                        insurance_roll_up="payer_roll_up"),
    "mart_billing": _mart("RCB_Billing", "clean_tx", **_BILLING),
    "mart_patients": """select p.patient_id, d.date_of_birth as patient_dob, k.status_icon as at_risk,
  r.status_icon as research_patient_flag, a.company_name as active_insurance, a.primary_flag
  from people p left join patient_dob d on p.patient_id = d.patient_id
  left join research_patient r on p.patient_id = r.patient_id
  left join at_risk k on p.patient_id = k.patient_id
  left join active_insurance a on p.patient_id = a.patient_id""",
    "all_patients": "select patient_id from people",
    "age_years": f"select patient_id, {_AGE.format(b='date_of_birth')} as age from patient_dob",
    "rf_clean": """select referral_key, patient_id, patient_name, referral_date, final_approval,
  cast(null as varchar) as state, cast(null as date) as dob, cast(null as boolean) as at_risk,
  cast(null as timestamp) as sim_date from raw_referrals""",
    "clean_transactions": """select c.l_orderkey, c.l_linenumber, patient_number, pid as patient_number_updated,
  case when strpos(patient_full_name, ',') > 0 then upper(split_part(patient_full_name, ',', 1)) end as last_name,
  case when patient_full_name is not null then 'JANE' end as first_name,
  case when patient_full_name like '% Q' then 'Q' when patient_full_name is not null then '' end as middle_name,
  from_dos, allowed, total_payments, total_adjustments, remaining_balance from clean_tx c""",
    "clean_referrals": """select referral_key, patient_id, 'JANE' as first_name, referral_date,
  cast(visit_number as varchar) as visit_number, patient_id || '-' || visit_number as trans_mrn from visits""",
    "enrich_referrals": """select referral_key, remaining_balance, updated_primary, updated_secondary,
  p_cat as primary_insurance_cat, s_cat as secondary_insurance_cat from rf_top""",
    "enrich_transactions": f"""select l_orderkey, l_linenumber, pid as patient_number_updated,
  cast(ep.visit_number as varchar) as visit_number, pid || '-' || ep.visit_number as trans_mrn,
  top.updated_primary as primary_insurance, top.updated_secondary as secondary_insurance,
  xwalk.abv as insurance_abv, xwalk.cat as insurance_cat, xwalk.roll as payer_roll_up {_ASSIGNED}
  left join top on top.patient_id = ep.patient_id and top.referral_date = ep.referral_date
  left join xwalk on xwalk.payer = top.updated_primary""",
    "refresh": """select pid as patient_number, from_dos as dos, insurance_name, xwalk.abv as insurance_abv,
  cast(trunc(units) as int) as units, cast(charges as decimal(12,2)) as charges,
  cast(total_payments as decimal(12,2)) as total_payments, cast(balance as decimal(12,2)) as remaining_balance
  from refresh_in left join refresh_top using (pid, referral_date)
  left join xwalk on xwalk.payer = refresh_top.primary_payer""",
}
_SELECTS["refresh_changes"] = _SELECTS["refresh"]

ORACLES = {name: _sql(select) for name, select in _SELECTS.items()}
