"""Views that shape the given tables into the engine's inputs.

Every view reads all rows of its tables. Keys that nobody else has make the misses of joins. One patient is one ``o_custkey``; orders play referrals, lineitems transactions. The SQL runs
unchanged in Spark and in the oracle; only the table names differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_RAW_NUMBER = """case cast({k} % 6 as int)
         when 0 then '86' || cast({k} as varchar(20))
         when 1 then '85' || cast({k} as varchar(20))
         when 2 then '86SYN-' || cast({k} as varchar(20))
         when 3 then '86SNY' || cast({k} as varchar(20))
         when 4 then '86-' || cast({k} as varchar(20))
         else '85' || cast({k} as varchar(20)) end"""

_CLEAN_NUMBER = """case when {k} % 6 in (2, 3) then 'SYN-' || cast({k} as varchar(20))
         else cast({k} as varchar(20)) end"""

_PRICE = "cast(l_extendedprice as decimal(12,2))"

_TRANSACTION_COLUMNS = f"""
       {_RAW_NUMBER.format(k="o_custkey")} as patient_number,
       case when o_custkey % 11 = 0 then null
            when o_custkey % 5 = 0 then 'Doe' || cast(o_custkey as varchar(20)) || ', Jane'
            else 'Doe' || cast(o_custkey as varchar(20)) || ', Jane Q' end as patient_full_name,
       l_orderkey, l_linenumber,
       cast(l_shipdate as date) as from_dos,
       case when l_suppkey % 13 = 0 then null
            else 'PAYER_' || cast(l_suppkey % 12 as varchar(20)) end as insurance_name,
       cast(l_quantity as decimal(12,2)) as units,
       cast(l_extendedprice as decimal(19,4)) as charges,
       cast({_PRICE} * cast(l_discount as decimal(4,2)) as decimal(19,4)) as contractual_adjustment,
       case when l_linenumber % 3 = 0 then cast({_PRICE} * 0.50 as decimal(19,4)) end as payments,
       case when l_linenumber % 4 = 0 then cast(10 as decimal(19,4)) end as adjustments,
       case when l_returnflag = 'A' and l_linenumber = 2 then cast(5 as decimal(19,4)) end as refunds,
       case when l_returnflag = 'R' then cast(100 as decimal(19,4)) end as personal_payments,
       case when l_returnflag <> 'N' then cast({_PRICE} * 0.25 as decimal(19,4)) end as insurance_payments,
       case when l_linestatus = 'F' then cast({_PRICE} * cast(l_tax as decimal(4,2)) as decimal(19,4)) end as charity"""

_MORE_MONEY = """
       case when l_linenumber = 1 then cast(1.5 as decimal(19,4)) end as intl_payments,
       case when l_suppkey % 17 = 0 then cast(3.3333 as decimal(19,4)) end as intl_adjustment,
       case when l_linenumber = 6 then cast(20 as decimal(19,4)) end as patient_balance_deemed_uncollectible,
       case when l_suppkey % 19 = 0 then cast(2.0050 as decimal(19,4)) end as charity_write_off,
       case when o_orderpriority = '5-LOW' then cast(4 as decimal(19,4)) end as financial_hardship,
       case when l_partkey % 23 = 0 then cast(8 as decimal(19,4)) end as appeals_exhausted_not_med_necessary,
       case when o_orderstatus = 'F' then cast(11.5 as decimal(19,4)) end as deceased_patient,
       case when l_partkey % 29 = 0 then cast(9 as decimal(19,4)) end as no_authorization_obtained,
       case when l_partkey % 31 = 0 then cast(0.125 as decimal(19,4)) end as noncovered_service,
       case when l_partkey % 37 = 0 then cast(0.375 as decimal(19,4)) end as no_transfer_agreement_inpat,
       case when l_partkey % 41 = 0 then cast(6 as decimal(19,4)) end as outof_network,
       case when l_partkey % 43 = 0 then cast(2 as decimal(19,4)) end as prompt_pay_adjustment,
       case when l_linenumber = 5 then cast(-7.25 as decimal(19,4)) end as other_adjustments,
       cast(l_orderkey as int) as voucher, o_orderpriority as account_type,
       cast(l_suppkey as double) as npi, 'P' || cast(l_partkey as varchar(20)) as procedure_code,
       cast(o_orderdate as date) as bill_date"""

_FROM_LINES = "from {lineitem} join {orders} on l_orderkey = o_orderkey"

VIEWS = {
    "raw_transactions": f"select {_TRANSACTION_COLUMNS} {_FROM_LINES}",
    "wide_transactions": f"select {_TRANSACTION_COLUMNS}, {_MORE_MONEY} {_FROM_LINES}",
    "raw_referrals": """
select case when o_orderkey % 9 = 0 then 'NEW-' || cast(o_custkey as varchar(20))
            when o_custkey % 6 = 2 then 'SYN-' || cast(o_custkey as varchar(20))
            when o_custkey % 6 = 3 then 'SNY' || cast(o_custkey as varchar(20))
            else cast(o_custkey as varchar(20)) end as patient_id,
       'Jane Doe' || cast(o_custkey as varchar(20)) as patient_name,
       cast(o_orderdate as date) as referral_date,
       o_orderkey as referral_key,
       o_orderstatus as final_approval
from {orders}""",
    "denial_data": f"""
select {_CLEAN_NUMBER.format(k="o_custkey")} as patient_account,
       cast(l_shipdate as date) as dos, l_orderkey, l_linenumber
{_FROM_LINES}""",
    "payer_crosswalk": """
select distinct case when s_suppkey % 12 < 9 then 'PAYER_' else 'Other_' end
         || cast(s_suppkey % 12 as varchar(20)) as insurance_product_detail,
       'CAT_' || cast(s_suppkey % 12 % 3 as varchar(20)) as category_type,
       'C' || cast(s_suppkey % 12 % 3 as varchar(20)) as insurance_cat_abv,
       'ROLL_' || cast(s_suppkey % 12 % 2 as varchar(20)) as payer_roll_up
from {supplier}""",
    "active_insurance": """
select distinct case when o_custkey % 4 = 0 then '' else 'A-' end || cast(o_custkey as varchar(20)) as patient_id,
       'PAYER_' || o_orderstatus as company_name,
       case when o_orderstatus = 'F' then 'Y' else 'N' end as primary_flag
from {orders}""",
    "patient_dob": """
select case when c_custkey % 10 <> 0 then '' else 'D-' end || cast(c_custkey as varchar(20)) as patient_id,
       date '1940-01-01' + cast(c_custkey * 17 % 25000 as int) as date_of_birth
from {customer}""",
    "at_risk": """
select case when c_acctbal < 500 then '' else 'R-' end || cast(c_custkey as varchar(20)) as patient_id,
       'RISK' as status_icon
from {customer}""",
    "research_patient": """
select case when c_custkey % 7 = 0 then '' else 'S-' end || cast(c_custkey as varchar(20)) as patient_id,
       'STUDY' as status_icon
from {customer}""",
    "fractions": """
select cast(o_custkey as varchar(20)) as patient_id1, p_type as activity_name,
       cast(l_shipdate as date) as start_date, l_linestatus as status,
       p_brand as icd_10, p_name as staff_resource, l_orderkey, l_linenumber
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "icd_crosswalk": """
select distinct substr(p_brand, 1, 5) as prefix, p_brand as latest_dx,
       'Descr ' || p_brand as descr, 'HIGH' as roll_up_high_level, p_brand || '-2' as icd_second_level
from {part}""",
    "id_exclusions": f"""
select {_RAW_NUMBER.format(k="c_custkey")} as raw_id from {{customer}} where c_acctbal < 0""",
    # Neighbouring customers of one nation make chains (a -> b, b -> c), which must not be followed.
    "id_corrections": f"""
select 'pre' as stage, {_RAW_NUMBER.format(k="c_custkey")} as from_id,
       '86' || cast(c_custkey + 1 as varchar(20)) as to_id
from {{customer}} where c_mktsegment = 'MACHINERY'
union all
select 'post', {_CLEAN_NUMBER.format(k="c_custkey")}, {_CLEAN_NUMBER.format(k="(c_custkey + 1)")}
from {{customer}} where c_nationkey < 8""",
    # Texts as a spreadsheet export would hold them, well-formed and not.
    "texts": """
select l_orderkey, l_linenumber,
       case l_linenumber when 1 then cast(l_partkey as varchar(20))
            when 2 then cast(l_partkey as varchar(20)) || '.0'
            when 3 then cast(l_partkey as varchar(20)) || '.5'
            when 4 then ' ' || cast(l_partkey as varchar(20)) || ' '
            when 5 then 'abc' when 6 then '9' || cast(3000000000 + l_partkey as varchar(20)) end as int_text,
       case l_linenumber when 1 then cast(cast(l_extendedprice as decimal(12,2)) as varchar(20))
            when 2 then '-' || cast(cast(l_extendedprice as decimal(12,2)) as varchar(20))
            when 3 then '$' || cast(cast(l_extendedprice as decimal(12,2)) as varchar(20))
            when 4 then '1e3' when 5 then '12d' when 6 then 'NaN' end as number_text,
       case l_linenumber when 1 then 'Yes' when 2 then ' t ' when 3 then 'OFF' when 4 then '0'
            when 5 then 'maybe' when 6 then '2' when 7 then '1.0' end as bool_text,
       case l_linenumber when 1 then cast(cast(l_shipdate as date) as varchar(20))
            when 2 then cast(cast(l_shipdate as date) as varchar(20)) || ' 13:45:10'
            when 3 then cast(month(l_shipdate) as varchar(4)) || '/' || cast(day(l_shipdate) as varchar(4))
                        || '/' || cast(year(l_shipdate) as varchar(4))
            when 4 then '1752-12-31' when 5 then '2/30/2001' when 6 then 'soon' end as date_text,
       l_shipdate, l_partkey, l_extendedprice
from {lineitem}""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = _Tables(lambda t: f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(VIEWS[name].format_map(tables))


def oracle_view(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]).strip()


class _Tables(dict):
    def __init__(self, path):
        self._path = path

    def __missing__(self, table: str) -> str:
        return self._path(table)
