"""Schemas of the tables, and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.functions.columns import blank_to_null

PHONE = "struct<type:string,raw:string,e164:string>"
ADDRESS = "struct<street:string,city:string,state:string,postal_code:string,country_or_region:string>"
TABLES = {
    "mail_inbox": "id long, hash string, content string, operated boolean, deleted boolean, account string, same_result_count int, last_result_signature string",
    "mail_sent": "id long, hash string, path string, operated boolean, deleted boolean, account string",
    "contacts": (
        "id long, source_message_id string, display_name string, full_name string, given_name string, middle_name string, surname string, company_name string, job_title string, "
        "file_as string, email string, website string, business_phone string, home_phone string, mobile_phone string, business_fax string, street string, city string, state string, "
        f"postal_code string, country_or_region string, postal_address_index string, notes string, emails map<string,string>, phone_numbers map<string,string>, addresses map<string,{ADDRESS}>, "
        "created_at timestamp, ews_id string"
    ),
    "envelope": f"schema_version string, account_key string, source_message_id string, contact struct<full_name:string,given_name:string,surname:string,company:string,email:string,phones:array<{PHONE}>,address:string,website:string,notes:string>",
    "storage_request": "source_path string, number string, target_file_name string",
    "folders": "path string, parent string, depth int, name string",
}
#: Columns that identify a row.
UNIQUE = {"mail_inbox": ("hash", "account"), "mail_sent": ("hash", "account"), "contacts": ("ews_id",)}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def expect(df: DataFrame, table: str) -> DataFrame:
    """`df` with the table's columns in order; an error now if one is missing or of another type."""
    have = dict(df.dtypes)
    wrong = [f.name for f in schema_of(table) if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{table}: columns missing or of another type: {', '.join(wrong)}")
    return df.select(*(f.name for f in schema_of(table)))


def has_name() -> Column:
    return F.coalesce(*(blank_to_null(F.col(c)) for c in ("display_name", "full_name", "company_name", "email"))).isNotNull()


def has_phone() -> Column:
    return F.coalesce(*(blank_to_null(F.col(c)) for c in ("business_phone", "mobile_phone", "home_phone", "business_fax"))).isNotNull() | (F.coalesce(F.size("phone_numbers"), F.lit(0)) > 0)


def violations(df: DataFrame, table: str) -> DataFrame:
    """Columns rule and n: how many rows break each rule; no row if all keep all."""
    key = UNIQUE[table]
    again = df.dropna(subset=list(key)).groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"unique({', '.join(key)})").alias("rule"), "n")
    checks = {"a name is present": has_name(), "a phone is present": has_phone()} if table == "contacts" else {f"{c} is present": F.col(c).isNotNull() for c in key}
    for rule, ok in checks.items():
        again = again.union(df.where(~ok).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return again.where("n > 0")


def with_account(df: DataFrame, default: str = "bewerbung") -> DataFrame:
    """Rows of before accounts were kept get the default one, as it was written then."""
    return df.withColumn("account", F.coalesce("account", F.lit(default))) if "account" in df.columns else df.withColumn("account", F.lit(default))
