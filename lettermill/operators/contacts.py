"""Canonical contacts: phones, payload, validation, slots, duplicate lookup, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import columns as C
from lettermill.functions import vocab as V
from lettermill.operators.state import settle
from lettermill.functions.columns import let


def _rank(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in V.TYPE_RANK.items() for x in pair))[kind]


def dedupe_phones(candidates: DataFrame, key: str) -> DataFrame:
    """One row for each number of a key: its first spelling and place, and its best label. Columns key, digits, raw, phone_type, pos."""
    best = F.max_by("phone_type", F.struct(_rank(F.col("phone_type")), (-F.col("pos")).alias("first")))
    return candidates.withColumn("digits", C.phone_digits(F.col("raw"))).groupBy(key, "digits").agg(F.min_by("raw", "pos").alias("raw"), best.alias("phone_type"), F.min("pos").alias("pos"))


def dedupe_phone_array(phones: Column) -> Column:
    """The same within one array of (type, raw), in order of first place."""
    keyed = F.transform(phones, lambda p: F.struct(p["type"].alias("type"), p["raw"].alias("raw"), C.phone_digits(p["raw"]).alias("digits"), F.coalesce(_rank(p["type"]), F.lit(0)).alias("rank")))

    def firsts(all_phones: Column) -> Column:
        kept = F.filter(all_phones, lambda p, i: ~F.exists(F.slice(all_phones, F.lit(1), i), lambda q: q["digits"] == p["digits"]))
        best = lambda p: F.aggregate(all_phones, p, lambda a, q: F.when((q["digits"] == p["digits"]) & (q["rank"] > a["rank"]), q).otherwise(a))["type"]
        return F.transform(kept, lambda p: F.struct(best(p).alias("type"), p["raw"].alias("raw")))

    return let(keyed, firsts)


def phone_items(phones: Column) -> Column:
    """Payload phones of deduplicated (type, raw): shown form, and E.164 of that form."""

    def item(p: Column) -> Column:
        return let(C.phone_display(p["raw"]), lambda shown: F.struct(p["type"].alias("type"), shown.alias("raw"), C.blank_to_null(C.phone_e164(shown)).alias("e164")))

    return F.transform(phones, item)


def primary_phone(phones: Column) -> Column:
    """Raw value of the first phone of the best type: business, mobile, home, other, fax."""
    order = F.array(*map(F.lit, ("business", "mobile", "home", "other", "fax")))
    ranked = F.transform(phones, lambda p, i: F.struct(F.array_position(order, p["type"]).alias("rank"), i.alias("pos"), p["raw"].alias("raw")))
    return F.array_min(ranked)["raw"]


def payload(contact: DataFrame, account: str = V.DEFAULT_ACCOUNT) -> DataFrame:
    """Adds envelope: the canonical payload of columns id, full_name, display_name_fallback, company, email, address, website, notes, phones (payload items).

    A contact without phones has none: its envelope is null and its error says why.
    """
    name = C.strip(F.col("full_name"))
    given = F.when(name != "", C.first_names(name)).otherwise(F.lit(""))
    struct = F.struct(
        F.lit(V.SCHEMA_VERSION).alias("schema_version"),
        F.lit(account).alias("account_key"),
        F.col("id").cast("string").alias("source_message_id"),
        F.struct(
            F.when(name != "", name).otherwise(C.strip(F.col("display_name_fallback"))).alias("full_name"),
            given.alias("given_name"),
            F.when(name != "", C.last_name(name)).otherwise(F.lit("")).alias("surname"),
            *(C.strip(F.col(c)).alias(c) for c in ("company", "email")),
            F.col("phones").alias("phones"),
            *(C.strip(F.col(c)).alias(c) for c in ("address", "website", "notes")),
        ).alias("contact"),
    )
    some = F.size(F.coalesce("phones", F.array().cast("array<struct<type:string,raw:string,e164:string>>"))) > 0
    return contact.withColumn("error", F.when(~some, F.lit("contact.phone is required for canonical payload"))).withColumn("envelope", F.when(some, struct))


def to_json(envelope: Column) -> Column:
    """The payload as it is sent; absent values are left out."""
    return F.to_json(envelope, {"ignoreNullFields": "true"})


def validate(envelope: Column) -> Column:
    """The first rule that a payload breaks, as text; null if none."""
    contact = envelope["contact"]
    blank = lambda c: C.strip(c) == ""
    has_phone = F.coalesce(F.exists(contact["phones"], lambda p: ~blank(p["raw"]) | ~blank(p["e164"])), F.lit(False))
    return (
        F.when(envelope.isNull(), F.lit("Payload is required."))
        .when(F.coalesce(envelope["schema_version"], F.lit("")) != V.SCHEMA_VERSION, F.concat(F.lit("Unsupported schema_version '"), F.coalesce(envelope["schema_version"], F.lit("")), F.lit(f"'. Expected '{V.SCHEMA_VERSION}'.")))
        .when(contact.isNull(), F.lit("contact is required."))
        .when(blank(contact["full_name"]) & blank(contact["given_name"]) & blank(contact["surname"]), F.lit("contact.full_name or (contact.given_name + contact.surname) is required."))
        .when(~has_phone, F.lit("contact.phones must contain at least one number."))
    )


def dto_phones(phones: Column) -> Column:
    """(type, value) of payload phones: cleaned, first of each number, or of each text without digits."""
    cleaned = F.transform(F.coalesce(phones, F.array().cast("array<struct<type:string,raw:string,e164:string>>")), lambda p: F.struct(C.dto_phone_type(p["type"]).alias("type"), C.phone_value(p["raw"], p["e164"]).alias("value")))
    keyed = F.transform(F.filter(cleaned, lambda p: p["value"] != ""), lambda p: p.withField("key", F.coalesce(F.nullif(C.phone_digits(p["value"]), F.lit("")), F.lower(p["value"]))))
    firsts = lambda all_phones: F.filter(all_phones, lambda p, i: ~F.exists(F.slice(all_phones, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.transform(let(keyed, firsts), lambda p: p.dropFields("key"))


def phone_slots(phones: Column) -> Column:
    """struct(business, mobile, home, fax, more) of (type, value) phones.

    The first of each type goes to its slot, the first of all to business if there is none; second business and home numbers
    have slots of their own; what is left fills the other slots in order, and any beyond those is dropped.
    """
    slots = F.array(*map(F.lit, V.OVERFLOW_SLOTS))

    def places(p: Column) -> Column:
        """Where the first of each type is, from 1; 0 for none."""
        types = F.transform(p, lambda x: x["type"])
        first = lambda kind: F.array_position(types, F.lit(kind)).cast("int")
        business = F.when(first("business") > 0, first("business")).otherwise(F.least(F.size(p), F.lit(1)))
        return F.struct(p.alias("p"), F.array(business, first("mobile"), first("home"), first("fax")).alias("used"))

    def left(x: Column) -> Column:
        rest = F.filter(F.transform(x["p"], lambda p, i: F.struct((i + 1).alias("at"), p["type"].alias("type"), p["value"].alias("value"))), lambda p: ~F.array_contains(x["used"], p["at"]))
        return F.struct(x["p"].alias("p"), x["used"].alias("used"), rest.alias("rest"))

    def second(x: Column) -> Column:
        of = lambda kind: F.get(F.filter(x["rest"], lambda p: p["type"] == kind), F.lit(0))
        return F.struct(x["p"].alias("p"), x["used"].alias("used"), x["rest"].alias("rest"), of("business").alias("b2"), of("home").alias("h2"))

    def filled(x: Column) -> Column:
        value = lambda k: F.when(F.get(x["used"], F.lit(k)) > 0, F.get(x["p"], F.get(x["used"], F.lit(k)) - 1)["value"])
        others = F.filter(x["rest"], lambda p: ~p["at"].eqNullSafe(x["b2"]["at"]) & ~p["at"].eqNullSafe(x["h2"]["at"]))
        named = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
        seconds = F.filter(F.array(named("BusinessPhone2", x["b2"]["value"]), named("HomePhone2", x["h2"]["value"])), lambda e: e["value"].isNotNull())
        overflow = F.filter(F.transform(others, lambda p, i: F.struct(F.get(slots, i).alias("key"), p["value"].alias("value"))), lambda e: e["key"].isNotNull())
        return F.struct(value(0).alias("business"), value(1).alias("mobile"), value(2).alias("home"), value(3).alias("fax"), F.map_from_entries(F.concat(seconds, overflow)).alias("more"))

    return reduce(let, (places, left, second, filled), phones)


def contact_dto(envelopes: DataFrame, envelope: str = "envelope") -> DataFrame:
    """Adds dto: what the contact store keeps of a payload."""
    c = F.col(envelope)["contact"]
    blank = lambda x: C.blank_to_null(x)
    built = F.nullif(F.concat_ws(" ", blank(c["given_name"]), blank(c["surname"])), F.lit(""))
    full = F.coalesce(blank(c["full_name"]), built)
    rows = envelopes.withColumn("_full", full).withColumn("_given", F.coalesce(blank(c["given_name"]), F.nullif(C.first_names(F.col("_full")), F.lit("")))).withColumn("_surname", F.coalesce(blank(c["surname"]), F.nullif(C.last_name(F.col("_full")), F.lit(""))))
    rows = rows.withColumn("_slots", phone_slots(dto_phones(c["phones"])))
    s = F.col("_slots")
    display = F.coalesce("_full", F.nullif(F.concat_ws(" ", "_given", "_surname"), F.lit("")), blank(c["email"]), s["business"], s["mobile"], s["home"], s["fax"], F.lit("Unknown Contact"))
    email = blank(c["email"])
    notes = F.nullif(
        F.concat_ws("\n", F.concat(F.lit("source_message_id="), blank(F.col(envelope)["source_message_id"])), F.concat(F.lit("address="), blank(c["address"])), blank(c["notes"])),
        F.lit(""),
    )
    by_slot = lambda x: F.when(email.isNotNull(), F.create_map(F.lit("EmailAddress1"), x)).otherwise(F.create_map().cast("map<string,string>"))
    dto = F.struct(
        display.alias("display_name"), F.col("_given").alias("given_name"), F.lit(None).cast("string").alias("middle_name"), F.col("_surname").alias("surname"), blank(c["company"]).alias("company"),
        F.lit(None).cast("string").alias("job_title"), display.alias("file_as"), blank(c["website"]).alias("web_page"), by_slot(display).alias("email_display_names"), by_slot(email).alias("emails"),
        F.create_map().cast("map<string,string>").alias("im_addresses"), s["more"].alias("phone_numbers"), F.create_map().cast("map<string,struct<street:string,city:string,state:string,postal_code:string,country_or_region:string>>").alias("addresses"),
        F.lit(None).cast("string").alias("postal_address_key"), email.alias("email"), s["business"].alias("business_phone"), s["home"].alias("home_phone"), s["fax"].alias("business_fax"), s["mobile"].alias("mobile_phone"), notes.alias("notes"),
    )
    return rows.withColumn("dto", dto).drop("_full", "_given", "_surname", "_slots")


def result_row(rows: DataFrame, account: str = "account_key") -> DataFrame:
    """What the service answers for each contact (columns dto and created): status, account, display_name, email, phone."""
    dto = F.col("dto")
    return rows.select(F.when(F.col("created"), "created").otherwise("exists").alias("status"), C.account_or_default(F.col(account)).alias("account"), dto["display_name"].alias("display_name"), dto["email"].alias("email"), F.coalesce(dto["business_phone"], dto["mobile_phone"], dto["home_phone"]).alias("phone"))


def lookup(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Columns key and ews_id: for each new contact the smallest id of a stored one of the same e-mail or the same display name, or null.

    Two equi-joins instead of one on either condition, which would compare all with all. Each stored value brings only its
    smallest id, so no pair is made twice.
    """
    matches = []
    for column in ("email", "display_name"):
        ids = stored.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("ews_id").alias("ews_id"))
        matches.append(new.where(F.col(column).isNotNull()).select(key, column).join(ids, column).select(key, "ews_id"))
    found = reduce(DataFrame.union, matches).groupBy(key).agg(F.min("ews_id").alias("ews_id"))
    return new.select(key).join(found, key, "left")


def first_of_matching(rows: DataFrame, key: str, by: tuple[str, ...] = ("email", "display_name")) -> DataFrame:
    """Rows that would be stored if each in order of `key` were compared with those stored before it: none of them shares a value of `by`; nulls match nothing.

    A row that is the first of all its values is stored, and every other row of these values is not; what is then left undecided
    is decided in the same way. The first row that is left is always decided, and most are in the first round, so rounds are few; each
    costs one aggregate and two joins a column, whatever the size of a group.
    """
    kept, left = None, settle(rows)
    while left.limit(1).count():
        leading = left
        for column in by:
            least = left.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias("_least"))
            leading = leading.join(least, column, "left").where(F.col("_least").isNull() | (F.col("_least") == F.col(key))).select(*rows.columns)
        leading = settle(leading)
        kept = leading if kept is None else kept.union(leading)
        left = left.join(leading.select(key), key, "left_anti")
        for column in by:
            left = left.join(leading.where(F.col(column).isNotNull()).select(column).distinct(), column, "left_anti")
        left = settle(left.select(*rows.columns))
    return rows.limit(0) if kept is None else kept


def insert_rows(new: DataFrame, stored: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """New contacts that are stored nowhere and match no new one that is stored before them, numbered on from the greatest id in use, in order of `key`."""
    absent = new.join(lookup(new, stored, key).where("ews_id is null").select(key), key, "left_semi")
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    return numbered(first_of_matching(absent, key), key, id_col).join(F.broadcast(top)).withColumn(id_col, F.col(id_col) + F.col("_top")).drop("_top")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds numbers from 1 in order, without gathering the rows in one task: each range partition counts on from those before it. Which row is where is put down first, so that counts and rows agree."""
    spread = settle(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    counted = spread.withColumn("_no", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return counted.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part").withColumn(name, F.col("_no") + F.col("_before")).drop("_part", "_no", "_before")


def page_size(n: int | None) -> int:
    """100 unless from 1 to 500."""
    return n if n is not None and 1 <= n <= 500 else 100


def page(rows: DataFrame, order: str, offset: int, size: int | None = None) -> DataFrame:
    """Rows of one page in order, with next_offset: where the next page begins, null on the last one."""
    size = page_size(size)
    got = rows.orderBy(order).offset(offset).limit(size + 1).withColumn("_n", F.row_number().over(Window.orderBy(order)))
    more = got.agg(F.max("_n").alias("_all"))
    return got.join(F.broadcast(more)).where(F.col("_n") <= size).withColumn("next_offset", F.when(F.col("_all") > size, F.lit(offset + size))).drop("_n", "_all")


def listing(rows: DataFrame, account: str = "account_key") -> DataFrame:
    """Contacts counted by account."""
    return rows.groupBy(account).agg(F.count("*").alias("count"))


def primary_email(emails: Column) -> Column:
    """The address in the first slot, else any first one that is not blank."""
    some = F.map_filter(emails, lambda k, v: C.strip(v) != "")
    return F.coalesce(some["EmailAddress1"], F.get(F.map_values(some), F.lit(0)))


def remote_contact(dto: Column, known_phones: tuple[str, ...] = ("BusinessPhone2", "HomePhone2", *V.OVERFLOW_SLOTS, "BusinessPhone", "MobilePhone", "HomePhone", "BusinessFax")) -> Column:
    """struct(body, emails, phones) as the remote store takes them: unknown keys are left out, explicit phones win over the map's."""
    explicit = F.map_filter(F.create_map(F.lit("BusinessPhone"), dto["business_phone"], F.lit("MobilePhone"), dto["mobile_phone"], F.lit("HomePhone"), dto["home_phone"], F.lit("BusinessFax"), dto["business_fax"]), lambda k, v: v.isNotNull())
    others = F.map_filter(dto["phone_numbers"], lambda k, v: (C.strip(v) != "") & k.isin(*known_phones) & ~F.map_contains_key(explicit, k))
    return F.struct(F.concat_ws("\n", F.lit("Automatisch angelegt"), dto["notes"]).alias("body"), F.map_filter(dto["emails"], lambda k, v: C.strip(v) != "").alias("emails"), F.map_concat(others, explicit).alias("phones"))
