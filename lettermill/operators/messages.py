"""Row-level message stages on DataFrames: each is one Arrow pass over whole texts, fused where stages follow each other."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lettermill.functions import contact_rules as R
from lettermill.functions import lenient_json as J
from lettermill.functions import segments as S
from lettermill.functions.html_text import html_to_text, mime_parts

#: Rows in a batch that goes back to the JVM.
ROWS = 1_000
CONTACT = "struct<full_name:string,company:string,email:string,phone:string,address:string,website:string,phone_numbers:array<struct<type:string,raw:string>>,source_text:string,display_name_fallback:string>"


def flat_map(df: DataFrame, columns: list[str | Column], make: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """Rows that `make` gives for the values of each row's columns; batches stay small whatever the texts' sizes."""

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    held += make(*row)
                    if len(held) >= ROWS:
                        yield _batch(held, schema)
                        held = []
        if held:
            yield _batch(held, schema)

    return df.select(*columns).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Columns key and text."""
    return flat_map(pages, [key, html], lambda k, h: [(k, html_to_text(h))], f"`{key}` {_key_type(pages, key)}, text string")


def mime_files(files: DataFrame) -> DataFrame:
    """Columns path, subject, body of binary files (columns path and content)."""
    return flat_map(files, ["path", "content"], lambda p, c: [(p, *mime_parts(c))], "path string, subject string, body string")


def thread_parts(mails: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, part_no (from 0), part."""
    return flat_map(mails, [key, text], lambda k, t: [(k, n, p) for n, p in enumerate(S.thread_parts(t))], f"`{key}` {_key_type(mails, key)}, part_no int, part string")


def segments(mails: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, segment_no (from 0), query_type, segment, source."""
    return flat_map(mails, [key, text], lambda k, t: [(k, n, *s) for n, s in enumerate(S.segments(t))], f"`{key}` {_key_type(mails, key)}, segment_no int, query_type string, segment string, source string")


def greeting_lines(lines: DataFrame, key: str) -> DataFrame:
    """Columns key, line_no and score of the lines that greet: 100 by pattern, else the best similarity to a greeting."""

    def make(k, n, line):
        if S.is_greeting(line or ""):
            text = S.normal(line)
            yield k, n, 100.0 if S._GREETING.fullmatch(text) else max(S.ratio(text, g) for g in S.V.FUZZY_GREETINGS)

    return flat_map(lines, [key, "line_no", "line"], make, f"`{key}` {_key_type(lines, key)}, line_no int, score double")


def parsed(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """Columns key, allowed and answer (JSON): the first object of each response, null if none loads."""

    def make(k, text):
        value = J.first_object(text)
        flag = value.get("is_allowed") if value else None
        yield k, flag if isinstance(flag, bool) else None, json.dumps(value, ensure_ascii=False) if value is not None else None

    return flat_map(responses, [key, raw], make, f"`{key}` {_key_type(responses, key)}, allowed boolean, answer string")


def _struct(contact: dict) -> dict:
    return {k: contact.get(k) for k in (*R.FIELDS, "phone_numbers", "source_text", "display_name_fallback")}


def structured_contacts(mails: DataFrame, key: str, text: str) -> DataFrame:
    return _contacts(mails, key, text, R.structured)


def signature_contacts(mails: DataFrame, key: str, text: str) -> DataFrame:
    return _contacts(mails, key, text, R.signatures)


def rule_contacts(mails: DataFrame, key: str, text: str) -> DataFrame:
    """Contacts by rules alone, list lines before signatures, merged."""
    return _contacts(mails, key, text, lambda t: R.merge(R.structured(t) + R.signatures(t)))


def _contacts(mails: DataFrame, key: str, text: str, rule: Callable[[str], list[dict]]) -> DataFrame:
    """Columns key, contact_no (from 0), contact."""
    return flat_map(mails, [key, text], lambda k, t: [(k, n, _struct(c)) for n, c in enumerate(rule(t or ""))], f"`{key}` {_key_type(mails, key)}, contact_no int, contact {CONTACT}")


def merged(contacts: DataFrame, key: str, array: str = "contacts") -> DataFrame:
    """Columns key and contacts: each message's array of contacts, in order, folded together."""
    ddl = f"`{key}` {_key_type(contacts, key)}, contacts array<{CONTACT}>"
    return flat_map(contacts, [key, array], lambda k, cs: [(k, [_struct(c) for c in R.merge(cs or [])])], ddl)


#: A classifier takes (query_type, segment) pairs and gives raw answers, one for each.
Classifier = Callable[[list[tuple[str, str]]], list[str]]


def rule_classifier(pairs: list[tuple[str, str]]) -> list[str]:
    """Stands in for a model: a segment is allowed if it has a telephone number, which the answer names with an address and a name beside it."""
    out = []
    for _, text in pairs:
        phone, email = R.P.phone_in(text), R.P.first_email(text)
        answer = {"is_allowed": bool(phone)}
        if phone:
            answer |= {"phone": phone, "email": email, "full_name": R.infer_name(text, phone)}
        out.append(json.dumps(answer))
    return out


def decide(mails: DataFrame, key: str, text: str, classifier: Classifier = rule_classifier) -> DataFrame:
    """Columns key, disposition, contacts: segmentation, classification, parsing, normalisation and merging of each message in one pass.

    The classifier sees a message's segments together. A message with a contact is relevant; without one it is irrelevant if
    all its segments were denied, or all allowed; else, and if it has no segments, unknown.
    """

    def make(k, mail):
        found = S.segments(mail)
        answers = [J.first_object(a) for a in classifier([(kind, text) for kind, text, _ in found])] if found else []
        flags = [a.get("is_allowed") if a else None for a in answers]
        contacts = [c | {"source_text": source} for a, (_, _, source) in zip(answers, found, strict=True) for c in (R.contacts_of(a, source) if a and a.get("is_allowed") is True else [])]
        sources = dict.fromkeys(source for _, _, source in found)
        contacts = R.merge(contacts + [c for s in sources for c in R.structured(s) + R.signatures(s)])
        if contacts:
            disposition = "relevant"
        else:
            disposition = "irrelevant" if flags and (all(f is False for f in flags) or all(f is True for f in flags)) else "unknown"
        yield k, disposition, [_struct(c) for c in contacts]

    return flat_map(mails, [key, text], make, f"`{key}` {_key_type(mails, key)}, disposition string, contacts array<{CONTACT}>")


def public(decisions: DataFrame, key: str) -> DataFrame:
    """Columns key and result (JSON): null, the one contact, or the list of them, without private fields."""
    shown = F.transform("contacts", lambda c: c.dropFields("source_text", "display_name_fallback"))
    return decisions.select(key, F.when(F.size("contacts") == 0, F.lit(None).cast("string")).when(F.size("contacts") == 1, F.to_json(F.get(shown, F.lit(0)))).otherwise(F.to_json(shown)).alias("result"))


PROMPT = (
    "You read one part of a business mail and answer with one JSON object.\n"
    "Say whether the part names a contact person with a telephone number (is_allowed), and give full_name, company, email, phone, address and website\n"
    "exactly as the text has them; leave what it does not say empty. List several contacts under contacts.\n"
    "The part is the {kind} of the mail:\n{text}"
)


def prompt(query_type: Column, text: Column) -> Column:
    """What a model is asked about a segment; an error when read for any other type than context and signature."""
    asked = F.replace(F.replace(F.lit(PROMPT), F.lit("{kind}"), query_type), F.lit("{text}"), F.coalesce(text, F.lit("")))
    return F.when(F.assert_true(query_type.isin("context", "signature"), F.concat(F.lit("unknown query type "), query_type)).isNull(), asked)


def as_list(answer: Column) -> Column:
    """A public result as an array of JSON texts: nothing, the one object, or each of a list."""
    listed = F.from_json(answer, "array<string>")
    return F.when(answer.isNull(), F.array().cast("array<string>")).when(F.ltrim(answer).startswith("["), listed).otherwise(F.array(answer))


def payload_rows(decisions: DataFrame, key: str, text: Column | str | None = None) -> DataFrame:
    """One row for each contact of decided messages, as `contacts.payload` takes it: id, its fields, and its payload phones.

    Numbers are looked for in the contact's source text, or in the column `text` where it has none.
    """
    rows = decisions.select(F.col(key).alias("id"), F.explode("contacts").alias("c"), (F.lit("") if text is None else F.col(text) if isinstance(text, str) else text).alias("text"))

    def make(k, contact, mail):
        phones = R.payload_phones(contact, contact.get("source_text") or mail or "")
        yield (k, *(contact.get(f) for f in ("full_name", "display_name_fallback", "company", "email", "address", "website")), "", [{"type": p["type"], "raw": p["raw"], "e164": p.get("e164")} for p in phones])

    ddl = f"id {_key_type(decisions, key)}, full_name string, display_name_fallback string, company string, email string, address string, website string, notes string, phones array<struct<type:string,raw:string,e164:string>>"
    return flat_map(rows, ["id", "c", "text"], make, ddl)
