"""Column expressions say the same as the plain functions on strings."""

import pytest
from pyspark.sql import functions as F

from lettermill import schemas
from lettermill.functions import columns as C
from lettermill.functions import contact_rules as R
from lettermill.functions import people as P
from lettermill.functions import segments as S
from lettermill.operators import lines as L
from lettermill.operators import messages as texts

LINES = [
    "", "  ", "Von: Eva", "From", "to.", "plain Betreff: x", "An: a@b.de", "cc:a@b.de; c@d.de", "a@b.de, c@d.de", "a@b.de c@d.de", "Reply-To: <a@b.de>", "Hallo Eva,", "Hallo, es geht", "Sehr geehrte Damen und Herren",
    "Dear all, we can", "Guten Tag!", "Moin moin", "Bericht", "hi", "Mit freundlichen Grüßen", "--", "MfG Eva", "Tel. 0228 123456", "Mobil: +49 171 223344", "Fax 0049 228 55 66", "E-Mail: a@b.de", "www.nord.de",
    "Eva Lang GmbH", "Straße 1", "Am Fluss", "e.V.", "Magazin", "AG", "Rust", "Amtsgericht Bonn HRB 1234567", "• Nord • Tel 0228 123456 • www.nord.de", "• nur so", "Nord - Eva Lang; +49 228 1112233; a@b.de",
    "Am 3. Mai schrieb Eva:", "On Monday Eva wrote:", "-----Original Message-----", "----- Weitergeleitete Nachricht -----", "Anfang der weitergeleiteten Nachricht", "Gesendet am Montag", "WG: Plan", "demo", "Testament", "test12", "example.org",
    "> zitiert", ">> mehr", "x > y", "Handy 0171 5556667", "privat: 0228 1234567", "Hotel 0228 1234567", "Zentrale 0228 1234567", "direct +1 555 1234567", "0043 1 234567", "+43 1 234567", "030/123456", "123456", "000000", "+", "0049", "ÄÖÜ äöü ß", "a\tb  c",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "n int, line string").coalesce(1)


def got(rows, column):
    return [r[0] for r in rows.orderBy("n").select(column(F.col("line"))).collect()]


@pytest.mark.parametrize(
    "column, plain",
    [
        (C.clean_text, P.clean), (C.ascii_fold, P.fold), (C.phone_digits, P.digits), (C.website_host, R.host), (C.preamble_key, S.normal), (C.header_key, S.header_key),
        (C.is_header_line, lambda x: S.described(x).header), (C.is_history_intro, lambda x: S.described(x).intro), (C.is_signature_marker, S.is_sign_off),
        (C.is_recipient_line, R.is_recipient_line), (C.has_business_hint, P.has_business_hint), (C.is_placeholder, R.is_placeholder),
        (C.is_legal_footer, lambda x: bool(R._LEGAL.search(x) or "•" in x and R._FOOTER.search(x) and P.PHONE.search(x))),
        (C.is_continuation, lambda x: bool(x.strip() and not R._LIST_LINE.search(P.clean(x)) and (R._CONTINUES.search(P.clean(x)) or R._EMAIL.search(x)))),
        (C.is_greeting, lambda x: S.is_greeting(x) and (S._GREETING.fullmatch(S.normal(x)) is not None or S.normal(x).startswith(("sehr geehrte", "dear ")))),
        (C.hinted_phone_type, R.phone_type), (C.phone_type, R.payload_type), (C.phone_display, R.display), (C.phone_e164, R.e164), (lambda c: C.phone_display(c, True), lambda x: R.display(x, True)),
        (C.phones_in, P.PHONE.findall), (C.emails_in, R._EMAIL.findall), (C.without_quote, lambda x: __import__("re").sub(r"^\s*>+\s?", "", x)),
    ],
)
def test_same(rows, column, plain):
    assert got(rows, column) == [plain(x) for x in LINES]


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "line string")
    for f in (C.clean_text, C.strip, C.ascii_fold, C.phone_digits, C.website_host, C.header_key, C.phone_display, C.phone_e164, C.email_local, C.strip_fences):
        assert df.select(f(F.col("line"))).first()[0] == ""
    assert df.select(C.project_number(F.col("line"))).first()[0] is None
    assert df.select(C.allowed_flag(F.col("line"))).first()[0] is None
    assert df.select(C.phones_in(F.col("line"))).first()[0] == []


@pytest.mark.parametrize("subject, number", [(" 12 345 Angebot", "12-345"), ("12-345", "12-345"), ("AW: 12 345", None), ("123 45", None)])
def test_project_number(spark, subject, number):
    assert spark.createDataFrame([(subject,)], "s string").select(C.project_number(F.col("s"))).first()[0] == number


def test_hash(spark):
    df = spark.createDataFrame([("abc",), ("",)], "s string")
    assert [r[0][:16] for r in df.select(C.content_hash(F.col("s"))).collect()] == ["BA7816BF8F01CFEA", "E3B0C44298FC1C14"]


def test_file_names(spark):
    df = spark.createDataFrame([(" a ",), ("a/b",), ("..",), ("a..b",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(C.safe_file_name(F.col("s"))).collect()] == ["a", None, None, None, None, None]


def test_names(spark):
    df = spark.createDataFrame([("Eva  Maria Lang",), ("Eva",), ("",)], "s string")
    assert [tuple(r) for r in df.select(C.first_names(F.col("s")), C.last_name(F.col("s"))).collect()] == [("Eva Maria", "Lang"), ("Eva", ""), ("", "")]
    two = spark.createDataFrame([("Lang, Eva Einkauf", "Eva Lang"), ("Eva", "Eva Lang"), ("x", "")], "line string, name string")
    assert [r[0] for r in two.select(C.line_matches_name(F.col("line"), F.col("name"))).collect()] == [True, False, False]


BLOCK = ["x@y.de, z@y.de", "Eva Lang", "Nord", "Tel 0228 123456", "Mobil 0171 55566", "", "Ende"]


def test_line_operators(spark):
    df = spark.createDataFrame([(1, BLOCK)], "id int, l array<string>")
    stops = lambda x: (C.strip(x) == "") | C.is_recipient_line(x)
    b = df.select(L.block_bounds(F.col("l"), F.lit(3), stops).alias("b")).first()["b"]
    assert (b["first"], b["last"]) == (1, 4) == R.block_bounds(BLOCK, 3)
    assert df.select(L.run_after(F.col("l"), F.lit(3), C.is_continuation)).first()[0] == ["Mobil 0171 55566"]
    near = spark.createDataFrame([([1, 5, 9],), ([4, 2],), ([],)], "p array<int>")
    assert [r[0] for r in near.select(L.nearest_either_way(F.col("p"), F.lit(3), 4)).collect()] == [1, 2, None]
    assert df.select(L.signature_start(F.col("l"))).first()[0] == 0
    scope = L.scope(df, "id", "l", lambda x: x.contains("Tel"), lambda x: x.contains("Lang"))
    assert sorted(r["line_no"] for r in scope.collect()) == [1, 2, 3, 4, 5]
    assert L.scope(df, "id", "l", lambda x: x.contains("Tel"), lambda x: x.contains("nobody")).count() == 0
    above = L.nearest_above(df, "id", "l", lambda x: x.contains("Tel"), lambda x: x.rlike("^[A-Z][a-z]+ [A-Z][a-z]+$")).first()
    assert (above["above_no"], above["above"]) == (1, "Eva Lang")
    text = spark.createDataFrame([("a\r\nb\x0bc\n",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(L.universal_lines(F.col("t"))).collect()] == [["a", "b", "c"], [], []]


def test_payload_phones():
    text = "Max: 0171 9998887\n\nWeiteres\nKontakt\nEva Lang\nTel: 0049 228 123456\nFax: 0228 123457\nHRB 1234567"
    phones = R.payload_phones({"full_name": "Eva Lang", "phone": "0228 123456", "phone_numbers": [{"type": "mobil", "raw": "x", "e164": "+491701234567"}]}, text)
    assert phones == [
        {"type": "business", "raw": "+49 228 123456", "e164": "+49228123456"},
        {"type": "mobile", "raw": "+49 170 1234567", "e164": "+491701234567"},
        {"type": "business", "raw": "+49 228 123456", "e164": "+49228123456"},
        {"type": "fax", "raw": "+49 228 123457", "e164": "+49228123457"},
    ]
    assert R.payload_phones({"phone": "12"}) == []
    assert [p["raw"] for p in R.payload_phones({}, "Tel 0043 1 234567")] == ["+49 043 1234567"]


def test_public_lists(spark):
    df = spark.createDataFrame([(None,), ('{"a":1}',), ('[{"a":1},{"a":2}]',)], "r string")
    assert [r[0] for r in df.select(texts.as_list(F.col("r"))).collect()] == [[], ['{"a":1}'], ['{"a":1}', '{"a":2}']]


def test_schemas(spark):
    empty = spark.createDataFrame([], schemas.schema_of("mail_inbox"))
    assert schemas.expect(empty.withColumn("more", F.lit(1)), "mail_inbox").columns == empty.columns
    with pytest.raises(ValueError, match="hash"):
        schemas.expect(empty.drop("hash"), "mail_inbox")
    rows = spark.createDataFrame([(1, "h", "c", False, False, "a", 0, None), (2, "h", "c", False, False, "a", 0, None), (3, None, "c", False, False, "a", 0, None)], schemas.schema_of("mail_inbox"))
    assert {(r["rule"], r["n"]) for r in schemas.violations(rows, "mail_inbox").collect()} == {("unique(hash, account)", 1), ("hash is present", 1)}
    assert schemas.with_account(rows.drop("account")).first()["account"] == "bewerbung"
    people = spark.createDataFrame([(1,)], "id int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.schema_of("contacts")))
    assert {r["rule"] for r in schemas.violations(people, "contacts").collect()} == {"a name is present", "a phone is present"}


@pytest.mark.parametrize("block", [4_000_000, 3])
def test_occurrences(spark, block):
    from lettermill.operators.grounding import occurrences

    docs = spark.createDataFrame([(1, "Eva Lang, Bonn"), (2, "bonn"), (3, None)], "id int, t string")
    values = spark.createDataFrame([(10, "BONN"), (11, "eva"), (12, " "), (13, None), (14, "Köln")], "item int, v string")
    assert sorted(map(tuple, occurrences(docs, values, "id", "t", "item", "v", block).collect())) == [(1, 10), (1, 11), (2, 10)]
