"""Row-level stages by cases."""

import pytest

from lettermill.functions import contact_rules as R
from lettermill.functions import html_text as H
from lettermill.functions import lenient_json as J
from lettermill.functions import people as P
from lettermill.functions import segments as S


@pytest.mark.parametrize(
    "given, name",
    [
        ("Herr Dr. Max Muster", "Max Muster"), ("Muster, Max", "Max Muster"), ("i.A. Prof. Dr. Eva Lang", "Eva Lang"), ("Eva Lang MBA", "Eva Lang"), ("Eva", ""), ("", ""),
        ("Dipl.-Ing. Jan Groß", "Jan Groß"), ("  Eva   Lang:", "Eva Lang"), ("ppa. Eva Lang", "Eva Lang"),
    ],
)
def test_person(given, name):
    assert P.person(given) == name


@pytest.mark.parametrize("line, yes", [("Eva Lang", True), ("EVA LANG", True), ("Eva Lang GmbH", False), ("Viele Grüße", False), ("Guten Tag", False), ("Hallo Eva", False), ("Im Garten", False), ("Team Support", False), ("Eva Lang 2", False), ("Eva-Maria Lang", True), ("eva lang", False)])
def test_is_person(line, yes):
    assert P.is_person(line) is yes


@pytest.mark.parametrize("email, name", [("eva.lang@x.example", "Eva Lang"), ("info@x.example", ""), ("evalang@lang.example", "Eva Lang"), ("eva.lang+news@x.example", "Eva Lang"), ("no mail", "")])
def test_name_of_email(email, name):
    assert P.name_of_email(email) == name


def test_mailboxes_and_names():
    assert P.mailbox_matches("e.lang@x.example", "Eva Lang") and P.mailbox_matches("elang@x.example", "Eva Lang")
    assert P.mailbox_conflicts("max.muster@x.example", "Eva Lang") and not P.mailbox_conflicts("info@x.example", "Eva Lang")
    assert P.compatible("Eva Lang", "E. Lang") and P.compatible("Eva Maria Lang", "Eva Lang") and not P.compatible("Eva Lang", "Max Muster")
    assert P.is_role_only("Eva Lang", "Geschäftsführer: Eva Lang\nBonn") and not P.is_role_only("Eva Lang", "Geschäftsführer: Eva Lang\nEva Lang, Einkauf")
    assert P.name_on_phone_line("Firma Nord - Eva Lang; 0228 123456") == "Eva Lang"
    assert P.name_on_phone_line("Ansprechpartner: Eva Lang 0228 123456") == "Eva Lang"
    assert P.phone_in("HRB 123456") == "" and P.phone_in("Tel. 0228 123456") == "0228 123456"


def test_ratio():
    assert S.ratio("hallo", "hallo") == 100 and S.ratio("", "") == 100 and S.ratio("abc", "xyz") == 0
    assert abs(S.ratio("guten tga", "guten tag") - 200 * 8 / 18) < 1e-9


@pytest.mark.parametrize("line, yes", [("Hallo Eva,", True), ("Sehr geehrte Damen und Herren,", True), ("Sehr geehrte Damen und Herrn", True), ("Gutn Tag", True), ("Hallo Eva, bitte rufen Sie an", False), ("Hallo, es geht los", False), ("Bericht", False), ("Dear all", True), ("Dear all, we can start", False)])
def test_greetings(line, yes):
    assert S.is_greeting(line) is yes


@pytest.mark.parametrize(
    "mail, parts",
    [
        ("Neu\n\nAm 3. Mai schrieb Eva:\nAlt", ["Neu", "Alt"]),
        ("Neu\n> Alt\n> mehr\nSchluss", ["Neu", "Alt\nmehr\nSchluss"]),
        ("Neu\n-----Original Message-----\nAlt", ["Neu", "Alt"]),
        ("Neu\nVon: a\nAn: b\nBetreff: c\nAlt", ["Neu", "Von: a\nAn: b\nBetreff: c\nAlt"]),
        ("plain\nVon: a\nAn: b\nAlt", ["plain\nVon: a\nAn: b\nAlt"]),
        ("Nur <a@b.de>", ["Nur <a@b.de>"]),
        ("", []), (None, []), (" \n", []),
    ],
)
def test_threads(mail, parts):
    assert S.thread_parts(mail) == parts


def test_headers_and_preamble():
    assert S.without_headers("Von:\n<eva@x.example>\nAn: max@x.example\n\nText\n\n\n\nEnde") == "Text\n\nEnde"
    assert S.without_preamble("Betreff: Neues\nvon heute\n\nHallo Max,\nbitte melden.") == "bitte melden."
    assert S.without_preamble("From: a\nTo: b\nHallo,\nInhalt") == "Inhalt"
    assert S.without_preamble(None) == ""


def test_signatures():
    mail = "Hallo Max,\nbitte melden.\nBeste Grüße\nEva Lang\nNord GmbH\nTelefon: 0228 123456"
    assert S.context_and_signature(mail) == ("bitte melden.", "Nord GmbH\nTelefon: 0228 123456", "Beste Grüße\nEva Lang\nNord GmbH\nTelefon: 0228 123456")
    assert [s[0] for s in S.segments(mail)] == ["context", "signature"]
    assert S.segments("Hallo,") == [("context", "Hallo,", "Hallo,")]
    assert S.segments(None) == []


@pytest.mark.parametrize(
    "raw, value",
    [
        ('{"is_allowed": "yes", "a": 1}', {"is_allowed": True, "a": 1}), ("```json\n{'is_allowed': True, 'a': None,}\n```", {"is_allowed": True, "a": None}),
        ("so: {“a”: “true story”} end", {"a": "true story"}), ('"{\\"a\\": 1}"', {"a": 1}), ("nothing", None), (None, None), ("{bad}", None), ("{'a': {'b': [1, 2,]}}", {"a": {"b": [1, 2]}}),
    ],
)
def test_lenient_json(raw, value):
    assert J.first_object(raw) == value


def test_first_allowed():
    assert J.first_allowed('{"is_allowed": false} {"is_allowed": true, "n": 2}')["n"] == 2
    with pytest.raises(ValueError):
        J.first_allowed('{"is_allowed": false}')


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>Guten <b>Tag</b><br>Max</div><p>x</p>", "Guten Tag\nMax\nx"), ("<p>a&nbsp; b<script>c</script><style>d</style></p>", "a b"), ("From:<br>&quot;&lt;<br>a@b.de<br>&gt;<br>Text", "From:\na@b.de\nText"),
        (None, ""), ("", ""), ("<b>a</b>b", "a b"), ("<p>a<p>b", "a b"),
    ],
)
def test_html(page, text):
    assert H.html_to_text(page) == text


def test_mime():
    from email.message import EmailMessage

    m = EmailMessage()
    m["Subject"] = "12 345 Plan"
    m.set_content("plain text")
    assert H.mime_parts(m.as_bytes()) == ("12 345 Plan", "plain text\n")
    m.add_alternative("<p>rich <b>text</b></p>", subtype="html")
    m.add_attachment("no body", subtype="html", filename="x.html")
    assert H.mime_parts(m.as_bytes()) == ("12 345 Plan", "rich text")
    assert H.mime_parts(None) == (None, "")


LIST = "Unsere Leute:\nNord Bau - Eva Lang; +49 228 1112233; eva.lang@nord.invalid\nMobil: +49 171 2223344\n\nFax: +49 228 5558801\nSüd Bau - Dr. Max Muster; +49 89 5558800;\nservice@sued.invalid\nEnde"


def test_structured():
    one, two = R.structured(LIST)
    assert (one["full_name"], one["company"], one["phone"], one["email"]) == ("Eva Lang", "Nord Bau", "+49 228 1112233", "eva.lang@nord.invalid")
    assert one["phone_numbers"] == [{"type": "business", "raw": "+49 228 1112233"}, {"type": "mobile", "raw": "+49 171 2223344"}, {"type": "fax", "raw": "+49 228 5558801"}]
    assert one["source_text"].count("\n") == 2
    assert (two["full_name"], two["email"]) == ("Max Muster", "service@sued.invalid")


SIGNATURE = "Hallo Team,\n\nViele Grüße\nEva Lang\nPLANUNGSBÜRO OST GmbH\nRing 1\nTelefon: +49 30 123456\nMobil: +49 171 555000\nTelefax: +49 30 123457\nE-Mail: eva.lang@ost.invalid\nRegistergericht Bonn HRB 1234567"


def test_signature_contact():
    (one,) = R.signatures(SIGNATURE)
    assert (one["full_name"], one["phone"], one["email"]) == ("Eva Lang", "+49 30 123456", "eva.lang@ost.invalid")
    assert [p["type"] for p in one["phone_numbers"]] == ["business", "mobile", "fax"]


def test_normalise():
    mail = "Eva Lang\nTel. 0228 / 123456\nwww.nord.invalid"
    good = {"is_allowed": True, "full_name": "Frau Eva Lang", "phone": "0228123456", "website": "https://www.nord.invalid/x", "company": "Erfunden"}
    out = R.normalise(good, mail)
    assert (out["full_name"], out["phone"], out["company"]) == ("Eva Lang", "0228 / 123456", "")
    assert R.normalise(good | {"is_allowed": False}, mail) is None
    assert R.normalise(good | {"phone": "0999 888777"}, "Eva Lang") is None
    assert R.normalise({"is_allowed": True, "phone": "0228 123456", "company": "nord 12"}, "nord 12 0228 123456")["display_name_fallback"] == "nord 12"
    swapped = R.normalise({"is_allowed": True, "full_name": "0228 / 123456", "phone": "Eva Lang"}, mail)
    assert (swapped["full_name"], swapped["phone"]) == ("Eva Lang", "0228 / 123456")
    other = R.normalise({"is_allowed": True, "full_name": "Eva Lang", "phone": "0228 123456", "email": "max.muster@nord.invalid"}, mail + "\nmax.muster@nord.invalid")
    assert other["email"] == ""


def test_merge():
    base = dict.fromkeys(R.FIELDS, "")
    company = base | {"company": "Nord", "phone": "0228 1234567", "email": "eva.lang@nord.invalid", "phone_numbers": [{"type": "fax", "raw": "0228 7654321"}]}
    eva = base | {"full_name": "Eva Lang", "phone": "0228 1234567", "email": "eva.lang@nord.invalid", "phone_numbers": [{"type": "mobile", "raw": "0171 555000"}]}
    (one,) = R.merge([company, eva])
    assert one["full_name"] == "Eva Lang" and one["company"] == "Nord" and len(one["phone_numbers"]) == 3
    assert len(R.merge([eva, eva | {"full_name": "Max Muster", "email": "max@nord.invalid"}])) == 2
    assert R.merge([eva, eva]) == [eva] or len(R.merge([eva, eva])) == 1
    assert R.merge([]) == []


def test_merge_keeps_order_and_types_of_numbers():
    base = dict.fromkeys(R.FIELDS, "")
    company = base | {"company": "Nord", "phone": "1111111", "email": "eva.lang@nord.invalid", "phone_numbers": [{"type": "fax", "raw": "2222222"}]}
    eva = base | {"full_name": "Eva Lang", "phone": "3333333", "email": "eva.lang@nord.invalid", "phone_numbers": [{"type": "mobile", "raw": "4444444"}, {"type": "business", "raw": "4444444"}]}
    (one,) = R.merge([company, eva])
    assert [(p["type"], p["raw"]) for p in one["phone_numbers"]] == [("business", "3333333"), ("business", "1111111"), ("fax", "2222222"), ("mobile", "4444444"), ("business", "4444444")]
    assert one["phone"] == "3333333"
    (two,) = R.merge([eva, company | {"full_name": "Eva Lang"}])
    assert [p["raw"] for p in two["phone_numbers"]] == ["3333333", "1111111", "4444444", "4444444", "2222222"]
    plain = base | {"full_name": "Eva Lang", "phone": "1111111"}
    assert "phone_numbers" not in R.merge([plain, plain | {"company": "Nord"}])[0]


@pytest.mark.parametrize("label", ["Phone", "Mobile", "Fon", "Fax"])
def test_other_labels_begin_no_signature(label):
    assert R.signatures(f"Viele Grüße\nEva Lang\n{label}: +49 228 123456") == []


def test_signature_takes_no_recipients_and_no_labelled_or_titled_names():
    (one,) = R.signatures("An: eva.lang@nord.invalid\nHallo,\n\nEva Lang\nHandy Max Muster\nTel: +49 228 123456")
    assert (one["full_name"], one["email"]) == ("Eva Lang", "")
    (one,) = R.signatures("Eva Lang\nGeschäftsführer: Max Muster\nTel: +49 228 123456 / +49 228 999999\neva.lang@nord.invalid\na@nord.invalid")
    assert (one["full_name"], one["phone"], one["email"]) == ("Eva Lang", "+49 228 123456", "eva.lang@nord.invalid")
    twice = R.signatures("Eva Lang\nTel: +49 228 123456\n\nMax Muster\nTel: +49 228 777777 oder +49 228 123456")
    assert [c["phone"] for c in twice] == ["+49 228 123456", "+49 228 777777"]


def test_contact_lists_have_every_customer(spark):
    from lettermill.plans import catalog

    bodies = [r["body"] for r in catalog.contact_lists(spark, "/root/testdata/sf0.001").collect()]
    keys = [r["c_custkey"] for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()]
    assert sorted(line for b in bodies for line in b.split("\n") if line.startswith("Mobil")) == sorted(f"Mobil: +49 171 {2000000 + k}" for k in keys)
    assert set(range(150)) & {k % 997 for k in keys} <= {r["list_id"] for r in catalog.QUERIES["structured_contacts"](spark, "/root/testdata/sf0.001").collect()}
