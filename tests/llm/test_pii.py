import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(text):
    spans = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum((int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))) for k, c in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return pii.in_order(spans)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("a1.@+-% 0()2é\n", max_size=40), st.text("0123456789 -.+()", max_size=40)))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.in_order(pii.plain_spans(text)) == brute(text)


def test_base_spans_of_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert pii.in_order(pii.plain_spans(r["text"])) == brute(r["text"])


def test_clean_documents_get_nothing_added(spark):
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000).collect():
        assert pii.added_spans(r["text"], pii.in_order(pii.plain_spans(r["text"]))) == []


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write to john.doe at example dot com today", "email", "john.doe at example dot com"),
        ("write to john [at] mail [dot] example [dot] org.", "email", "john [at] mail [dot] example [dot] org"),
        ("x jane(at)example.com y", "email", "jane(at)example.com"),
        ("x jane (at) example (dot) com y", "email", "jane (at) example (dot) com"),
        ("x jane dot roe at example dot com y", "email", "jane dot roe at example dot com"),
        ("mail jane AT example DOT com now", "email", "jane AT example DOT com"),
        ("x jane@example dot com y", "email", "jane@example dot com"),
        ("x jane @ example . com y jane @ example.com z", "email", "jane @ example.com"),
        ("x jаne@exаmple.com y", "email", "jаne@exаmple.com"),
        ("x ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ y", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("x jane​@example.com y", "email", None),
        ("schreib an jane at example punkt de bitte", "email", "jane at example punkt de"),
        ("x 192[.]168[.]1[.]10 y", "ip", "192[.]168[.]1[.]10"),
        ("x 192 dot 168 dot 1 dot 10 y", "ip", "192 dot 168 dot 1 dot 10"),
        ("x 192(dot)168(dot)1(dot)10 y", "ip", "192(dot)168(dot)1(dot)10"),
        ("x １９２.168.1.10 y", "ip", "１９２.168.1.10"),
        ("call +1 five five five one two three four five six seven now", "phone", "+1 five five five one two three four five six seven"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("call +1 (５５２) 555-3899 now", "phone", "+1 (５５２) 555-3899"),
        ("call +1 (552) 555–3899 now", "phone", "+1 (552) 555–3899"),
        ("call +1 (552) 55O-3899 now", "phone", None),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("card 4111 1111 1111 １１１１ ok", "card", "4111 1111 1111 １１１１"),
        ("card 4111–1111–1111–1111 ok", "card", "4111–1111–1111–1111"),
        ("card four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one ok", "card", "four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one"),
    ],
)
def test_disguises(text, kind, part):
    base = pii.in_order(pii.plain_spans(text))
    spans = base + pii.added_spans(text, base)
    got = [text[a:b] for a, b, k in spans if k == kind]
    assert got, (text, spans)
    if part:
        assert part in got, (got, spans)


@pytest.mark.parametrize("text", ["", "He is at home.", "look at this.\nThe one two three", "one two three four five six seven eight nine ten", "at dot com", "5 at 6 dot 7", "x@y", "see it at once. Come now", "at mail.de.\n a.b@c.de at a.b@c.de"])
def test_nothing_to_add(text):
    assert pii.added_spans(text, pii.plain_spans(text)) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "a@b.cd", "k"), (4, "a@b.cd", "k"), (4, "a@b.cd", "k"), (5, "x" * 300_000 + "@" + "1" * 300_000, "k")], "doc_id long, text string, base string")
    rows = pii.find_personal_data(df).collect()
    assert sorted((r["id"] or 0, len(r["base"])) for r in rows) == [(0, 1), (1, 0), (2, 0), (4, 1), (4, 1), (5, 0)]
    assert pii.find_personal_data(df.limit(0)).count() == 0
    assert pii.redact(df.where("doc_id = 4")).first()["text"] == "[EMAIL]"
    assert [tuple(r) for r in pii.redact(df.where("doc_id < 3")).collect()] == [(1, None, "k"), (2, "", "k")]


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("x one nine two dot one six eight dot one dot one y", "ip", "one nine two dot one six eight dot one dot one"),
        ("x one zero dot zero dot zero dot one y", "ip", "one zero dot zero dot zero dot one"),
        ("x 10.0.0.one y", "ip", "10.0.0.one"),
        ("x ten 192.one six eight.1.1 y", "ip", "192.one six eight.1.1"),
        ("x one[.]two[.]three[.]four y", "ip", "one[.]two[.]three[.]four"),
        ("call +49 151 two three 456789 now", "phone", "+49 151 two three 456789"),
        ("call +four nine 151 23456789 now", "phone", "+four nine 151 23456789"),
        ("card four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one ok", "card", "four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one"),
        ("card four,one,one,one,one,one,one,one,one,one,one,one,one,one,one,one ok", "card", "four,one,one,one,one,one,one,one,one,one,one,one,one,one,one,one"),
    ],
)
def test_few_spelled_digits(text, kind, part):
    base = pii.in_order(pii.plain_spans(text))
    assert [text[a:b] for a, b, k in pii.added_spans(text, base) if k == kind] == [part]


LONG = "x" * 150


@pytest.mark.parametrize(
    "text, part",
    [
        (f"to {LONG} [at] mail dot example dot org now", f"{LONG} [at] mail dot example dot org"),
        (f"to {'a dot ' * 200}b at c dot de.", f"{'a dot ' * 200}b at c dot de"),
        ("to jane at" + " " * 5000 + "example dot com now", "jane at" + " " * 5000 + "example dot com"),
        ("to jane [ at ] beispiel [.] at bitte", "jane [ at ] beispiel [.] at"),
        ("to jane at beispiel dot at bitte", "jane at beispiel dot at"),
        ("to john [dot] doe@example.com now", "john [dot] doe@example.com"),
        ("to jane@example.com [dot] au now", "jane@example.com [dot] au"),
        ("a at b.com, c at d.org and e at f dot g dot net", "e at f dot g dot net"),
        ("to jane (at] example (dot) com", None),
        ("to jane ⓐⓣ example.com or j\u0430ne@ex\u0430mple.com", "j\u0430ne@ex\u0430mple.com"),
    ],
)
def test_disguised_addresses_are_whole(text, part):
    base = pii.in_order(pii.plain_spans(text))
    got = [text[a:b] for a, b, k in pii.added_spans(text, base) if k == "email"]
    assert part in got if part else got == []


@pytest.mark.parametrize("digits", ["१९२.१६८.१.१०", "১৯২.168.1.10", "𝟏𝟗𝟐.168.1.10", "①⑨②.168.1.10", "¹92.168.1.10"])
def test_digits_of_all_scripts(digits):
    assert pii.added_spans(f"x {digits} y", []) == [(2, 2 + len(digits), "ip")]


def test_what_holds_a_plain_address_is_added_and_the_plain_one_stays():
    text = "to john [dot] doe@example.com now"
    assert pii.plain_spans(text) == [(14, 29, "email")]
    assert pii.added_spans(text, pii.plain_spans(text)) == [(3, 29, "email")]
    assert pii.redact_text(text) == "to [EMAIL] now"


@pytest.mark.parametrize(
    "piece",
    [" ", "[", "[ ", "7", "7 ", "one ", "one" + " " * 400, " at ", "at dot ", " dot ", "a dot ", "a at a dot ", "a.", "@", "a@", " @ ", "a [dot] ", "(at)", "a(at)b.", "plus ", "1 (", "1.", "+1(", "1[", "+", "1  dot ", "\u0661", "one.", "7 dot"],
)
def test_time_is_linear(piece):
    for head, tail in (("", ""), ("one", "x"), ("a at", ""), ("x@", "dot"), ("", " at b.com")):
        text = head + (piece * (200_000 // len(piece) + 1))[:200_000] + tail
        began = time.process_time()
        pii.added_spans(text, pii.in_order(pii.plain_spans(text)))
        assert time.process_time() - began < 2.5, (head, tail)
