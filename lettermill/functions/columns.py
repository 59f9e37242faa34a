"""Scalar functions and predicates as Column expressions; none leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions import vocab as V

#: Unicode white space, for Java.
SPACE = r"(?U)\s"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(c: Column) -> Column:
    """White space to single spaces, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def ascii_fold(c: Column) -> Column:
    """German letters spelled out, then lower case."""
    return F.lower(reduce(lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])), V.GERMAN, F.coalesce(c, F.lit(""))))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))


def website_host(c: Column) -> Column:
    """Host of a web address without scheme, path and www."""
    host = F.split_part(F.regexp_replace(F.lower(clean_text(c)), "^https?://", ""), F.lit("/"), F.lit(1))
    return F.regexp_replace(host, r"^www\.", "")


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")


def collapse_repeats(digits: Column) -> Column:
    """One unit of a number that is the same unit of six digits or more again and again; the shortest unit."""
    return F.regexp_replace(digits, r"^(\d{6,}?)\1+$", "$1")


def email_local(c: Column) -> Column:
    """Before the at sign and before a plus sign, lower case."""
    return F.split_part(F.split_part(F.lower(strip(c)), F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1))


def email_tokens(c: Column) -> Column:
    """Parts of the local part that are letters only."""
    return F.filter(F.split(email_local(c), "[._-]+"), lambda t: t.rlike(r"^\p{L}+$"))


def phone_e164(c: Column) -> Column:
    """+ and digits of numbers that begin with + or 00; any other number has none."""
    raw, digits = clean_text(c), phone_digits(c)
    found = F.when(raw.startswith("+"), digits).when(raw.startswith("00"), F.substring(digits, 3, 64)).otherwise(F.lit(""))
    return F.when(found != "", F.concat(F.lit("+"), found)).otherwise(F.lit(""))


def phone_display(c: Column, foreign_as_written: bool = False) -> Column:
    """+49 XXX REST for German numbers, others as written. Numbers that begin with 00 and another country are
    read as national ones; with `foreign_as_written` they stay."""
    raw, digits = clean_text(c), phone_digits(c)
    national = (
        F.when(raw.startswith("+") & digits.startswith("49"), F.substring(digits, 3, 64))
        .when(raw.startswith("00") & digits.startswith("0049"), F.substring(digits, 5, 64))
        .when(raw.startswith("+") | (raw.startswith("00") & F.lit(foreign_as_written)), F.lit(""))
        .when(raw.startswith("0"), F.substring(digits, 2, 64))
        .otherwise(F.lit(""))
    )
    shown = F.rtrim(F.concat(F.lit("+49 "), F.substring(national, 1, 3), F.lit(" "), F.substring(national, 4, 64)))
    return F.when(digits == "", F.lit("")).when(national == "", raw).otherwise(shown)


def reasonable_digits(digits: Column) -> Column:
    return F.length(digits).between(V.LEAST_PHONE_DIGITS, V.MOST_PHONE_DIGITS)


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def _typed(label: Column, types) -> Column:
    return reduce(lambda w, t: w.when(_contains_any(label, t[1]), F.lit(t[0])), types[1:], F.when(_contains_any(label, types[0][1]), F.lit(types[0][0]))).otherwise(F.lit("other"))


def phone_type(label: Column) -> Column:
    """Canonical type of a free label, by the payload's vocabulary."""
    folded = casefold(clean_text(label))
    short = F.when(~_contains_any(folded, V.PAYLOAD_PHONE_TYPES[0][1]) & folded.isin("m", "mob"), F.lit("mobile"))
    return short.otherwise(_typed(folded, V.PAYLOAD_PHONE_TYPES))


def dto_phone_type(label: Column) -> Column:
    """Canonical type of a free label, by the contact service's vocabulary."""
    return _typed(F.lower(strip(label)), V.DTO_PHONE_TYPES)


def hinted_phone_type(label: Column) -> Column:
    """Canonical type of a line, by the extraction's vocabulary: telephone words without one of the others mean business."""
    folded = ascii_fold(label)
    return (
        F.when(folded.contains("fax"), F.lit("fax"))
        .when(folded.rlike("mobil|handy|cell"), F.lit("mobile"))
        .when(folded.rlike("privat|home"), F.lit("home"))
        .when(folded.rlike("tel|phone|zentrale|durchwahl|direct|office|work"), F.lit("business"))
        .otherwise(F.lit("other"))
    )


def first_names(c: Column) -> Column:
    """All tokens of a name but the last one; of one token that one."""
    parts = F.filter(F.split(clean_text(c), " "), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(clean_text(c))


def last_name(c: Column) -> Column:
    """The last token of a name of two or more."""
    parts = F.filter(F.split(clean_text(c), " "), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def line_matches_name(line: Column, name: Column) -> Column:
    """The line has the name, or both its first and its last token."""
    a, b = casefold(clean_text(line)), casefold(clean_text(name))
    parts = F.split(b, " ")
    return (a != "") & (b != "") & (a.contains(b) | ((F.size(parts) > 1) & a.contains(F.element_at(parts, 1)) & a.contains(F.element_at(parts, -1))))


def folder_key(c: Column) -> Column:
    """Letters and digits of a folder name, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]", "")


def project_number(subject: Column) -> Column:
    """NN-NNN at the start of a subject, or null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(subject, F.lit("")), V.PROJECT_NUMBER, 1), r"\s", "-"), F.lit(""))


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, upper-case hex; null is empty."""
    return F.upper(F.sha2(F.coalesce(c, F.lit("")), 256))


def phone_value(raw: Column, e164: Column) -> Column:
    return F.coalesce(blank_to_null(raw), blank_to_null(e164), F.lit(""))


def phones_in(c: Column, bounded: bool = False) -> Column:
    """All phone-like strings of a text, left to right."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(V.PHONE_BOUNDED if bounded else V.PHONE), F.lit(0))


def emails_in(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(V.EMAIL), F.lit(0))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + V.PLACEHOLDER)


def is_recipient_line(line: Column) -> Column:
    """A header of recipients with an address, or two addresses with a separator."""
    text = strip(line)
    header = F.lower(text).rlike("^(an|to|cc|bcc|kopie|copy|antwort an|reply-to|reply to|von|from):") & text.contains("@")
    return header | ((F.size(emails_in(text)) >= 2) & text.rlike("[;,]"))


def has_business_hint(line: Column) -> Column:
    """A business word; of up to three letters or digits only as a token of its own."""
    folded = F.concat(F.lit(" "), ascii_fold(line), F.lit(" "))
    arms = [rf"(?<![a-z0-9]){re.escape(h.strip())}(?![a-z0-9])" if len(re.sub("[^a-z0-9]", "", h)) <= 3 else re.escape(h) for h in V.BUSINESS_HINTS]
    return folded.rlike("|".join(arms))


def header_key(line: Column) -> Column:
    """The header key that a line begins with, or is, lower case, or the empty string."""
    bare = F.regexp_replace(preamble_key(line), r"^plain\s+", "")
    return F.regexp_extract(bare, "^(" + "|".join(sorted(V.HEADER_KEYS, key=len, reverse=True)) + r")\s*(?::|$)", 1)


def is_header_line(line: Column) -> Column:
    text = preamble_key(line)
    return (header_key(line) != "") | text.rlike(V.HEADER_TEXT) | text.rlike(V.SUBJECT_PREFIX) | text.rlike(V.FORWARD_BANNER) | text.rlike(V.FORWARD_TEXT)


def is_history_intro(line: Column) -> Column:
    text = preamble_key(line)
    return text.rlike(V.FORWARD_BANNER) | text.rlike(V.FORWARD_TEXT) | text.rlike(r"^(am\s+.+\s+schrieb|on\s+.+\s+wrote)\b")


def is_signature_marker(line: Column) -> Column:
    folded = ascii_fold(strip(line))
    return folded.isin(*V.SIGNATURE_RULES) | folded.rlike("^(" + "|".join(V.SIGN_OFFS) + ")")


def is_legal_footer(line: Column) -> Column:
    """A line of register or tax numbers, or a company footer set in bullets with a number."""
    text = clean_text(line)
    low = F.lower(text)
    return low.rlike(V.LEGAL_NUMBER) | (text.contains("•") & low.rlike(V.SIGNATURE_FOOTER) & text.rlike(V.PHONE))


def is_continuation(line: Column) -> Column:
    """A line that goes on with the contact above: labelled, or with an address, and no list item itself."""
    text = clean_text(line)
    item = "(?iu)" + re.sub(r"\(\?P<\w+>", "(", V.CONTACT_LINE)
    return (text != "") & ~text.rlike(item) & (F.lower(text).rlike(V.CONTINUATION) | text.rlike(V.EMAIL))


def preamble_key(line: Column) -> Column:
    """Folded line without marks at its ends, as greetings are compared."""
    return F.btrim(F.regexp_replace(ascii_fold(line), r"(?U)\s+", " "), F.lit(" \t,.;:!?"))


def is_greeting(line: Column) -> Column:
    """A line that only greets, by pattern; typos need the fuzzy form."""
    text = preamble_key(line)
    comma = F.instr(text, ",")
    alone = (comma == 0) & (F.length(text) <= 120) & (F.size(F.split(text, " ")) <= 9) & text.rlike("^(?:" + "|".join(V.GREETINGS) + "),?$")
    return (text != "") & ~text.rlike(V.INLINE_CONTENT) & (text.startswith("sehr geehrte") | text.startswith("dear ") | alone)


def without_quote(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*>+\s?", "")


def value_in_text(value: Column, text: Column) -> Column:
    """The value occurs in the text, whatever the case."""
    return (F.length(strip(value)) > 0) & casefold(text).contains(casefold(strip(value)))


def phone_in_text(phone: Column, text: Column) -> Column:
    """The number's digits, six or more, occur among all digits of the text."""
    digits = phone_digits(phone)
    return (F.length(digits) >= 6) & phone_digits(text).contains(digits)


def strip_fences(c: Column) -> Column:
    """Without Markdown code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def allowed_flag(c: Column) -> Column:
    """true or false of the ways in which a classifier says so; null of anything else."""
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin("true", "1", "yes"), F.lit(True)).when(word.isin("false", "0", "no"), F.lit(False))


def safe_file_name(c: Column) -> Column:
    """The trimmed name if it is a plain file name, else null."""
    name = strip(c)
    return F.when((name != "") & ~name.contains("/") & ~name.contains("..") & ~name.contains("\x00"), name)


def account_or_default(c: Column, default: str = V.DEFAULT_ACCOUNT) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))
