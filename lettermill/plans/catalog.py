"""Named queries over the tables of a data folder, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import columns as C
from lettermill.functions import vocab as V
from lettermill.operators import contacts, filing, ingest, lines, queue
from lettermill.operators import messages as texts
from lettermill.operators.grounding import occurrences
from lettermill.streaming import mail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
PHONE, EMAIL = _quoted(V.PHONE), _quoted(V.EMAIL)
#: SQL of the documents as messages, of their first copies, of their lines, and of phones with places.
MESSAGES = "messages AS (SELECT doc_id AS uid, text AS body, source, upper(sha256(text)) AS hash, upper(sha256(source)) AS account FROM documents)"
LINES = "lines AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1))::INT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
PHONES = f"phones AS (SELECT doc_id, unnest(generate_series(1, len(p)))::INT AS pos, unnest(p) AS raw FROM (SELECT doc_id, regexp_extract_all(text, {PHONE}) AS p FROM documents))"
DIGITS = r"regexp_replace(raw, '\D', '', 'g')"
#: National digits and shown form of a number.
NATIONAL = f"CASE WHEN raw LIKE '+%' AND {DIGITS} LIKE '49%' THEN substr({DIGITS}, 3) WHEN raw LIKE '00%' AND {DIGITS} LIKE '0049%' THEN substr({DIGITS}, 5) WHEN raw LIKE '0%' THEN substr({DIGITS}, 2) ELSE '' END"
DISPLAY = f"CASE WHEN {NATIONAL} = '' THEN raw ELSE rtrim('+49 ' || substr({NATIONAL}, 1, 3) || ' ' || substr({NATIONAL}, 4)) END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as messages of accounts, one account for each source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("body"), "source")
    return ingest.with_hash(docs, account="source")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.numbered(table(spark, sf_dir, "documents"), "doc_id", "text")


def phones(spark: SparkSession, sf_dir: str, bounded: bool = False) -> DataFrame:
    """Columns doc_id, pos (from 1), raw."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(C.phones_in(F.col("text"), bounded)).alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).alias("pos"), "raw")


@query("SELECT doc_id, upper(sha256(text)) AS hash, upper(sha256(source)) AS account FROM documents")
def ingest_hash(spark, sf_dir):
    return messages(spark, sf_dir).select(F.col("uid").alias("doc_id"), "hash", "account")


@query(f"WITH {MESSAGES} SELECT hash, account, min(uid) AS uid FROM messages GROUP BY hash, account")
def ingest_dedup(spark, sf_dir):
    return ingest.first_of_each(messages(spark, sf_dir).select("uid", "hash", "account")).select("hash", "account", "uid")


@query(f"WITH {MESSAGES} SELECT account, uid FROM messages QUALIFY row_number() OVER (PARTITION BY account ORDER BY uid DESC) <= 10")
def ingest_initial_sync(spark, sf_dir):
    return ingest.first_run(messages(spark, sf_dir)).select("account", "uid")


@query(f"""WITH {MESSAGES}, flagged AS (SELECT *, EXISTS (SELECT 1 FROM messages k WHERE k.uid % 37 = 0 AND k.hash = m.hash AND k.account = m.account) AS known FROM messages m),
    newest AS (SELECT account, max(CASE WHEN known THEN uid END) AS at FROM flagged GROUP BY account)
    SELECT f.account, f.uid FROM flagged f JOIN newest n ON f.account = n.account WHERE n.at IS NULL OR f.uid > n.at""")
def ingest_until_known(spark, sf_dir):
    all_messages = messages(spark, sf_dir).select("uid", "hash", "account")
    return ingest.until_known(ingest.known_flag(all_messages, all_messages.where("uid % 37 = 0"))).select("account", "uid")


@query(f"WITH {MESSAGES}, old AS (SELECT DISTINCT hash, account FROM messages WHERE uid % 3 = 0) SELECT m.hash, m.account, min(m.uid) AS uid FROM messages m WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.hash = m.hash AND o.account = m.account) GROUP BY m.hash, m.account")
def ingest_insert_absent(spark, sf_dir):
    all_messages = messages(spark, sf_dir).select("uid", "hash", "account")
    return ingest.insert_absent(all_messages, all_messages.where("uid % 3 = 0")).select("hash", "account", "uid")


@query(f"""WITH {MESSAGES}, old AS (SELECT * FROM messages WHERE uid % 37 = 0 AND source <> 'src3'), fresh AS (
        SELECT uid, hash, account FROM messages WHERE account NOT IN (SELECT account FROM old) QUALIFY row_number() OVER (PARTITION BY account ORDER BY uid DESC) <= 10
    ), flagged AS (SELECT m.*, EXISTS (SELECT 1 FROM old o WHERE o.hash = m.hash AND o.account = m.account) AS known FROM messages m WHERE account IN (SELECT account FROM old)),
    newest AS (SELECT account, max(CASE WHEN known THEN uid END) AS at FROM flagged GROUP BY account),
    due AS (SELECT f.uid, f.hash, f.account FROM flagged f JOIN newest n ON f.account = n.account WHERE n.at IS NULL OR f.uid > n.at UNION ALL SELECT * FROM fresh)
    SELECT hash, account, min(uid) AS uid FROM due GROUP BY hash, account""")
def ingest_pass(spark, sf_dir):
    all_messages = messages(spark, sf_dir).select("uid", "hash", "account", "source")
    return ingest.pending(all_messages.drop("source"), all_messages.where("uid % 37 = 0 and source <> 'src3'")).select("hash", "account", "uid")


@query("WITH a AS (SELECT DISTINCT source FROM documents), old AS (SELECT DISTINCT source FROM documents WHERE doc_id % 41 = 0) SELECT upper(sha256(source)) AS account, source IN (SELECT source FROM old) AS present FROM a")
def account_presence(spark, sf_dir):
    all_messages = messages(spark, sf_dir)
    accounts = all_messages.select("account").distinct()
    present = ingest.has_rows(accounts, all_messages.where("uid % 41 = 0")).withColumn("present", F.lit(True))
    return accounts.join(present, "account", "left").select("account", F.coalesce("present", F.lit(False)).alias("present"))


@query("SELECT source AS folder, max(doc_id) AS uid, arg_max(lang, doc_id) AS subject, arg_max(text, doc_id) AS body FROM documents GROUP BY source")
def folder_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("uid"), F.col("lang").alias("subject"), F.col("text").alias("body"))
    return ingest.latest(docs)


@query("SELECT event_id AS id, props AS content FROM events WHERE event_type <> 'purchase'")
def queue_scan(spark, sf_dir):
    mail = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("content"), (F.col("event_type") == "purchase").alias("operated"))
    return queue.scan(mail, "content")


@query("SELECT event_id AS id, event_type = 'purchase' OR value > 50 AS operated FROM events")
def queue_mark_done(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mail = events.select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("operated"))
    return queue.mark_done(mail, events.select(F.col("event_id").alias("id"), (F.col("value") > 50).alias("operated")))


RETRY = """c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS same_count FROM i)"""


def counted(spark, sf_dir):
    return queue.consecutive(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(f"WITH {RETRY} SELECT event_id, user_id, event_type, CAST(same_count AS INT) AS same_count, same_count >= 3 AS done FROM n")
def retry_counter(spark, sf_dir):
    return counted(spark, sf_dir).select("event_id", "user_id", "event_type", "same_count", (F.col("same_count") >= queue.ENOUGH).alias("done"))


@query(f"WITH {RETRY} SELECT user_id, ts, event_id FROM n WHERE same_count >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def retry_finalised(spark, sf_dir):
    return queue.finalised(counted(spark, sf_dir), "user_id", "ts", "event_id")


@query("""WITH s AS (SELECT conv_id, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE length(text) % 3 = 1 END AS allowed, CASE WHEN length(text) % 11 = 1 THEN 1 ELSE 0 END AS n_contacts FROM conversations)
    SELECT conv_id, count(*) AS n_segments, count(*) FILTER (allowed) AS n_true, count(*) FILTER (NOT allowed) AS n_false, CAST(sum(n_contacts) AS BIGINT) AS n_contacts,
    CASE WHEN sum(n_contacts) > 0 THEN 'relevant' WHEN count(*) FILTER (NOT allowed) = count(*) OR count(*) FILTER (allowed) = count(*) THEN 'irrelevant' ELSE 'unknown' END AS disposition FROM s GROUP BY conv_id""")
def disposition(spark, sf_dir):
    size = F.char_length("text")
    segments = table(spark, sf_dir, "conversations").select("conv_id", F.when(size % 3 != 0, size % 3 == 1).alias("allowed"), F.when(size % 11 == 1, 1).otherwise(0).alias("n_contacts"))
    return queue.votes(segments, "conv_id", "allowed")


@query("SELECT conv_id, string_agg(role || ':' || turn, '; ' ORDER BY turn) AS errors FROM conversations GROUP BY conv_id")
def sync_errors(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return queue.failures(turns.select("conv_id", "turn", F.concat_ws(":", "role", F.col("turn").cast("string")).alias("error")), "conv_id", "error", "turn")


@query("""SELECT o_orderkey, status, error, CASE WHEN o_orderstatus = 'P' THEN TRUE WHEN o_orderkey % 5 = 0 THEN TRUE WHEN status BETWEEN 200 AND 299 THEN TRUE WHEN status = 404 AND error = 'destination_not_found' THEN TRUE ELSE FALSE END AS operated
    FROM (SELECT o_orderkey, o_orderstatus, CAST(CASE o_orderkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 404 ELSE 503 END AS INT) AS status, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'destination_not_found' WHEN 2 THEN 'source_not_found' ELSE 'share_unavailable' END AS error FROM orders)""")
def sent_outcome(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", "x").alias("subject"),
        F.when(F.col("o_orderkey") % 5 != 0, "12-345").alias("number"),
        F.lit(True).alias("found"),
        F.when(k == 0, 200).when(k == 3, 503).otherwise(404).alias("status"),
        F.when(k == 1, "destination_not_found").when(k == 2, "source_not_found").when(k == 3, "share_unavailable").alias("error"),
    )
    return queue.sent_outcome(rows).select("o_orderkey", "status", "error", "operated")


@query(f"WITH {PHONES} SELECT doc_id, pos, raw FROM phones")
def phones_found(spark, sf_dir):
    return phones(spark, sf_dir)


@query(f"SELECT page_id, unnest(regexp_extract_all(html, {PHONE})) AS raw FROM pages")
def phones_in_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(C.phones_in(F.col("html"))).alias("raw"))


@query(f"SELECT doc_id, unnest(generate_series(1, len(e)))::INT AS pos, unnest(e) AS email FROM (SELECT doc_id, regexp_extract_all(text, {EMAIL}) AS e FROM documents)")
def emails_found(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.emails_in(F.col("text"))).alias("pos", "email")).select("doc_id", (F.col("pos") + 1).alias("pos"), "email")


@query(f"""WITH {MESSAGES}, first AS (SELECT min(uid) AS doc_id, any_value(body) AS text FROM messages GROUP BY hash, account),
    l AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1))::INT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM first)),
    p AS (SELECT doc_id, line_no, lower(line) AS label, unnest(regexp_extract_all(line, {PHONE})) AS raw FROM l)
    SELECT doc_id, line_no, raw, {DIGITS} AS digits, CASE WHEN label LIKE '%fax%' THEN 'fax' WHEN label LIKE '%mobil%' OR label LIKE '%handy%' OR label LIKE '%cell%' THEN 'mobile' WHEN label LIKE '%home%' OR label LIKE '%privat%' THEN 'home'
        WHEN regexp_matches(label, 'business|work|office|phone|tel|zentrale|durchwahl|direct') THEN 'business' ELSE 'other' END AS phone_type,
    {DISPLAY} AS display, CASE WHEN raw LIKE '+%' THEN '+' || {DIGITS} WHEN raw LIKE '00%' AND length({DIGITS}) > 2 THEN '+' || substr({DIGITS}, 3) ELSE '' END AS e164
    FROM p WHERE length({DIGITS}) BETWEEN 6 AND 17""")
def phone_canonical(spark, sf_dir):
    """Phones are taken from each body where it is read; only rows of a message with phones, without its body, are shuffled to find first copies."""
    typed = lambda x, i: F.transform(C.phones_in(x), lambda raw: F.struct(i.alias("line_no"), raw.alias("raw"), C.phone_type(x).alias("phone_type")))
    found = F.flatten(F.transform(lines.lines_of(F.col("body")), typed))
    having = messages(spark, sf_dir).select("uid", "hash", "account", found.alias("found")).where(F.size("found") > 0)
    first = ingest.first_of_each(having).select(F.col("uid").alias("doc_id"), F.explode("found").alias("p"))
    raw = F.col("p.raw")
    shown = first.select("doc_id", "p.line_no", "p.raw", C.phone_digits(raw).alias("digits"), "p.phone_type", C.phone_display(raw).alias("display"), C.phone_e164(raw).alias("e164"))
    return shown.where(C.reasonable_digits(F.col("digits")))


@query(f"""WITH {PHONES}, d AS (SELECT doc_id, pos, raw, {DIGITS} AS digits, CASE pos % 4 WHEN 0 THEN 'fax' WHEN 1 THEN 'other' WHEN 2 THEN 'business' ELSE 'mobile' END AS phone_type FROM phones),
    r AS (SELECT *, CASE phone_type WHEN 'fax' THEN 4 WHEN 'mobile' THEN 3 WHEN 'business' THEN 2 ELSE 1 END AS rank FROM d)
    SELECT doc_id, digits, arg_min(raw, pos) AS raw, arg_max(phone_type, rank * 100000 - pos) AS phone_type, min(pos) AS pos FROM r GROUP BY doc_id, digits""")
def phone_dedupe(spark, sf_dir):
    k = F.col("pos") % 4
    typed = phones(spark, sf_dir).withColumn("phone_type", F.when(k == 0, "fax").when(k == 1, "other").when(k == 2, "business").otherwise("mobile"))
    return contacts.dedupe_phones(typed, "doc_id")


@query(f"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN lower(line) LIKE '%fax%' THEN 'fax' WHEN regexp_matches(lower(line), 'mobil|handy|cell') THEN 'mobile' WHEN regexp_matches(lower(line), 'home|privat') THEN 'home'
    WHEN regexp_matches(lower(line), 'business|office|work|phone|tel') THEN 'business' ELSE 'other' END AS phone_type FROM lines""")
def phone_type(spark, sf_dir):
    return text_lines(spark, sf_dir).select("doc_id", "line_no", C.dto_phone_type(F.col("line")).alias("phone_type"))


@query("""SELECT doc_id, digits, CASE WHEN length(digits) >= 12 AND length(digits) % 6 = 0 AND digits = repeat(substr(digits, 1, 6), length(digits) // 6) THEN substr(digits, 1, 6)
    WHEN length(digits) = 14 AND digits = repeat(substr(digits, 1, 7), 2) THEN substr(digits, 1, 7) WHEN length(digits) = 16 AND digits = repeat(substr(digits, 1, 8), 2) THEN substr(digits, 1, 8) ELSE digits END AS collapsed
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN repeat(lpad(CAST(doc_id AS VARCHAR), 6, '7'), 3) WHEN 1 THEN repeat(lpad(CAST(doc_id AS VARCHAR), 8, '3'), 2) ELSE lpad(CAST(doc_id AS VARCHAR), 11, '1') END AS digits FROM documents)""")
def phone_collapse(spark, sf_dir):
    text = F.col("doc_id").cast("string")
    digits = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lpad(text, 6, "7"), 3)).when(F.col("doc_id") % 3 == 1, F.repeat(F.lpad(text, 8, "3"), 2)).otherwise(F.lpad(text, 11, "1"))
    return table(spark, sf_dir, "documents").select("doc_id", digits.alias("digits"), C.collapse_repeats(digits).alias("collapsed"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, lower(replace(replace(replace(replace(replace(replace(replace(text, 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS folded FROM documents")
def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.ascii_fold(F.col("text")).alias("folded"))


@query("SELECT page_id, regexp_replace(split_part(regexp_replace(lower(url), '^https?://', ''), '/', 1), '^www\\.', '') AS host FROM pages")
def website_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.website_host(F.col("url")).alias("host"))


@query(f"""SELECT doc_id, email, split_part(split_part(lower(email), '@', 1), '+', 1) AS local, array_to_string(list_filter(regexp_split_to_array(split_part(split_part(lower(email), '@', 1), '+', 1), '[._-]+'), lambda t: regexp_matches(t, '^[a-zà-ÿ]+$')), ' ') AS tokens
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, {EMAIL})) AS email FROM documents)""")
def email_parts(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.emails_in(F.col("text"))).alias("email"))
    return found.select("doc_id", "email", C.email_local(F.col("email")).alias("local"), F.array_join(C.email_tokens(F.col("email")), " ").alias("tokens"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE regexp_matches(lower(line), '(^|[^a-z0-9_ßà-ÿ])(test[0-9]*|demo|sample|dummy|example)($|[^a-z0-9_ßà-ÿ])')")
def placeholder_flag(spark, sf_dir):
    return text_lines(spark, sf_dir).where(C.is_placeholder(F.col("line"))).select("doc_id", "line_no")


@query(f"""WITH {LINES} SELECT doc_id, line_no FROM (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN 'To: ' || line WHEN 1 THEN 'cc:' || line WHEN 2 THEN line || '; a@b.de' ELSE line END AS line FROM lines) WHERE (regexp_matches(lower(line), '^\\s*(an|to|cc|bcc|kopie|copy|antwort an|reply-to|reply to|von|from):') AND contains(line, '@')) OR (len(regexp_extract_all(line, {EMAIL})) >= 2 AND regexp_matches(line, '[;,]'))""")
def recipient_line(spark, sf_dir):
    k, line = F.col("line_no") % 4, F.col("line")
    headed = text_lines(spark, sf_dir).withColumn("line", F.when(k == 0, F.concat(F.lit("To: "), line)).when(k == 1, F.concat(F.lit("cc:"), line)).when(k == 2, F.concat(line, F.lit("; a@b.de"))).otherwise(line))
    return headed.where(C.is_recipient_line(line)).select("doc_id", "line_no")


BUSINESS_SQL = "regexp_matches(' ' || lower(line) || ' ', '(^|[^a-z0-9])(fax|web|www|ag|ug|kg|e\\.v|str|hrb|ust|str\\.)($|[^a-z0-9])|telefon|telefax|e-mail|email|gmbh|strasse|straße|gesellschaft|sitz|handelsregister|betriebsnummer|amtsgericht')"


#: What a letter might say at the end of a line, in turn; some only look like business.
ENDINGS = ("", " GmbH", " Magazin", ", AG", " Straße", " e.V.", " www.x.de", " Rust")


@query(f"WITH {LINES}, e AS (SELECT doc_id, line_no, line || (CASE line_no % 8 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(ENDINGS)) + f" END) AS line FROM lines) SELECT doc_id, line_no FROM e WHERE {BUSINESS_SQL}")
def business_hint(spark, sf_dir):
    ended = text_lines(spark, sf_dir).withColumn("line", F.concat("line", F.get(F.array(*map(F.lit, ENDINGS)), F.col("line_no") % 8)))
    return ended.where(C.has_business_hint(F.col("line"))).select("doc_id", "line_no")


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_no FROM lines WHERE contains(line, '@')), ends AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id),
    s AS (SELECT m.doc_id, unnest(generate_series(greatest(m.line_no - 2, 0), least(m.line_no + 2, e.last)))::INT AS line_no FROM m JOIN ends e ON m.doc_id = e.doc_id) SELECT DISTINCT doc_id, line_no FROM s""")
def line_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.lines_of(F.col("text")).alias("l"))
    marker = lambda x: F.contains(x, F.lit("@"))
    return lines.scope(docs, "doc_id", "l", marker, marker)


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, {PHONE})), c AS (SELECT doc_id, line_no, line FROM lines WHERE length(line) < 60)
    SELECT t.doc_id, t.line_no, max(c.line_no) AS above_no, arg_max(c.line, c.line_no) AS above FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND c.line_no < t.line_no AND c.line_no >= t.line_no - 10 GROUP BY t.doc_id, t.line_no""")
def nearest_above(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.lines_of(F.col("text")).alias("l"))
    return lines.nearest_above(docs, "doc_id", "l", lambda x: x.rlike(V.PHONE), lambda x: F.char_length(x) < 60).select("doc_id", "line_no", "above_no", "above")


#: Documents carry no headers; every line of a letter that a key begins with becomes one.
AS_HEADERS = "CASE line_no % 5 WHEN 0 THEN 'From: ' || line WHEN 1 THEN 'To: ' || line WHEN 3 THEN 'Subject: ' || line ELSE line END"


@query(f"""WITH {LINES}, h AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN 'from' WHEN 1 THEN 'to' WHEN 3 THEN 'subject' ELSE regexp_extract(lower(line), '^[ ,.;:!?]*(von|from|antwort an|an|to|cc|bcc|kopie|copy|reply-to|reply to|betreff|subject|gesendet|sent|datum|date)[ ,.;:!?]*$', 1) END AS key FROM lines),
    n AS (SELECT a.doc_id, a.line_no, count(*)::INT AS n_headers, count(DISTINCT b.key)::INT AS n_keys, bool_or(b.key IN ('von', 'from')) AS s FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + 7 AND b.key <> '' WHERE a.key <> '' GROUP BY a.doc_id, a.line_no)
    SELECT doc_id, line_no, n_headers, n_keys FROM n WHERE n_headers >= 2 AND n_keys >= 2 AND s""")
def header_cluster(spark, sf_dir):
    head = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("From: "), x)).when(i % 5 == 1, F.concat(F.lit("To: "), x)).when(i % 5 == 3, F.concat(F.lit("Subject: "), x)).otherwise(x)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines.lines_of(F.col("text")), head).alias("l"))
    return lines.header_clusters(docs, "doc_id", "l")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def grounding(spark, sf_dir):
    return occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""WITH n AS (SELECT c_custkey, split_part(c_name, '#', 2) AS display_name, c_nationkey || '.' || CAST(round(c_acctbal / 100) AS INT) || '@x.example' AS email FROM customer),
    s AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS ews_id, split_part(s_name, '#', 2) AS display_name, s_nationkey || '.' || CAST(round(s_acctbal / 100) AS INT) || '@x.example' AS email FROM supplier)
    SELECT n.c_custkey, min(s.ews_id) AS ews_id FROM n LEFT JOIN s ON n.email = s.email OR n.display_name = s.display_name GROUP BY n.c_custkey""")
def contact_lookup(spark, sf_dir):
    mailbox = lambda nation, balance: F.concat(nation.cast("string"), F.lit("."), F.round(balance / 100).cast("int").cast("string"), F.lit("@x.example"))
    new = table(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("display_name"), mailbox(F.col("c_nationkey"), F.col("c_acctbal")).alias("email"))
    stored = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("ews_id"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("display_name"), mailbox(F.col("s_nationkey"), F.col("s_acctbal")).alias("email"))
    return contacts.lookup(new, stored, "c_custkey")


@query("SELECT c_custkey, c_name, CAST(CASE WHEN (SELECT count(*) FROM customer) > 150 THEN 150 END AS INT) AS next_offset FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 50)")
def contact_page(spark, sf_dir):
    return contacts.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query("SELECT c_mktsegment AS account_key, count(*) AS count FROM customer GROUP BY 1")
def contact_count(spark, sf_dir):
    return contacts.listing(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "account_key"))


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_custkey) + (SELECT max(s_suppkey) FROM supplier) AS BIGINT) AS id FROM customer")
def contact_numbering(spark, sf_dir):
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    top = suppliers.agg(F.max("s_suppkey").alias("top"))
    return contacts.numbered(customers.select("c_custkey", "c_name"), "c_custkey", "id").join(F.broadcast(top)).select("c_custkey", "c_name", (F.col("id") + F.col("top")).alias("id"))


#: Phones of a customer made from its key: up to four, typed in turn.
CUSTOMER_PHONES = """p AS (SELECT c_custkey, unnest(generate_series(1, c_custkey % 5)) AS pos FROM customer),
    t AS (SELECT c_custkey, pos, CASE (c_custkey + pos) % 5 WHEN 0 THEN 'business' WHEN 1 THEN 'mobile' WHEN 2 THEN 'home' WHEN 3 THEN 'fax' ELSE 'other' END AS type, '030 ' || (100000 + c_custkey * 7 + pos // 2) AS value FROM p),
    d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY c_custkey, value ORDER BY pos) = 1)"""


def customer_phones(spark, sf_dir):
    key = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("business", "mobile", "home", "fax", "other")))
    made = F.when(key % 5 > 0, F.transform(F.sequence(F.lit(1).cast("long"), key % 5), lambda p: F.struct(F.get(kinds, ((key + p) % 5).cast("int")).alias("type"), F.concat(F.lit("030 "), (100000 + key * 7 + F.floor(p / 2)).cast("string")).alias("raw"), F.lit(None).cast("string").alias("e164")))).otherwise(F.array().cast("array<struct<type:string,raw:string,e164:string>>"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", made.alias("phones"))


@query(f"WITH {CUSTOMER_PHONES} SELECT c.c_custkey, (SELECT arg_min(value, CASE type WHEN 'business' THEN 1 WHEN 'mobile' THEN 2 WHEN 'home' THEN 3 WHEN 'other' THEN 4 ELSE 5 END * 100 + pos) FROM d WHERE d.c_custkey = c.c_custkey) AS phone FROM customer c")
def primary_phone(spark, sf_dir):
    first = contacts.dto_phones(F.col("phones"))
    return customer_phones(spark, sf_dir).select("c_custkey", contacts.primary_phone(F.transform(first, lambda p: F.struct(p["type"].alias("type"), p["value"].alias("raw")))).alias("phone"))


@query(f"""WITH {CUSTOMER_PHONES}, f AS (SELECT c_custkey, arg_min(value, pos) FILTER (type = 'business') AS b, min(pos) FILTER (type = 'business') AS bp, arg_min(value, pos) AS any1, min(pos) AS p1, arg_min(value, pos) FILTER (type = 'mobile') AS m, min(pos) FILTER (type = 'mobile') AS mp,
        arg_min(value, pos) FILTER (type = 'home') AS h, min(pos) FILTER (type = 'home') AS hp, arg_min(value, pos) FILTER (type = 'fax') AS x, min(pos) FILTER (type = 'fax') AS xp FROM d GROUP BY c_custkey),
    r AS (SELECT d.c_custkey, d.value, row_number() OVER (PARTITION BY d.c_custkey ORDER BY d.pos) AS k FROM d JOIN f USING (c_custkey) WHERE d.pos <> coalesce(f.bp, f.p1) AND d.pos IS DISTINCT FROM f.mp AND d.pos IS DISTINCT FROM f.hp AND d.pos IS DISTINCT FROM f.xp)
    SELECT c.c_custkey, coalesce(f.b, f.any1) AS business, f.m AS mobile, f.h AS home, f.x AS fax, (SELECT max(value) FROM r WHERE r.c_custkey = c.c_custkey AND k = 1) AS company_main FROM customer c LEFT JOIN f ON c.c_custkey = f.c_custkey""")
def phone_slots(spark, sf_dir):
    slots = customer_phones(spark, sf_dir).select("c_custkey", contacts.phone_slots(contacts.dto_phones(F.col("phones"))).alias("s"))
    return slots.select("c_custkey", "s.business", "s.mobile", "s.home", "s.fax", F.col("s.more")["CompanyMainPhone"].alias("company_main"))


def envelopes(spark, sf_dir):
    rows = customer_phones(spark, sf_dir).select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("Ann  Lee "), F.col("c_custkey").cast("string"))).alias("full_name"),
        F.when(F.col("c_custkey") % 2 > 0, F.col("c_name")).alias("display_name_fallback"),
        F.lit("Acme").alias("company"),
        F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit("@x.example ")).alias("email"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("website"),
        F.lit("").alias("notes"),
        contacts.phone_items(contacts.dedupe_phone_array(F.col("phones"))).alias("phones"),
    )
    return contacts.payload(rows)


@query(f"""WITH {CUSTOMER_PHONES}, n AS (SELECT c_custkey, count(*) AS n FROM d GROUP BY c_custkey)
    SELECT c.c_custkey AS id, CASE WHEN n IS NULL THEN 'contact.phone is required for canonical payload' END AS error, CASE WHEN n IS NOT NULL THEN CASE WHEN c.c_custkey % 7 > 0 THEN 'Ann  Lee ' || c.c_custkey WHEN c.c_custkey % 2 > 0 THEN c_name ELSE '' END END AS full_name,
    CASE WHEN n IS NOT NULL THEN CASE WHEN c.c_custkey % 7 > 0 THEN 'Ann Lee' ELSE '' END END AS given_name, CASE WHEN n IS NOT NULL THEN CASE WHEN c.c_custkey % 7 > 0 THEN CAST(c.c_custkey AS VARCHAR) ELSE '' END END AS surname,
    CASE WHEN n IS NOT NULL THEN 'c' || c.c_custkey || '@x.example' END AS email, CASE WHEN n IS NOT NULL THEN '+49 30' || substr(CAST(100000 + c.c_custkey * 7 AS VARCHAR), 1, 1) || ' ' || substr(CAST(100000 + c.c_custkey * 7 AS VARCHAR), 2) END AS first_raw,
    CASE WHEN n IS NOT NULL THEN '+4930' || (100000 + c.c_custkey * 7) END AS first_e164, CAST(n AS INT) AS n_phones FROM customer c LEFT JOIN n ON c.c_custkey = n.c_custkey""")
def canonical_payload(spark, sf_dir):
    e = F.col("envelope")["contact"]
    return envelopes(spark, sf_dir).select("id", "error", *(e[c].alias(c) for c in ("full_name", "given_name", "surname", "email")), F.get(e["phones"], 0)["raw"].alias("first_raw"), F.get(e["phones"], 0)["e164"].alias("first_e164"), F.when(F.col("envelope").isNotNull(), F.size(e["phones"])).alias("n_phones"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Payload is required.' WHEN c_custkey % 11 = 0 THEN 'Unsupported schema_version ''0.9''. Expected ''1.0''.' WHEN c_custkey % 14 = 0 THEN 'contact.full_name or (contact.given_name + contact.surname) is required.' WHEN c_custkey % 13 = 0 THEN 'contact.phones must contain at least one number.' END AS problem
    FROM customer""")
def validate(spark, sf_dir):
    key, e = F.col("id"), F.col("envelope")
    broken = e.withField("schema_version", F.when(key % 11 == 0, F.lit("0.9")).otherwise(F.lit(V.SCHEMA_VERSION))).withField("contact.phones", F.when(key % 13 == 0, F.array().cast("array<struct<type:string,raw:string,e164:string>>")).otherwise(e["contact"]["phones"]))
    return envelopes(spark, sf_dir).select("id", contacts.validate(F.when(e.isNotNull(), broken)).alias("problem"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN 'Ann  Lee ' || c_custkey WHEN c_custkey % 2 > 0 THEN c_name ELSE 'c' || c_custkey || '@x.example' END AS display_name, 'source_message_id=' || c_custkey AS notes, 'c' || c_custkey || '@x.example' AS email FROM customer WHERE c_custkey % 5 > 0")
def contact_record(spark, sf_dir):
    return contacts.contact_dto(envelopes(spark, sf_dir).where("envelope is not null")).select("id", "dto.display_name", "dto.notes", "dto.email")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, json_keys(props)[1] AS first_key FROM events")
def json_fields(spark, sf_dir):
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.expr("get_json_object(props, concat('$.', get(json_object_keys(props), 0)))").alias("first_value"), key.alias("first_key"))


@query("SELECT o_orderkey, substr(s, 1, 2) || '-' || substr(s, 4, 3) AS number FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS s FROM orders)")
def project_number(spark, sf_dir):
    key = F.col("o_orderkey")
    subject = F.concat(F.lit(" "), F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.when(key % 2 == 0, " ").otherwise("-"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" Order"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.project_number(subject).alias("number"))


@query("""WITH wanted AS (SELECT DISTINCT lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 7 * 111 AS VARCHAR), 3, '0') AS number FROM orders),
    top AS (SELECT s_suppkey, '/' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0') || '-' || lpad(CAST(s_suppkey % 7 * 111 AS VARCHAR), 3, '0') || '-' || s_suppkey AS d1 FROM supplier)
    SELECT w.number, (SELECT min_by(d1 || '/01_Dokumente/Test Docs ' || s_suppkey % 3, d1) FROM top WHERE d1 LIKE '/' || w.number || '%' AND s_suppkey % 4 > 0) AS path FROM wanted w""")
def path_resolve(spark, sf_dir):
    two, three = lambda k: F.lpad((k % 40).cast("string"), 2, "0"), lambda k: F.lpad((k % 7 * 111).cast("string"), 3, "0")
    numbers = table(spark, sf_dir, "orders").select(F.concat(two(F.col("o_orderkey")), F.lit("-"), three(F.col("o_orderkey"))).alias("number"))
    key = F.col("s_suppkey")
    top = F.concat(two(key), F.lit("-"), three(key), F.lit("-"), key.cast("string"))
    last = F.concat(F.lit("Test Docs "), (key % 3).cast("string"))
    folders = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(
        F.struct(F.concat(F.lit("/"), top).alias("path"), F.lit(1).alias("depth"), top.alias("name")),
        F.struct(F.concat(F.lit("/"), top, F.lit("/01_Dokumente")).alias("path"), F.lit(2).alias("depth"), F.lit("01_Dokumente").alias("name")),
        F.struct(F.concat(F.lit("/"), top, F.lit("/01_Dokumente/"), last).alias("path"), F.lit(3).alias("depth"), last.alias("name")),
    )).alias("f")).where("f.depth < 3 or s_suppkey % 4 > 0").select("f.path", "f.depth", "f.name")
    return filing.resolve(numbers, folders, "Dokumente", "test docs")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'ShareUnavailable' WHEN o_orderkey % 7 = 0 THEN 'SourceNotFound' WHEN o_orderkey % 5 = 0 THEN 'DestinationNotFound' WHEN o_orderkey % 3 = 0 THEN 'InvalidTargetFileName' WHEN o_orderstatus = 'P' THEN 'CopyFailed' ELSE 'Success' END AS status,
    CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN '/share/' || o_orderpriority || '/n' || o_orderkey || '.eml' END AS destination FROM orders""")
def store_status(spark, sf_dir):
    key = F.col("o_orderkey")
    folder = F.when(key % 5 > 0, F.concat(F.lit("/share/"), F.col("o_orderpriority")))
    name = F.when(key % 3 > 0, F.concat(F.lit(" n"), key.cast("string"))).otherwise(F.lit("../x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", filing.store_status(key % 11 > 0, key % 7 > 0, folder, name, F.col("o_orderstatus") != "P").alias("status"), filing.destination(folder, name).alias("destination"))


#: The pages' own mark-up: a page leaves paragraphs open, which end where the article does.
@query(r"""WITH s AS (SELECT page_id, regexp_replace(html, '<style>[^<]*</style>|<script>.*?</script>|<!--.*?-->', ' ', 'gs') AS t FROM pages),
    a AS (SELECT page_id, replace(t, '</article>', repeat(' ' || chr(10) || ' ', 1 + len(regexp_extract_all(t, '<p>')) - len(regexp_extract_all(t, '</p>')))) AS t FROM s),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br>|</(div|footer|h1|li|nav|p|ul)>', ' ' || chr(10) || ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(t, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), chr(160), ' ') AS t FROM b),
    d AS (SELECT page_id, string_split(regexp_replace(regexp_replace(t, '[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), chr(10)) AS l FROM c)
    SELECT page_id, trim(array_to_string(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x = '' OR trim(x, '<>"'' ' || chr(9)) <> ''), chr(10)), ' ' || chr(10)) AS text FROM d""")
def html_text(spark, sf_dir):
    return texts.html_text(table(spark, sf_dir, "pages"), "page_id", "html")


def letters(spark, sf_dir):
    """The turns of conversations as threads: each later message quotes the ones before under a reply line, and ends in a signature."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(
        F.transform("t", lambda x, i: F.concat(F.when(i > 0, F.lit("On Monday someone wrote:\n")).otherwise(F.lit("Hallo zusamen,\n")), x["text"], F.lit("\nBest regards\nAnn Miller\nTelefon: +49 30 "), (100000 + F.col("conv_id") * 13 + i).cast("string"), F.lit("\nE-Mail: ann.miller@north.invalid"))),
        "\n",
    )
    return turns.select("conv_id", body.alias("body"))


#: The messages of these threads, newest first, as they were put together: what an engine has to find again.
TURNS = """turns AS (SELECT conv_id, i, text, 'Telefon: +49 30 ' || (100000 + conv_id * 13 + i) || chr(10) || 'E-Mail: ann.miller@north.invalid' AS ending
    FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations))"""
SIGNED = "chr(10) || 'Best regards' || chr(10) || 'Ann Miller' || chr(10)"


@query(f"WITH {TURNS} SELECT conv_id, CAST(i AS INT) AS part_no, CASE WHEN i = 0 THEN 'Hallo zusamen,' || chr(10) ELSE '' END || ltrim(text, ' ' || chr(10)) || {SIGNED} || ending AS part FROM turns")
def thread_parts(spark, sf_dir):
    return texts.thread_parts(letters(spark, sf_dir), "conv_id", "body")


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, i, ending, trim(text, ' ' || chr(10)) AS body FROM turns)
    SELECT conv_id, CAST(2 * i AS INT) AS segment_no, 'context' AS query_type, body AS segment, body || chr(10) || {SIGNED} || ending AS source FROM s
    UNION ALL SELECT conv_id, CAST(2 * i + 1 AS INT), 'signature', ending, body || chr(10) || {SIGNED} || ending FROM s""")
def segments(spark, sf_dir):
    return texts.segments(letters(spark, sf_dir), "conv_id", "body")


@query("SELECT DISTINCT conv_id, CAST(0 AS INT) AS line_no, CAST(100 AS DOUBLE) AS score FROM conversations")
def fuzzy_greeting(spark, sf_dir):
    return texts.greeting_lines(lines.numbered(letters(spark, sf_dir), "conv_id", "body"), "conv_id")


#: A thread's signatures name one person; the source is the shortest block: eight lines above a number, back to a blank line or the end of the message before.
@query(f"""WITH {TURNS}, blocks AS (SELECT conv_id, i, ending, list_transform(string_split(CASE WHEN i = 0 THEN 'Hallo zusamen,' || chr(10) ELSE '' END || text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS l FROM turns),
    cut AS (SELECT conv_id, i, ending, list_slice(l, greatest(len(l) - 5, 1), len(l)) AS l FROM blocks),
    near AS (SELECT conv_id, i, ending, CASE WHEN list_contains(l, '') THEN list_slice(l, len(l) - list_position(list_reverse(l), '') + 2, len(l)) ELSE l END AS l FROM cut),
    sources AS (SELECT conv_id, i, array_to_string(list_concat(l, ['Best regards', 'Ann Miller']), chr(10)) || chr(10) || ending AS source_text FROM near)
    SELECT conv_id, CAST(0 AS INT) AS contact_no, 'Ann Miller' AS full_name, '+49 30 ' || (100000 + conv_id * 13) AS phone, 'ann.miller@north.invalid' AS email, arg_min(source_text, length(source_text) * 1000 + i) AS source_text FROM sources GROUP BY conv_id""")
def signature_contacts(spark, sf_dir):
    return texts.signature_contacts(letters(spark, sf_dir), "conv_id", "body").select("conv_id", "contact_no", "contact.full_name", "contact.phone", "contact.email", "contact.source_text")


def contact_lists(spark, sf_dir):
    """All customers, dealt into lists of contacts in a message: 997 lists, or more so that a list has about three, since rules read a list once for each contact."""
    customers = table(spark, sf_dir, "customer")
    lists = max(997, -(-customers.count() // 3))
    line = F.concat(F.lit("Org "), F.col("c_mktsegment"), F.lit(" - Ann Miller; +49 30 "), (1000000 + F.col("c_custkey")).cast("string"), F.lit("; ann"), F.col("c_custkey").cast("string"), F.lit("@north.invalid\nMobil: +49 171 "), (2000000 + F.col("c_custkey")).cast("string"))
    held = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line"))))
    return customers.groupBy((F.col("c_custkey") % lists).alias("list_id")).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("body"))


LISTS = """c AS (SELECT *, c_custkey % lists AS list_id, row_number() OVER (PARTITION BY c_custkey % lists ORDER BY c_custkey) - 1 AS no, count(*) OVER (PARTITION BY c_custkey % lists) AS held
    FROM customer, (SELECT greatest(997, CAST(ceil(count(*) / 3) AS BIGINT)) AS lists FROM customer))"""


@query(f"WITH {LISTS} SELECT list_id, CAST(no AS INT) AS contact_no, 'Ann Miller' AS full_name, 'Org ' || c_mktsegment AS company, '+49 30 ' || (1000000 + c_custkey) AS phone, 'ann' || c_custkey || '@north.invalid' AS email, CAST(2 AS INT) AS n_phones FROM c")
def structured_contacts(spark, sf_dir):
    found = texts.structured_contacts(contact_lists(spark, sf_dir), "list_id", "body")
    return found.select("list_id", "contact_no", "contact.full_name", "contact.company", "contact.phone", "contact.email", F.size("contact.phone_numbers").alias("n_phones"))


@query("SELECT conv_id, 'relevant' AS disposition, 'Ann Miller' AS full_name, '+49 30 ' || (100000 + conv_id * 13) AS phone, 'ann.miller@north.invalid' AS email FROM conversations GROUP BY conv_id")
def normalize_contacts(spark, sf_dir):
    decided = texts.decide(letters(spark, sf_dir), "conv_id", "body")
    return decided.select("conv_id", "disposition", F.explode_outer("contacts").alias("c")).select("conv_id", "disposition", "c.full_name", "c.phone", "c.email")


#: In a list that an automobile firm heads, the firm's name labels its line as a mobile number's, so that the list's signature goes to its first contact and brings the numbers of all.
@query(f"WITH {LISTS} SELECT list_id, CAST(no AS INT) AS contact_no, 'Ann Miller' AS full_name, '+49 30 ' || (1000000 + c_custkey) AS phone, 'ann' || c_custkey || '@north.invalid' AS email, CAST(CASE WHEN no = 0 AND c_mktsegment = 'AUTOMOBILE' THEN 1 + 2 * held ELSE 2 END AS INT) AS n_phones FROM c")
def fold_dedupe(spark, sf_dir):
    found = texts.structured_contacts(contact_lists(spark, sf_dir), "list_id", "body").unionByName(texts.signature_contacts(contact_lists(spark, sf_dir), "list_id", "body").withColumn("contact_no", F.col("contact_no") + 1_000_000))
    arrays = found.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("contact_no", "contact"))).alias("a")).select("list_id", F.transform("a", lambda x: x["contact"]).alias("contacts"))
    return texts.merged(arrays, "list_id").select("list_id", F.posexplode("contacts").alias("contact_no", "c")).select("list_id", "contact_no", "c.full_name", "c.phone", "c.email", F.size("c.phone_numbers").alias("n_phones"))


def responses(spark, sf_dir):
    """Events' properties as a classifier might answer: fenced, in Python's words, with a trailing comma, within prose, or not at all."""
    k = F.col("event_id") % 5
    body = F.regexp_replace("props", "\\}$", ', "is_allowed": true}')
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.replace(body, F.lit("true"), F.lit("True"))).when(k == 2, F.regexp_replace(body, "\\}$", ",}")).when(k == 3, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).otherwise(F.lit("no object"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN TRUE END AS allowed, CASE WHEN event_id % 5 < 4 THEN json_extract_string(props, '$.' || json_keys(props)[1]) END AS first_value FROM events""")
def lenient_json(spark, sf_dir):
    loaded = texts.parsed(responses(spark, sf_dir), "event_id", "raw")
    return loaded.select("event_id", "allowed", F.expr("get_json_object(answer, concat('$.', get(json_object_keys(answer), 0)))").alias("first_value"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Offer ' || event_id WHEN 2 THEN repeat('x', 60) ELSE 'short' END AS file_name FROM events""")
def target_file_name(spark, sf_dir):
    k = F.col("event_id") % 4
    name = F.when(k == 1, F.concat(F.lit("Offer "), F.col("event_id").cast("string"))).otherwise(F.repeat(F.lit("x"), 70))
    raw = F.when(k == 0, F.lit("none")).otherwise(F.concat(F.lit('ok {"target_file_name": "'), name, F.lit('"} done')))
    return table(spark, sf_dir, "events").select("event_id", filing.file_name(raw, F.when(k == 3, F.lit("short"))).alias("file_name"))


@query("SELECT conv_id AS id, 'Ann Miller' AS display_name, '+49 30' || substr(CAST(100000 + conv_id * 13 AS VARCHAR), 1, 1) || ' ' || substr(CAST(100000 + conv_id * 13 AS VARCHAR), 2) AS business_phone, 'ann.miller@north.invalid' AS email, CAST(count(*) AS INT) AS n_phones FROM conversations GROUP BY conv_id")
def contact_payloads(spark, sf_dir):
    """From messages to payloads and stored records: the whole path of one mail."""
    rows = texts.payload_rows(texts.decide(letters(spark, sf_dir), "conv_id", "body"), "conv_id")
    stored = contacts.contact_dto(contacts.payload(rows).withColumn("problem", contacts.validate(F.col("envelope"))).where("problem is null"))
    return stored.select("id", "dto.display_name", "dto.business_phone", "dto.email", F.size("envelope.contact.phones").alias("n_phones"))


def streamed(spark, sf_dir, name: str) -> DataFrame:
    """A table as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, since a stream takes no single file


@query(f"WITH {RETRY}, e AS (SELECT user_id, min(ts) AS at_ts, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS at_id FROM n WHERE same_count >= 3 GROUP BY user_id) SELECT n.user_id AS id, CAST(epoch_us(n.ts) * 1000 + n.event_id % 1000 AS BIGINT) AS seq, n.same_count, n.same_count >= 3 AS done FROM n LEFT JOIN e ON n.user_id = e.user_id WHERE e.at_ts IS NULL OR n.ts < e.at_ts OR (n.ts = e.at_ts AND n.event_id <= e.at_id)")
def stream_retry(spark, sf_dir):
    seq = F.unix_micros(F.col("ts").cast("timestamp"))
    results = streamed(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (seq * 1000 + F.col("event_id") % 1000).alias("seq"), F.col("event_type").alias("signature"))
    return mail.run_through(mail.retry_counts(results), "retry")


@query(f"WITH {MESSAGES} SELECT DISTINCT hash, account FROM messages")
def stream_dedup(spark, sf_dir):
    found = ingest.with_hash(streamed(spark, sf_dir, "documents").select(F.col("text").alias("body"), "source"), account="source")
    return mail.run_through(mail.first_copies(found.select("hash", "account")), "dedup")
