"""Sources, sinks and streams."""

import json
import os
import random
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from lettermill.operators import contacts, filing, ingest, queue
from lettermill.operators import messages as texts
from lettermill.sources import settings, sinks
from lettermill.sources.mailbox import MailboxSource
from lettermill.streaming import mail


def put(top, account, folder, uid, subject, body):
    m = EmailMessage()
    m["Subject"] = subject
    m.set_content(body)
    path = top / account / folder
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{uid}.eml").write_bytes(m.as_bytes())


def test_mailbox_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(MailboxSource)
    box = tmp_path / "box"
    for uid in (1, 2, 10):
        put(box, "ann", "INBOX", uid, f"s{uid}", f"body {uid}")
    put(box, "ann", "Sent", 5, "12 345 Plan", "x")
    put(box, "bob", "INBOX", 3, "s3", "body 1")
    df = spark.read.format("mailbox").option("path", str(box)).load()
    assert df.count() == 5
    assert {(r["folder"], r["uid"]) for r in ingest.latest(df.where("account_key = 'ann'")).collect()} == {("INBOX", 10), ("Sent", 5)}
    assert ingest.message(df.where("folder = 'Sent'"), 5).first()["subject"] == "12 345 Plan"
    with pytest.raises(Exception, match="no message 6"):
        ingest.message(df, 6).collect()
    assert [r[0] for r in ingest.uids(df.where("folder = 'INBOX' and account_key = 'ann'")).collect()] == [1, 2, 10]
    assert ingest.newest_uid(df.limit(0)).first()[0] is None

    table, check = str(tmp_path / "table"), str(tmp_path / "check")

    def run():
        stream = ingest.with_hash(spark.readStream.format("mailbox").option("path", str(box)).option("folders", "INBOX").load())
        mail.ingest_stream(stream, table, check, {"processingTime": "0 seconds"})
        q = mail.ingest_stream(stream, table, check, {"processingTime": "0 seconds"}).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["account_key"], r["uid"]) for r in spark.read.parquet(table).collect())

    assert run() == [("ann", 1), ("ann", 2), ("ann", 10), ("bob", 3)]
    put(box, "ann", "INBOX", 11, "again", "body 2")
    put(box, "ann", "INBOX", 12, "new", "body 12")
    assert run() == [("ann", 1), ("ann", 2), ("ann", 10), ("ann", 12), ("bob", 3)]


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("seq"), F.col("event_type").alias("signature"))
    events.repartition(1).sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    stream = mail.retry_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    counted = queue.consecutive(events, "id", "signature", "seq")
    first = queue.finalised(counted, "id", "seq").withColumnRenamed("seq", "end")
    want = counted.join(first, "id", "left").where("end is null or seq <= end").select("id", "seq", "same_count", (F.col("same_count") >= 3).alias("done"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_stream_first_copies(spark, tmp_path):
    docs = ingest.with_hash(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("uid"), F.col("text").alias("body"), "source"), account="source")
    docs.write.parquet(str(tmp_path / "in"))
    q = mail.first_copies(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("copies").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("copies").select("hash", "account")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ingest.first_of_each(docs).select("hash", "account").collect()))


def test_act_on_queue(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = mail.act_on_queue(stream, lambda b, e: b.withColumn("operated", F.col("id") % 2 == 0), str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("operated").count() == 3


def test_settings(tmp_path):
    env = {"IMAP__A__HOST": "h", "IMAP__A__PORT": "993", "IMAP__A__USER": "u", "IMAP__A__PASSWORD": "p"}
    assert settings.mailbox_settings("a", env=env) == settings.MailboxSettings("h", 993, "u", "p")
    for broken in (env | {"IMAP__A__PORT": "0"}, env | {"IMAP__A__PORT": "x"}, env | {"IMAP__A__USER": ""}, {}):
        with pytest.raises(settings.SettingsError):
            settings.mailbox_settings("a", env=broken)
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"Accounts": {"B": {"Host": "h2", "User": "u2", "Password": "p2"}}, "SavePath": str(tmp_path)}))
    assert settings.mailbox_settings("b", str(file), {}).port == 993
    assert settings.save_path(str(file), {}) == str(tmp_path) and settings.save_path(str(file), {"MAIL_SAVE_DIR": "/x"}) == "/x"
    with pytest.raises(settings.SettingsError):
        settings.save_path(None, {})
    ews = {"EWS__A__SERVICE_URL": "s", "EWS__A__MAILBOX": "m", "EWS__A__OAUTH_ACCESS_TOKEN": "t"}
    assert settings.contact_settings("a", ews).token == "t"
    basic = settings.contact_settings("a", ews | {"EWS__A__AUTH_MODE": "BASIC", "EWS__A__PASSWORD": "p"})
    assert (basic.user, basic.password) == ("m", "p") and "p'" not in repr(basic)
    for broken in ({}, ews | {"EWS__A__AUTH_MODE": "x"}, {k: v for k, v in ews.items() if "TOKEN" not in k}):
        with pytest.raises(settings.SettingsError):
            settings.contact_settings("a", broken)
    assert [settings.first_run_limit({"INITIAL_SYNC_LIMIT": v}) for v in ("5", "0", "-1", "x")] == [5, 10, 10, 10]


def test_export_and_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "H", b"Subject: 12 345 x\n\nbody"), (2, "H", b"no header")], "uid long, hash string, content binary")
    for _ in range(2):
        out = sinks.export_messages(rows, str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out")) == sorted(sinks.eml_name(u, "H") for u in (1, 2)) and all(r["error"] is None for r in out)
    files = spark.read.format("binaryFile").load(str(tmp_path / "out"))
    assert {r["subject"] for r in texts.mime_files(files).collect()} == {"12 345 x", None}
    source = next(r["path"] for r in out if r["uid"] == 1)
    (tmp_path / "target").mkdir()
    wanted = spark.createDataFrame([(source, str(tmp_path / "target"), " a "), (source, str(tmp_path / "target"), "../a"), ("/none", "/x", "a"), (source, None, "a"), (source, "/no/such", "b")], "source_path string, folder string, target_file_name string").coalesce(1)
    got = sinks.store(wanted, wait=lambda s: None).collect()
    assert [r["status"] for r in got] == ["Success", "InvalidTargetFileName", "SourceNotFound", "DestinationNotFound", "CopyFailed"]
    assert os.listdir(tmp_path / "target") == ["a.eml"]
    down = sinks.store(wanted.limit(1), mounted=lambda: False, wait=lambda s: None).first()
    assert down["status"] == "ShareUnavailable"
    tries = []
    assert not sinks.copy_with_retries("a", "b", lambda a, b: tries.append(1) or False, lambda s: tries.append(s)) and tries.count(1) == 6 and tries.count(5.0) == 5


def test_post(spark):
    def client(url, body, key):
        if "bad" in body:
            raise sinks.HttpError(404, "destination_not_found")
        return "" if "empty" in body else json.dumps({"url": url, "key": key})

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "empty")], "id long, body string").coalesce(1)
    got = sinks.post(rows, "id", "body", "http://x", "k", client).collect()
    assert [(r["id"], r["status"], r["error"]) for r in got] == [(1, 200, None), (2, 404, "destination_not_found"), (3, 200, None)]
    with pytest.raises(sinks.HttpError):
        sinks.http_post("http://127.0.0.1:9", "{}", timeout=2)


class Store:
    def __init__(self, known=None, record=None, delete=None):
        self.known, self.fail_record, self.fail_delete = known, record, delete

    def find(self, contact):
        return self.known

    def save(self, contact):
        return "r1"

    def record(self, contact, remote_id):
        if self.fail_record:
            raise RuntimeError(self.fail_record)
        return 1

    def delete(self, remote_id):
        if self.fail_delete:
            raise RuntimeError(self.fail_delete)


def test_compensation(spark):
    assert sinks.create_contact(Store(), {}) == ("created", "r1", None)
    assert sinks.create_contact(Store(known="r0"), {}) == ("exists", "r0", None)
    assert sinks.create_contact(Store(record="full"), {}) == ("rolled_back", None, "full")
    assert sinks.create_contact(Store(record="full", delete="gone"), {}) == ("rollback_failed", "r1", "full; gone")
    rows = spark.createDataFrame([(1, ("x",))], "id long, dto struct<email:string>")

    def open_store():
        class Kept:
            find = staticmethod(lambda contact: None)
            save = staticmethod(lambda contact: "r" + contact["email"])
            record = staticmethod(lambda contact, remote_id: 1)

        return Kept()

    assert tuple(sinks.create_contacts(rows, "id", open_store).first()) == (1, "created", "rx", None)


def test_slots_and_records(spark):
    phones = [("business", "030 1", None), ("business", "030 2", None), ("home", "040 1", None), ("Home", "040 2", None), ("Mobil", "0170 1", None), ("telefax", "030 9", None), ("x", "0301", None), ("x", "0800 1", None), ("x", " ", "+49 1")]
    df = spark.createDataFrame([(phones,)], "phones array<struct<type:string,raw:string,e164:string>>")
    s = df.select(contacts.phone_slots(contacts.dto_phones(F.col("phones"))).alias("s")).first()["s"]
    assert (s["business"], s["mobile"], s["home"], s["fax"]) == ("030 1", "0170 1", "040 1", "030 9")
    assert s["more"] == {"BusinessPhone2": "030 2", "HomePhone2": "040 2", "CompanyMainPhone": "0800 1", "OtherTelephone": "+49 1"}
    only = spark.createDataFrame([([("fax", "1 2", None)],), ([],), (None,)], df.schema).select(contacts.phone_slots(contacts.dto_phones(F.col("phones"))).alias("s")).collect()
    assert [(r["s"]["business"], r["s"]["fax"]) for r in only] == [("1 2", "1 2"), (None, None), (None, None)]


def test_lookup_and_insert(spark):
    stored = spark.createDataFrame([(1, "e1", "a@x", "Ann"), (2, "e0", "b@x", "Bob")], "id long, ews_id string, email string, display_name string")
    new = spark.createDataFrame([(1, "a@x", "Other"), (2, None, "Bob"), (3, None, None), (4, "c@x", "Cy"), (5, "a@x", "Bob")], "k long, email string, display_name string")
    assert {r["k"]: r["ews_id"] for r in contacts.lookup(new, stored, "k").collect()} == {1: "e1", 2: "e0", 3: None, 4: None, 5: "e0"}
    assert sorted((r["k"], r["id"]) for r in contacts.insert_rows(new, stored, "k").collect()) == [(3, 3), (4, 4)]


def test_insert_sees_the_new_rows_before(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *(f"{j}@x" for j in range(40))]), rng.choice([None, *(f"N{j}" for j in range(40))])) for k in range(120)]
    rows += [(1000 + k, "hot@x", f"H{k}") for k in range(50)]
    taken, want = set(), []
    for k, email, name in rows:
        mine = {v for v in (email, name) if v is not None}
        if not mine & taken:
            taken |= mine
            want.append(k)
    new = spark.createDataFrame(rows, "k long, email string, display_name string")
    stored = spark.createDataFrame([], "id long, ews_id string, email string, display_name string")
    got = sorted((r["id"], r["k"]) for r in contacts.insert_rows(new, stored, "k").collect())
    assert got == list(enumerate(want, 1))
    assert contacts.insert_rows(new.limit(0), stored, "k").count() == 0


def test_pages(spark):
    rows = spark.range(250)
    sizes = [(contacts.page(rows, "id", o, 100).count(), contacts.page(rows, "id", o, 100).first()["next_offset"]) for o in (0, 100, 200)]
    assert sizes == [(100, 100), (100, 200), (50, None)]
    assert [contacts.page_size(n) for n in (None, 0, 501, 500, 1)] == [100, 100, 100, 500, 1]


def test_next_state(spark):
    df = spark.createDataFrame([(1, False, 2, "s"), (2, False, 2, "s"), (3, False, 0, None), (4, False, 1, "s")], "id long, operated boolean, same_result_count int, last_result_signature string")
    got = queue.next_state(df, spark.createDataFrame([(1, "s"), (2, "t"), (3, "t")], "id long, signature string"))
    assert sorted(map(tuple, got.collect())) == [(1, True, 3, "s"), (2, False, 1, "t"), (3, False, 1, "t"), (4, False, 1, "s")]


def test_sent_folder(spark):
    df = spark.createDataFrame([("INBOX", "INBOX", 1), ("Gesendete Elemente", "Top/Gesendete Elemente", 2), ("x", "x.Gesendete Elemente", 3)], "name string, full_name string, pos int")
    assert ingest.sent_folder(df).first()["full_name"] == "Top/Gesendete Elemente"
    with pytest.raises(Exception, match="no folder"):
        ingest.sent_folder(df.where("pos = 1")).collect()


def test_resolve(spark):
    paths = ["/12-345-Akte", "/12-345-Akte/01_Dokumente", "/12-345-Akte/01_Dokumente/TestDocs & Attachments", "/12-345", "/12-345/other", "/99-999-x"]
    df = spark.createDataFrame([(p, p.count("/"), p.rpartition("/")[2]) for p in paths], "path string, depth int, name string")
    got = filing.resolve(spark.createDataFrame([("12-345",), ("99-999",), ("11-111",)], "number string"), df, "Dokumente", "TestDocs")
    assert {r["number"]: r["path"] for r in got.collect()} == {"12-345": "/12-345-Akte/01_Dokumente/TestDocs & Attachments", "99-999": None, "11-111": None}


def test_decisions(spark):
    def answer(said):
        return lambda pairs: [said] * len(pairs)

    df = spark.createDataFrame([(1, "Bitte melden.\nEva Lang\nTel. 0228 123456\nNord"), (2, None)], "id long, mail string")
    rows = {r["id"]: r for r in texts.decide(df, "id", "mail").collect()}
    assert rows[1]["disposition"] == "relevant" and rows[1]["contacts"][0]["full_name"] == "Eva Lang" and rows[2]["disposition"] == "unknown"
    plain = spark.createDataFrame([(1, "Nur Text ohne alles")], "id long, mail string")
    said = {name: texts.decide(plain, "id", "mail", answer(a)).first()["disposition"] for name, a in (("no", '{"is_allowed": false}'), ("yes", '{"is_allowed": true}'), ("noise", "what?"))}
    assert said == {"no": "irrelevant", "yes": "irrelevant", "noise": "unknown"}
    shown = json.loads(texts.public(texts.decide(df, "id", "mail"), "id").where("id = 1").first()["result"])
    assert shown["full_name"] == "Eva Lang" and "source_text" not in shown
    asked = df.select(texts.prompt(F.lit("context"), F.col("mail")).alias("p")).first()["p"]
    assert "Eva Lang" in asked and "context" in asked
    with pytest.raises(Exception, match="unknown query type"):
        df.select(texts.prompt(F.lit("other"), F.col("mail"))).collect()


def test_effects_happen_once_however_often_outcomes_are_read(spark, tmp_path):
    log = str(tmp_path / "log")

    def client(url, body, key):
        with open(log, "a") as f:
            f.write("x")
        return "{}"

    out = sinks.post(spark.createDataFrame([(1, "{}"), (2, "{}")], "id long, body string").coalesce(1), "id", "body", "http://x", "k", client)
    assert out.count() == 2 and out.count() == 2 and len(out.collect()) == 2
    with open(log) as f:
        assert f.read() == "xx"
