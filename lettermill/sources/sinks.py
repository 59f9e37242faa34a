"""Effects outside of Spark: exported messages, posts to services, file copies, contacts in a remote store.

Effects run on the executors, a partition at a time, through clients that callers may replace. They happen when a sink is called: each gives
one outcome row for each input row, which is written down, so that reading the outcomes, however often, acts no more, and the flags of
the queue follow from what really happened. Only a task that fails or runs twice repeats its rows; each effect is safe to repeat.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from lettermill.operators.state import scratch

#: Tries and pauses (seconds) of copies.
RETRIES, PAUSE, TIMEOUT = 5, 5.0, 30


def per_row(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """Acts on each row now, and gives the stored outcomes, one row each: `start` makes a partition's client and gives the function that acts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = None
        for batch in batches:
            act = act or start()
            rows = [act(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if any(v is not None for v in c) else pa.array(c, pa.string()) for c in map(list, zip(*rows, strict=True))], names=names)

    names = [part.split()[0] for part in ddl.split(", ")]
    spark, path = df.sparkSession, scratch(df.sparkSession, "outcomes")
    df.select(*columns).mapInArrow(run, ddl).write.parquet(path)
    return spark.read.parquet(path)


def eml_name(uid: int, content_hash: str) -> str:
    """uid_suffix.eml; the suffix follows from uid and hash, so a second run writes the same file."""
    return f"{uid}_{hashlib.sha256(f'{uid}|{content_hash}'.encode()).hexdigest()[:6]}.eml"


def export_messages(messages: DataFrame, folder: str) -> DataFrame:
    """Writes each message (columns uid, hash, content) below the folder, a URI that all tasks reach; columns uid, path, error."""

    def start():
        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        fs.create_dir(base, recursive=True)

        def act(uid, content_hash, content):
            path = f"{base}/{eml_name(uid, content_hash)}"
            try:
                with fs.open_output_stream(f"{path}.part") as out:
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
                fs.move(f"{path}.part", path)
                return uid, path, None
            except OSError as e:
                return uid, None, str(e)

        return act

    return per_row(messages, ["uid", "hash", "content"], start, "uid long, path string, error string")


class HttpError(RuntimeError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def http_post(url: str, body: str, key: str | None = None, timeout: int = TIMEOUT) -> str:
    """Posts JSON; the answer's text. Failures are HttpErrors, of status 0 if there was no answer."""
    headers = {"Content-Type": "application/json"} | ({"X-Api-Key": key} if key else {})
    request = urllib.request.Request(url, data=body.encode(), headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace")
        try:
            said = json.loads(text)
        except ValueError:
            said = None
        raise HttpError(e.code, str(said["message"]) if isinstance(said, dict) and said.get("message") is not None else text) from e
    except urllib.error.URLError as e:
        raise HttpError(0, f"no answer from {url}: {e.reason}") from e


def post(payloads: DataFrame, key: str, body: str, url: str, api_key: str | None = None, client: Callable[..., str] = http_post) -> DataFrame:
    """Posts each body; columns key, status, answer, error. An empty answer is {"status": "ok"}."""

    def act(k, text):
        try:
            answer = client(url, text, api_key)
            return k, 200, answer if answer.strip() else '{"status": "ok"}', None
        except HttpError as e:
            return k, e.status, None, str(e)

    return per_row(payloads, [key, body], lambda: act, f"{key} {payloads.schema[key].dataType.simpleString()}, status long, answer string, error string")


def storage_body(path: str, number: str, name: str) -> str:
    return json.dumps({"sourcePath": path, "number": number, "targetFileName": name})


def copy_file(source: str, target: str) -> bool:
    """Copies under another name, then renames, so that a target is never half there."""
    try:
        shutil.copyfile(source, f"{target}.part")
        os.replace(f"{target}.part", target)
        return True
    except OSError:
        return False


def copy_with_retries(source: str, target: str, copy: Callable[[str, str], bool] = copy_file, wait: Callable[[float], None] = time.sleep) -> bool:
    """A first try and five more, five seconds apart."""
    for k in range(RETRIES + 1):
        if copy(source, target):
            return True
        if k < RETRIES:
            wait(PAUSE)
    return False


def store(requests: DataFrame, mounted: Callable[[], bool] = lambda: True, copy: Callable[[str, str], bool] = copy_file, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Copies each request's file (columns source_path, folder, target_file_name); columns source_path, destination, status."""

    def start():
        up = any(mounted() or (wait(1.0), False)[1] for _ in range(5))

        def act(source, folder, name):
            name = (name or "").strip()
            if not up:
                return source, None, "ShareUnavailable"
            if not source or not os.path.isfile(source):
                return source, None, "SourceNotFound"
            if not folder:
                return source, None, "DestinationNotFound"
            if not name or "/" in name or ".." in name or "\0" in name:
                return source, None, "InvalidTargetFileName"
            target = os.path.join(folder, f"{name}.eml")
            return source, target, "Success" if copy_with_retries(source, target, copy, wait) else "CopyFailed"

        return act

    return per_row(requests, ["source_path", "folder", "target_file_name"], start, "source_path string, destination string, status string")


class RemoteStore(Protocol):
    """A remote address book with a metadata table beside it."""

    def find(self, contact: dict) -> str | None: ...

    def save(self, contact: dict) -> str: ...

    def record(self, contact: dict, remote_id: str) -> int: ...

    def delete(self, remote_id: str) -> None: ...


def create_contact(store: RemoteStore, contact: dict) -> tuple[str, str | None, str | None]:
    """(outcome, remote id, error): exists, created, rolled_back if recording failed, rollback_failed if undoing did too."""
    found = store.find(contact)
    if found is not None:
        return "exists", found, None
    try:
        remote = store.save(contact)
    except Exception as e:  # the client's own errors, of any kind, are this row's outcome
        return "failed", None, str(e)
    try:
        store.record(contact, remote)
        return "created", remote, None
    except Exception as e:
        try:
            store.delete(remote)
            return "rolled_back", None, str(e)
        except Exception as undo:
            return "rollback_failed", remote, f"{e}; {undo}"


def create_contacts(contacts: DataFrame, key: str, open_store: Callable[[], RemoteStore], dto: str = "dto") -> DataFrame:
    """Creates each contact that is not there yet; columns key, outcome, remote_id, error."""

    def start():
        remote = open_store()
        return lambda k, contact: (k, *create_contact(remote, contact))

    return per_row(contacts, [key, dto], start, f"{key} {contacts.schema[key].dataType.simpleString()}, outcome string, remote_id string, error string")
