"""Mailboxes as a data source, in batches and as a stream.

    spark.dataSource.register(MailboxSource)
    spark.read.format("mailbox").option("client", "directory").option("path", ...).load()

A folder is an append-only sequence by uid. A batch reads each (account, folder) as one partition; a stream's offset is
the newest uid of each, so a micro-batch reads only what has come since. Rows: account_key, folder, uid, subject, body.
"""

from __future__ import annotations

import imaplib
import json
import os
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lettermill.functions.html_text import mime_parts
from lettermill.sources.settings import mailbox_settings

SCHEMA = "account_key string, folder string, uid long, subject string, body string"


class Client(Protocol):
    """One session with one account."""

    def folders(self) -> list[str]: ...

    def uids(self, folder: str, after: int = -1, upto: int | None = None) -> list[int]: ...

    def raw(self, folder: str, uid: int) -> bytes: ...

    def close(self) -> None: ...


class DirectoryClient:
    """Messages as files: path/account/folder/uid.eml."""

    def __init__(self, options: dict[str, str], account: str):
        self.top = os.path.join(options["path"], account)

    def folders(self) -> list[str]:
        return sorted(d for d in os.listdir(self.top) if os.path.isdir(os.path.join(self.top, d))) if os.path.isdir(self.top) else []

    def uids(self, folder: str, after: int = -1, upto: int | None = None) -> list[int]:
        found = [int(n[:-4]) for n in os.listdir(os.path.join(self.top, folder)) if n.endswith(".eml") and n[:-4].isdigit()]
        return sorted(u for u in found if u > after and (upto is None or u <= upto))

    def raw(self, folder: str, uid: int) -> bytes:
        with open(os.path.join(self.top, folder, f"{uid}.eml"), "rb") as f:
            return f.read()

    def close(self) -> None:
        pass


class ImapClient:
    """A server's messages, over TLS; folders are opened read-only."""

    def __init__(self, options: dict[str, str], account: str):
        s = mailbox_settings(account, options.get("settings"))
        try:
            self.imap = imaplib.IMAP4_SSL(s.host, s.port)
            self.imap.login(s.user, s.password)
        except (OSError, imaplib.IMAP4.error) as e:
            raise ConnectionError(f"account {account}: no connection to {s.host}:{s.port}") from e
        self.open = ""

    def folders(self) -> list[str]:
        return [line.decode().rpartition(' "')[2].rstrip('"') for line in self.imap.list()[1] or [] if line]

    def _select(self, folder: str) -> None:
        if folder != self.open:
            self.imap.select(f'"{folder}"', readonly=True)
            self.open = folder

    def uids(self, folder: str, after: int = -1, upto: int | None = None) -> list[int]:
        self._select(folder)
        found = self.imap.uid("search", None, "UID", f"{after + 1}:{upto if upto is not None else '*'}")[1][0].split()
        return sorted(u for u in map(int, found) if u > after)

    def raw(self, folder: str, uid: int) -> bytes:
        self._select(folder)
        return self.imap.uid("fetch", str(uid), "(RFC822)")[1][0][1]

    def close(self) -> None:
        self.imap.logout()


CLIENTS: dict[str, type] = {"directory": DirectoryClient, "imap": ImapClient}


def accounts_of(options: dict[str, str]) -> list[str]:
    if options.get("accounts"):
        return [a.strip() for a in options["accounts"].split(",") if a.strip()]
    return sorted(os.listdir(options["path"])) if "path" in options else []


def connect(options: dict[str, str], account: str) -> Client:
    return CLIENTS[options.get("client", "directory")](options, account)


@dataclass
class FolderPart(InputPartition):
    account: str
    folder: str
    after: int
    upto: int | None


def read_part(options: dict[str, str], part: FolderPart) -> Iterator[tuple]:
    with closing(connect(options, part.account)) as client:
        for uid in client.uids(part.folder, part.after, part.upto):
            subject, body = mime_parts(client.raw(part.folder, uid))
            yield part.account, part.folder, uid, subject or "", body


def folders_of(options: dict[str, str]) -> Iterator[tuple[str, str, int]]:
    """(account, folder, newest uid or -1)."""
    wanted = {f.strip() for f in options.get("folders", "").split(",") if f.strip()}
    for account in accounts_of(options):
        with closing(connect(options, account)) as client:
            for folder in client.folders():
                if not wanted or folder in wanted:
                    yield account, folder, max(client.uids(folder), default=-1)


class MailboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[FolderPart]:
        return [FolderPart(a, f, -1, newest) for a, f, newest in folders_of(self.options)]

    def read(self, partition: FolderPart) -> Iterator[tuple]:
        return read_part(self.options, partition)


class MailboxStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {json.dumps([a, f]): newest for a, f, newest in folders_of(self.options)}

    def partitions(self, start: dict, end: dict) -> list[FolderPart]:
        return [FolderPart(*json.loads(k), start.get(k, -1), newest) for k, newest in sorted(end.items()) if newest > start.get(k, -1)]

    def read(self, partition: FolderPart) -> Iterator[tuple]:
        return read_part(self.options, partition)


class MailboxSource(DataSource):
    """Options: client (directory or imap), path, accounts and folders (comma-separated, all by default), settings (file)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(dict(self.options))

    def streamReader(self, schema) -> MailboxStream:
        return MailboxStream(dict(self.options))
