"""Connection settings from the environment or a JSON file. They are options of readers and writers, never data."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field


class SettingsError(ValueError):
    """Settings that are missing or make no sense."""


@dataclass(frozen=True)
class MailboxSettings:
    host: str
    port: int
    user: str
    password: str = field(repr=False)


@dataclass(frozen=True)
class ContactSettings:
    url: str
    mailbox: str
    token: str | None = field(default=None, repr=False)
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    domain: str | None = None


def _required(key: str) -> str:
    if not key or not key.strip():
        raise SettingsError("an account key is required")
    return key.strip()


def _file(path: str | None) -> dict:
    if not path or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {k.lower(): v for k, v in json.load(f).items()}


def mailbox_settings(key: str, path: str | None = None, env: Mapping[str, str] = os.environ) -> MailboxSettings:
    """Of the account, from IMAP__KEY__HOST, PORT, USER and PASSWORD, all four or none; else from the file's `accounts`."""
    key = _required(key)
    names = ("HOST", "PORT", "USER", "PASSWORD")
    given = {n: env.get(f"IMAP__{key.upper()}__{n}", "").strip() for n in names}
    if any(given.values()):
        missing = [n for n in names if not given[n]]
        if missing:
            raise SettingsError(f"account {key}: {', '.join(missing)} missing from the environment")
        if not given["PORT"].isascii() or not given["PORT"].isdigit() or int(given["PORT"]) <= 0:
            raise SettingsError(f"account {key}: the port must be a positive number")
        return MailboxSettings(given["HOST"], int(given["PORT"]), given["USER"], given["PASSWORD"])
    accounts = {k.lower(): v for k, v in (_file(path).get("accounts") or {}).items()}
    if key.lower() not in accounts:
        raise SettingsError(f"account {key} is neither in the environment nor in the settings file")
    found = {k.lower(): v for k, v in accounts[key.lower()].items()}
    return MailboxSettings(found.get("host", ""), int(found.get("port", 993)), found.get("user", ""), found.get("password", ""))


def save_path(path: str | None = None, env: Mapping[str, str] = os.environ) -> str:
    """Where messages are exported: MAIL_SAVE_DIR or IMAP_SAVE_PATH, else the file's SavePath."""
    found = env.get("MAIL_SAVE_DIR", "").strip() or env.get("IMAP_SAVE_PATH", "").strip() or (_file(path).get("savepath") or "").strip()
    if not found:
        raise SettingsError("no export path: set MAIL_SAVE_DIR or SavePath")
    return os.path.abspath(os.path.expandvars(found))


def contact_settings(key: str, env: Mapping[str, str] = os.environ) -> ContactSettings:
    """Of the contact store, from EWS__KEY__...: a token (the default mode), or user, password and perhaps a domain."""
    prefix = f"EWS__{_required(key).upper()}__"

    def need(name: str) -> str:
        if prefix + name not in env:
            raise SettingsError(f"{prefix}{name} is missing")
        return env[prefix + name]

    mode = env.get(prefix + "AUTH_MODE", "oauth").lower()
    url, mailbox = need("SERVICE_URL"), need("MAILBOX")
    if mode == "oauth":
        return ContactSettings(url, mailbox, token=need("OAUTH_ACCESS_TOKEN"))
    if mode == "basic":
        return ContactSettings(url, mailbox, user=env.get(prefix + "USERNAME", mailbox), password=need("PASSWORD"), domain=env.get(prefix + "DOMAIN"))
    raise SettingsError(f"unknown way to sign in: {mode}")


def first_run_limit(env: Mapping[str, str] = os.environ, default: int = 10) -> int:
    """Messages that an account's first run reads; nonsense means the default."""
    try:
        n = int(env.get("INITIAL_SYNC_LIMIT", ""))
    except ValueError:
        return default
    return n if n > 0 else default
