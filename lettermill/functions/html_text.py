"""HTML and MIME bodies as text."""

from __future__ import annotations

import email
import re
from email import policy
from html.parser import HTMLParser

from lettermill.functions.vocab import BLOCK_TAGS

_BLOCKS = frozenset(BLOCK_TAGS)
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Text(HTMLParser):
    """Text nodes of a page; a block adds a line feed where it ends, unclosed ones where their parents do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.nodes.append("\n")
        elif tag in _EMPTY:
            if tag in _BLOCKS:
                self.nodes.append("\n")
        else:
            self.open.append(tag)
            self.hidden += tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag = self.open.pop()
        self.hidden -= tag in ("script", "style")
        if tag in _BLOCKS:
            self.nodes.append("\n")
        return tag

    def handle_data(self, data):
        if not self.hidden and data:
            self.nodes.append(data)

    def finish(self) -> str:
        self.close()
        while self.open:
            self._close()
        return " ".join(self.nodes)


def html_to_text(page: str | None) -> str:
    """Text of a page: lines by blocks and breaks, white space collapsed, lines of nothing but quotes and angle brackets dropped."""
    if not page:
        return ""
    parser = _Text()
    parser.feed(page)
    text = re.sub(r"[ \t\f\v]+", " ", parser.finish().replace("\xa0", " "))
    lines = [line.strip() for line in re.sub(r" *\n *", "\n", text).split("\n")]
    return "\n".join(line for line in lines if not line or line.strip("<>\"' \t")).strip()


def mime_parts(raw: bytes | None) -> tuple[str | None, str]:
    """(subject, body) of a message file: its first HTML part as text, else its first plain part, else nothing; attachments are not bodies."""
    if not raw:
        return None, ""
    message = email.message_from_bytes(raw, policy=policy.default)
    texts: dict[str, str] = {}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in ("text/html", "text/plain") and kind not in texts and part.get_content_disposition() != "attachment":
            try:
                texts[kind] = part.get_content()
            except (LookupError, UnicodeError):
                texts[kind] = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    subject = message["Subject"]
    return (str(subject) if subject is not None else None), html_to_text(texts["text/html"]) if "text/html" in texts else texts.get("text/plain", "")
