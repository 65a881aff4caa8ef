"""Readers of mail and of rich text."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Callable
from email.message import EmailMessage
from email.utils import parsedate_to_datetime

from sparkfolio.sources.html_reader import decode_html, html_note
from sparkfolio.sources.notes import Block, Note, clean, escape
from sparkfolio.sources.text_readers import text_blocks

Convert = Callable[[bytes, str, int], Note | None]


def eml(data: bytes, convert: Convert | None = None, depth: int = 0) -> Note:
    """Headers as properties, the HTML body or else the text, attachments after it; messages in messages four deep at most."""
    return message_note(email.message_from_bytes(data, policy=email.policy.default), convert, depth)


def message_note(m: EmailMessage, convert: Convert | None, depth: int) -> Note:
    meta: dict[str, object] = {}
    for key, name in (("subject", "title"), ("from", "from"), ("to", "to"), ("cc", "cc")):
        if value := clean(str(m.get(key, ""))):
            meta[name] = value
    try:
        meta["date"] = parsedate_to_datetime(str(m["date"])) if m["date"] else None
    except ValueError:
        pass
    body = m.get_body(("html", "plain"))
    blocks: list[Block] = []
    if body is not None:
        raw = body.get_payload(decode=True) or b""
        if body.get_content_type() == "text/html":
            text = raw.decode(body.get_content_charset(), "replace") if body.get_content_charset() and _known(body.get_content_charset()) else decode_html(raw)
            blocks = html_note(text).blocks
        else:
            charset = body.get_content_charset() or "utf-8"
            blocks = text_blocks(raw.decode(charset if _known(charset) else "utf-8", "replace").replace("\r\n", "\n"))
    for part in m.iter_attachments():
        name = part.get_filename() or "attachment"
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload(0)
            if depth < 4:
                got = message_note(inner, convert, depth + 1)
                blocks += [Block("heading", escape(str(got.meta.get("title", "message"))), 2), *got.blocks]
            continue
        got = convert(part.get_payload(decode=True) or b"", name, depth + 1) if convert else None
        blocks.append(Block("heading", escape(clean(name)), 2))
        blocks += got.blocks if got is not None else []
    return Note(blocks, {k: v for k, v in meta.items() if v is not None})


def _known(charset: str) -> bool:
    try:
        "".encode(charset)
    except LookupError:
        return False
    return True


TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
#: Groups that hold no text of the document.
ASIDE = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr themedata colorschememapping listtable listoverridetable generator xmlnstbl datastore latentstyles fldinst".split())
SIGNS = {"par": "\n", "line": "\v", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "cell": "\x1f", "row": "\x1e", "sect": "\n", "page": "\n"}


def rtf(data: bytes) -> Note:
    """Paragraphs, headings by style, tables, emphasis and the information group."""
    codec, stack, out, skip, jump = "cp1252", [], [], 0, 0
    state = {"aside": False, "b": False, "i": False, "uc": 1, "level": 0}
    info: dict[str, list[str]] = {}
    levels = {m[1]: int(m[2]) for m in re.finditer(rb"\{\\s(\d+)[^{}]*?heading (\d)", data)}
    group, now, style = "", [], 0

    def say(text: str) -> None:
        if group:
            info.setdefault(group, []).append(text)
        elif not state["aside"]:
            mark = ("**" if state["b"] else "") + ("*" if state["i"] else "")
            now.append((text, mark))

    for m in TOKEN.finditer(data):
        word, arg, code, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((dict(state), group))
            jump = 0
        elif brace == b"}":
            if stack:
                kept, group = stack.pop()
                state.update(kept)
            jump = 0
        elif word:
            w, n = word.decode(), int(arg) if arg else None
            if w in ("title", "author", "subject", "keywords", "doccomm") and stack:
                group = w
            elif w in ASIDE:
                state["aside"] = True
            elif w == "ansicpg" and n:
                codec = f"cp{n}" if _known(f"cp{n}") else codec
            elif w == "u" and n is not None:
                say(chr(n % 65536) if not 0xD800 <= n % 65536 < 0xE000 else "�")
                jump = state["uc"]
            elif w == "uc" and n is not None:
                state["uc"] = n
            elif w in ("b", "i"):
                state[w] = n != 0
            elif w == "plain":
                state["b"] = state["i"] = False
            elif w == "pard":
                style = 0
            elif w == "s" and arg:
                style = levels.get(arg, 0)
            elif w in SIGNS and not state["aside"] and not group:
                if SIGNS[w] == "\n":
                    out.append((style, list(now)))
                    now.clear()
                else:
                    now.append((SIGNS[w], ""))
        elif code:
            if jump:
                jump -= 1
            else:
                say(bytes([int(code, 16)]).decode(codec, "replace"))
        elif sign:
            if sign == b"*":
                state["aside"] = True
            elif sign in b"\\{}":
                say(sign.decode())
            elif sign == b"~":
                say(" ")
            elif sign == b"_":
                say("-")
        elif text:
            raw = text.decode(codec, "replace")
            if jump:
                raw, jump = raw[jump:], max(0, jump - len(raw))
            say(raw)
    out.append((style, now))
    blocks: list[Block] = []
    rows: list[list[str]] = []
    for level, parts in out:
        plain = "".join(t for t, _ in parts)
        if "\x1f" in plain or "\x1e" in plain:
            *cut, rest = plain.split("\x1e")
            rows += [[clean(c) for c in r.split("\x1f")[:-1]] for r in cut]
            parts = [(rest, "")]
            plain = rest
        if not plain.strip():
            continue
        if rows:
            blocks.append(Block("table", rows=rows))
            rows = []
        made, last = [], ""
        for t, mark in [*parts, ("", "")]:
            if mark != last:
                made += [last[::-1], mark]
                last = mark
            made.append(re.sub(r"([\\`*\[\]])", r"\\\1", t))
        text = " ".join("".join(made).replace("\v", "\\\n").split(" ")).strip()
        if bullet := re.match(r"(?:•|·|-)\t\s*(.*)", text, re.S):
            blocks.append(Block("item", bullet[1], mark="-"))
        else:
            blocks.append(Block("heading", clean(plain), level) if level else Block("paragraph", re.sub(r"[ \t]+", " ", text)))
    if rows:
        blocks.append(Block("table", rows=rows))
    names = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "doccomm": "description"}
    return Note(blocks, {names[k]: clean("".join(v)) for k, v in info.items() if clean("".join(v))})
