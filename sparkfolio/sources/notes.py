"""What readers make of files: a flat list of blocks with properties, and its Markdown form."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from datetime import date, datetime, timezone


class Unreadable(ValueError):
    """A file that can't be read, and why."""


@dataclass
class Block:
    """kind: heading, paragraph, item, table, code, quote, rule, marker, image or footnote.

    text is in Markdown for running text, as it is for code. depth: of items and quotes. mark: an item's marker, a code
    block's language, an image's address.
    """

    kind: str
    text: str = ""
    level: int = 0
    depth: int = 0
    mark: str = ""
    rows: list[list[str]] = field(default_factory=list)


@dataclass
class Note:
    blocks: list[Block] = field(default_factory=list)
    meta: dict[str, object] = field(default_factory=dict)
    assets: dict[str, bytes] = field(default_factory=dict)
    #: For Markdown, which is kept as it is.
    body: str | None = None


BLOCKS = "block_ord int, kind string, text string, level int, depth int, mark string, rows array<array<string>>"
INVISIBLE = re.compile("[\x00-\x08\x0e-\x1f\x7f­​-‏⁠﻿]")


def clean(text: str) -> str:
    """Single spaces, no invisible characters, no halves of surrogate pairs."""
    text = INVISIBLE.sub("", text)
    return " ".join(text.encode("utf-8", "replace").decode("utf-8", "replace").split())


def escape(text: str) -> str:
    """Characters that Markdown would read, where it would read them."""
    text = re.sub(r"([\\`*<\[\]])", r"\\\1", text)
    text = re.sub(r"(?<!\w)_|_(?!\w)", r"\\_", text)
    text = re.sub(r"^(#{1,6}(?=\s|$)|[-+](?=\s)|>|={3,}$|-{3,}$)", r"\\\1", text)
    return re.sub(r"^(\d{1,9})([.)])(?=\s)", r"\1\\\2", text)


def table_text(rows: list[list[str]]) -> str:
    """A pipe table; empty rows and columns are left out, columns of figures stand right."""
    rows = [[clean(c) for c in r] for r in rows]
    wide = max((len(r) for r in rows), default=0)
    rows = [r + [""] * (wide - len(r)) for r in rows]
    rows = [r for r in rows if any(r)]
    used = [k for k in range(wide) if any(r[k] for r in rows)]
    if not rows or not used:
        return ""
    rows = [[r[k].replace("|", "\\|") for k in used] for r in rows]
    figure = re.compile(r"^[+\-−(]?\s*[€$£]?\s*\d[\d.,'  ]*\s*(?:%|€|\$|£|EUR|USD|CHF|GBP)?\)?$")
    marks = []
    for k in range(len(used)):
        own = [r[k] for r in rows[1:] if r[k]]
        marks.append("---:" if len(own) >= 2 and sum(bool(figure.match(c)) for c in own) >= 0.8 * len(own) else "---")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(marks), *map(line, rows[1:])])


def fenced(text: str, lang: str) -> str:
    longest = max((len(m) for m in re.findall(r"`+", text)), default=0)
    fence = "`" * max(3, longest + 1)
    return f"{fence}{lang}\n{text}\n{fence}"


def body_of(blocks: list[Block]) -> str:
    """Markdown of blocks; items of a list follow each other without a blank line."""
    out: list[str] = []
    last = None
    width: list[int] = []
    for b in blocks:
        if b.kind == "heading":
            made = f"{'#' * min(6, max(1, b.level))} {b.text}"
        elif b.kind == "item":
            width = width[: b.depth] + [len(b.mark or "-") + 1]
            indent = " " * sum(width[:-1])
            made = indent + f"{b.mark or '-'} " + b.text.replace("\n", "\n" + indent + " " * width[-1])
        elif b.kind == "table":
            made = table_text(b.rows)
        elif b.kind == "code":
            made = fenced(b.text, b.mark)
        elif b.kind == "quote":
            made = "\n".join(f"{'> ' * max(1, b.depth)}{x}".rstrip() for x in b.text.split("\n"))
        elif b.kind == "rule":
            made = "---"
        elif b.kind == "marker":
            made = f"<!-- {b.text.replace('--', '- -')} -->"
        elif b.kind == "image":
            made = f"![{b.text}]({b.mark})"
        elif b.kind == "footnote":
            made = f"[^{b.mark}]: {b.text}"
        else:
            made = b.text
        if not made:
            continue
        out.append(("\n" if b.kind == "item" and last == "item" else "\n\n" if out else "") + made)
        last = b.kind
    return "".join(out)


ORDER = ("title", "from", "to", "cc", "date", "subject", "author", "created", "modified", "description", "keywords", "language", "pages", "rows", "sheets", "slides", "source", "format")


def scalar(value: object) -> str | None:
    """A YAML scalar or flow list; None has none."""
    if value is None or value == "" or value == []:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".")
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc) if value.tzinfo else value).strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(x for v in value if (x := scalar(v)) is not None) + "]"
    return json.dumps(clean(str(value)), ensure_ascii=False)


def front_matter(meta: dict[str, object]) -> str:
    keys = [k for k in ORDER if k in meta] + sorted(k for k in meta if k not in ORDER)
    rows = [f"{k}: {v}" for k in keys if (v := scalar(meta[k])) is not None]
    return "---\n" + "\n".join(rows) + "\n---\n" if rows else ""


def rendered(note: Note) -> str:
    """Front matter and body, in composed form, with line feeds."""
    body = note.body if note.body is not None else body_of(note.blocks)
    head = front_matter(note.meta)
    text = head + ("\n" if head and body else "") + body.rstrip("\n") + "\n"
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))


def plain_of(blocks: list[Block]) -> str:
    """The text without markup."""
    rows = lambda b: "\n".join("\t".join(r) for r in b.rows)
    text = "\n\n".join(rows(b) if b.kind == "table" else b.text for b in blocks if b.kind not in ("rule", "marker", "image"))
    return re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"\\([\\`*_<\[\]#>+.)-])|\*{1,2}|~~|`", lambda m: m[1] or "", text))


def title_of(note: Note, name: str) -> str:
    """The property, else an early heading unless the file is a table, else the file's name."""
    if isinstance(t := note.meta.get("title"), str) and t.strip():
        return t.strip()
    stem = re.split(r"[/\\]", name)[-1]
    suffix = re.search(r"\.[A-Za-z0-9]+$", stem)
    if not suffix or suffix[0].lower() not in (".xlsx", ".xlsm", ".ods", ".csv", ".tsv", ".tab"):
        for b in note.blocks[:20]:
            if b.kind == "heading" and b.level <= 2 and b.text:
                return plain_of([b])[:200]
    return (stem[: suffix.start()] if suffix else stem) or name
