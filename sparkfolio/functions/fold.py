"""Folding of text to letters that compare: capitals without marks, with where each came from."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

DASHES = frozenset("‐‑‒–—―−﹘﹣－")
HIDDEN = frozenset("­​‌‍⁠﻿")
NOT_ASCII = re.compile(r"[^\x00-\x7F]+")
SPELLED = {"Ä": "AE", "Ö": "OE", "Ü": "UE", "ß": "SS", "ẞ": "SS", "Æ": "AE", "Œ": "OE", "Ø": "OE", "Å": "AA"}


@lru_cache(maxsize=1 << 14)
def folded(ch: str) -> str:
    """A character in capitals without marks; dashes alike, invisible ones nothing."""
    if ch in DASHES:
        return "-"
    if ch in HIDDEN:
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).upper()
    return plain.replace("ẞ", "SS")


@lru_cache(maxsize=1 << 14)
def letters(ch: str) -> tuple[tuple[str, bool], ...]:
    """Letters and digits of a character, each with whether it is the E, S or A of a spelled-out umlaut."""
    up = unicodedata.normalize("NFC", ch).upper() if ch not in "ßẞ" else ch
    if up in SPELLED:
        a, b = SPELLED[up]
        return ((a, False), (b, True))
    return tuple((c, False) for c in folded(ch) if c.isalnum())


def fold_text(text: str) -> tuple[str, list[int]]:
    """The folded text, and the index in text of each of its characters."""
    made = {c: folded(c) for c in set(text)}
    if all(len(f) == 1 for f in made.values()):  # one for one
        return text.translate(str.maketrans(made)), list(range(len(text)))
    out, origin = [], []
    for k, ch in enumerate(text):
        f = made[ch]
        out.append(f)
        origin += [k] * len(f)
    return "".join(out), origin


def folded_text(text: str) -> str:
    """The folded text alone, in fewer steps where it becomes ASCII."""
    out = text
    for ch in set("".join(NOT_ASCII.findall(text))):
        to = folded(ch)
        if not to.isascii():
            return fold_text(text)[0]
        out = out.replace(ch, to)
    return out.upper()
