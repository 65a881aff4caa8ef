"""Term search: phrases of a profile in positioned lines, however layout and reading broke them up.

A page becomes one stream of letters with the kind of gap before each. A phrase is aligned with the stream by
a weighted edit distance that may only begin and end at borders of words, so a hit never is a part of a word.
Before that, stretches that can't hold a hit are ruled out: with k edits, one of k + 1 pieces of the phrase
occurs unchanged where characters that are read for one another count as equal. Of stored texts, many are looked
through together first, and those that can't have a hit are never made pages.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, replace
from functools import cached_property, lru_cache
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.functions.bits import Pattern, ends, width
from sparkfolio.functions.fold import letters
from sparkfolio.model import BAND
from sparkfolio.operators.quality import SEVERITIES

ZONES = ("header", "body", "footer")
#: Characters read for one another, pairs read as one, and the cost of an edit, a look-alike and a spelling.
ALIKE = ("O0Q", "I1L", "S5", "B8", "G6", "Z2", "UV", "A4", "T7")
JOINED = {"M": "RN", "W": "VV"}
EDIT, LOOK, SPELL = 10_000, 100, 1
CLASS = {c: g[0] for g in ALIKE for c in g}
#: Gaps before a letter, weakest first.
NONE, SPACED, PUNCT, HYPHEN, SPACE, LINE, BLOCK = range(7)


class ProfileError(ValueError):
    """What is wrong with a profile, and where."""


@dataclass(frozen=True)
class Term:
    name: str
    match: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    category: str = ""
    severity: str = "medium"
    fuzzy: int | None = None
    case: bool = False
    whole_words: bool = True
    zones: tuple[str, ...] = ZONES
    near: tuple[str, ...] = ()
    not_near: tuple[str, ...] = ()
    window: int = 60


@dataclass(frozen=True)
class Profile:
    terms: tuple[Term, ...]
    markings: bool = False

    def __add__(self, other: Profile) -> Profile:
        both = self.terms + other.terms
        if twice := {t.name for t in self.terms} & {t.name for t in other.terms}:
            raise ProfileError(f"two terms are named {min(twice)!r}")
        return Profile(both, self.markings or other.markings)


LISTS = ("match", "regex", "zones", "near", "not_near")
KINDS = {"name": str, "category": str, "severity": str, "case": bool, "whole_words": bool, "window": int}
SETTINGS = {"fuzzy", "case", "whole_words", "severity", "zones", "window", "markings"}


def skeleton(phrase: str) -> str:
    return "".join(c for ch in phrase for c, _ in letters(ch))


def read_term(entry: object, at: str) -> Term:
    if not isinstance(entry, dict):
        raise ProfileError(f"{at}: not a table")
    names = {f.name for f in fields(Term)}
    if unknown := set(entry) - names:
        raise ProfileError(f"{at}: unknown key {min(unknown)!r}")
    made: dict = {}
    for k, v in entry.items():
        if k in LISTS:
            many = [v] if isinstance(v, str) else v
            if not isinstance(many, list) or not all(isinstance(x, str) and x.strip() for x in many):
                raise ProfileError(f"{at}: {k} must be a text or a list of texts")
            made[k] = tuple(x.strip() for x in many)
        elif k == "fuzzy":
            if v in ("auto", None):
                made[k] = None
            elif v is False or v == "off":
                made[k] = 0
            elif isinstance(v, int) and v is not True and 0 <= v <= 3:
                made[k] = v
            else:
                raise ProfileError(f"{at}: fuzzy must be auto, off or 0 to 3")
        elif not isinstance(v, KINDS[k]) or (k == "window" and (isinstance(v, bool) or v < 1)):
            raise ProfileError(f"{at}: {k} can't be {v!r}")
        else:
            made[k] = v.lower() if k == "severity" else v
    if not made.get("match") and not made.get("regex"):
        if not made.get("name", "").strip():
            raise ProfileError(f"{at}: needs match, regex or a name")
        made["match"] = (made["name"].strip(),)
    made.setdefault("name", (made.get("match") or made["regex"])[0])
    term = Term(**made)
    if term.severity not in SEVERITIES:
        raise ProfileError(f"{at}: unknown severity {term.severity!r}")
    if bad := set(term.zones) - set(ZONES):
        raise ProfileError(f"{at}: unknown zone {min(bad)!r}")
    for phrase in (*term.match, *term.near, *term.not_near):
        if not skeleton(phrase):
            raise ProfileError(f"{at}: {phrase!r} has no letter or digit")
    for r in term.regex:
        try:
            re.compile(r)
        except re.error as e:
            raise ProfileError(f"{at}: {r!r}: {e}") from None
    return term


def parse(data: object) -> Profile:
    """A profile from its tables: settings, which hold for each term that doesn't say otherwise, and term."""
    if not isinstance(data, dict):
        raise ProfileError("a profile has the tables settings and term")
    if unknown := set(data) - {"settings", "term", "terms"}:
        raise ProfileError(f"unknown section {min(unknown)!r}")
    settings = data.get("settings", {})
    if not isinstance(settings, dict) or set(settings) - SETTINGS:
        raise ProfileError("settings: unknown key")
    given: list = []
    for k in ("term", "terms"):
        if k in data:
            if not isinstance(data[k], list):
                raise ProfileError(f"{k} must be a list of tables: [[{k}]]")
            given += data[k]
    markings = settings.get("markings", False)
    if not isinstance(markings, bool):
        raise ProfileError("settings: markings must be true or false")
    base = {k: v for k, v in settings.items() if k != "markings"}
    terms = tuple(read_term({**base, **e} if isinstance(e, dict) else e, f"term {k + 1}") for k, e in enumerate(given))
    names = [t.name for t in terms]
    if twice := [n for n in names if names.count(n) > 1]:
        raise ProfileError(f"two terms are named {twice[0]!r}")
    if not terms and not markings:
        raise ProfileError("the profile has no terms")
    return Profile(terms, markings)


def load(source: str | dict | Profile | Iterable[str]) -> Profile:
    """A profile from its text (TOML, JSON, or a phrase a line with # comments), tables, or phrases."""
    if isinstance(source, Profile):
        return source
    if isinstance(source, dict):
        return parse(source)
    if not isinstance(source, str):
        return parse({"term": [{"match": p} for p in source]})
    if source.lstrip().startswith("{"):
        return parse(json.loads(source))
    if re.search(r"^\s*\[", source, re.M):
        return parse(tomllib.loads(source))
    phrases = [p for x in source.splitlines() if (p := re.sub(r"(^|\s)#.*$", "", x).strip())]
    return parse({"term": [{"match": p} for p in dict.fromkeys(phrases)]})


@dataclass
class Line:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    block: int = 0


@dataclass
class Stream:
    """Letters of a page; for each the gap before it, its line, its place there, whether it may be left out as spelled, and whether a word begins."""

    text: str = ""
    gap: list[int] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    soft: list[bool] = field(default_factory=list)

    @cached_property
    def looks(self) -> str:
        return self.text.translate(LOOKS)

    @cached_property
    def canon(self) -> tuple[str, list[int]]:
        return canonical(self.text)

    @cached_property
    def bare(self) -> tuple[str, list[int]]:
        """The letters that don't just spell an umlaut, look-alikes as one, and where they stand."""
        own = [j for j, s in enumerate(self.soft) if not s]
        return "".join(self.text[j] for j in own).translate(LOOKS), own


SINGLE = re.compile(r"(?<!\S)[^\W_](?!\S)")


def spaced_out(text: str) -> set[int]:
    """Where the single characters of three or more such words in a row stand."""
    out: set[int] = set()
    if len(SINGLE.findall(text)) < 3:
        return out
    run: list[int] = []
    for m in [*re.finditer(r"\S+", text), None]:
        if m is not None and m.end() - m.start() == 1 and m[0].isalnum():
            if not run or m.start() - run[-1] <= 3:
                run.append(m.start())
                continue
        if len(run) >= 3:
            out.update(run)
        run = [m.start()] if m is not None and m.end() - m.start() == 1 and m[0].isalnum() else []
    return out


class Folds(dict):
    """What letters() makes of a character, kept for str.translate() and for loops."""

    def __init__(self, made: Callable[[str], object]) -> None:
        self.made = made

    def __missing__(self, ch: int) -> object:
        out = self[ch] = self.made(chr(ch))
        return out


#: By code points: letters with marks of spelling; the letters alone; those without what spells an umlaut; 1 for what does and 0 for others.
PAIRS, PLAIN, HARD = Folds(letters), Folds(lambda c: "".join(x for x, _ in letters(c)) or None), Folds(lambda c: "".join(x for x, soft in letters(c) if not soft) or None)
SOFT = Folds(lambda c: "".join("01"[soft] for _, soft in letters(c)))
LOOKS = str.maketrans(CLASS)
READ_AS = {two: one for one, two in JOINED.items()}
READ_AS_ONE = re.compile("|".join(READ_AS))
NOT_ASCII = re.compile(r"[^\x00-\x7F]+")
#: Letters and digits of ASCII together, other characters one by one.
RUNS = re.compile(r"[0-9A-Za-z]+|[^0-9A-Za-z]", re.S)


def folded_by(text: str, folds: Folds) -> str:
    """text.translate() by PLAIN or HARD; where all letters fold to ASCII, others than ASCII go first, since translate() is fast without them."""
    out = text
    for ch in set("".join(NOT_ASCII.findall(text))):
        to = folds[ord(ch)] or ""
        if not to.isascii():
            return text.translate(folds)
        out = out.replace(ch, to)
    return out.translate(folds)


def letters_of(lines: list[Line]) -> Stream:
    """The stream of a page without gaps and places: what tells where a phrase can't be."""
    whole = "\n".join(x.text for x in lines)
    text = folded_by(whole, PLAIN)
    spelled = len(folded_by(whole, HARD)) < len(text)
    return Stream(text, soft=[c == "1" for c in whole.translate(SOFT)] if spelled else [False] * len(text))


def stream_of(lines: list[Line]) -> Stream:
    text: list[str] = []
    gaps, numbers, places, softs = [], [], [], []
    block = None
    for n, line in enumerate(lines):
        own = line.text
        spaced = spaced_out(own)
        gap = NONE if block is None else BLOCK if line.block != block else LINE
        if gap == LINE and numbers and re.search(r"\w[-­‐]\s*$", lines[n - 1].text):
            gap = HYPHEN
        block, blanks = line.block, 0
        for m in RUNS.finditer(own):
            k, ch = m.start(), m[0]
            if len(ch) > 1 or ch.isascii() and ch.isalnum():
                count, blanks = len(ch), 0
                text.append(ch.upper())
                gaps.append(gap)
                gaps += [NONE] * (count - 1)
                softs += [False] * count
                numbers += [n] * count
                places += range(k, k + count)
                gap = NONE
            elif got := PAIRS[ord(ch)]:
                blanks = 0
                for c, soft in got:
                    text.append(c)
                    gaps.append(gap)
                    softs.append(soft)
                    numbers.append(n)
                    places.append(k)
                    gap = NONE
            elif ch.isspace():
                blanks += 1
                between = blanks == 1 and k - 1 in spaced and k + 1 in spaced
                gap = max(gap, SPACED if between else SPACE)
            elif ch not in "­​‌‍⁠":
                gap = max(gap, PUNCT)
    return Stream("".join(text), gaps, numbers, places, softs)


def cost_of(a: str, b: str) -> int:
    if a == b:
        return 0
    if a in CLASS and CLASS[a] == CLASS.get(b):
        return LOOK
    return EDIT if not (a.isdigit() or b.isdigit()) else 3 * EDIT  # another number is another thing


def canonical(text: str) -> tuple[str, list[int]]:
    """Look-alikes as one, pairs that are read as one letter as that letter, and where each came from."""
    out, origin, done = [], [], 0
    for m in READ_AS_ONE.finditer(text):
        out += [text[done : m.start()], READ_AS[m[0]]]
        origin += range(done, m.start() + 1)
        done = m.end()
    origin += range(done, len(text))
    return ("".join(out) + text[done:]).translate(LOOKS), origin


@dataclass(frozen=True)
class Phrase:
    text: str
    letters: str
    soft: tuple[bool, ...]
    #: Whether a break stands before the letter.
    breaks: tuple[bool, ...]

    @classmethod
    def of(cls, text: str) -> Phrase:
        out, soft, breaks, gap = [], [], [], False
        for ch in text:
            got = letters(ch)
            gap = gap or not got
            for j, (c, s) in enumerate(got):
                out.append(c)
                soft.append(s)
                breaks.append(gap and j == 0 and bool(len(out) > 1))
            if got:
                gap = False
        return cls(text, "".join(out), tuple(soft), tuple(breaks))


phrase_of = lru_cache(maxsize=1 << 10)(Phrase.of)


@dataclass
class Found:
    term: Term
    start: int
    end: int
    score: float
    how: tuple[str, ...]
    edits: int = 0


def budget(term: Term, n: int) -> int:
    auto = term.fuzzy if term.fuzzy is not None else 0 if n <= 4 else 1 if n <= 8 else 2
    return min(auto, n // 3)


@lru_cache(maxsize=1 << 10)
def bits_of(phrase: Phrase) -> tuple[dict[str, int], dict[str, int], dict[str, int], int]:
    """Of a phrase, with bit i for its first i letters: where a letter, a pair read as one letter and a letter read as a pair stand, and letters that may be left out as spelled."""
    one: dict[str, int] = {}
    pair = {two: sum(2 << i for i, c in enumerate(phrase.letters) if c == c_) for c_, two in JOINED.items()}
    split = {c: sum(2 << i for i in range(1, len(phrase.letters)) if phrase.letters[i - 1 : i + 1] == two) for c, two in JOINED.items()}
    for i, c in enumerate(phrase.letters):
        c = CLASS.get(c, c)
        one[c] = one.get(c, 0) | 2 << i
    return one, {k: v for k, v in pair.items() if v}, {k: v for k, v in split.items() if v}, sum(2 << i for i, s in enumerate(phrase.soft) if s)


def may_align(phrase: Phrase, stream: Stream, a: int, b: int, k: int) -> bool:
    """Whether [a, b) holds the phrase with k edits at most where borders, look-alikes and spellings cost nothing: never False where aligned() finds it.

    A bit of states[d] says that so many letters of the phrase are behind at d edits or less.
    """
    one, pair, split, soft = bits_of(phrase)
    text, looks, softs = stream.text, stream.looks, stream.soft
    whole = 1 << len(phrase.letters)
    if k in (1, 2) and not soft and True not in softs[a:b] and not any(two in text[a:b] for two in pair) and not any(c in text[a:b] for c in split):  # the same as below, of what is left of it
        none, some, most = 1, 3, 3 if k == 1 else 7
        for c in looks[a:b]:
            here, x, y = one.get(c, 0), none, some
            none = x << 1 & here | 1
            some = y << 1 & here | x | (x | none) << 1 | 1
            most = some if k == 1 else most << 1 & here | y | (y | some) << 1 | 1
            if most & whole:
                return True
        return False
    states = [1 | soft & 2]
    for _ in range(k):
        x = states[-1] | states[-1] << 1
        states.append(x | x << 1 & soft)
    before = [0] * (k + 1)
    for j in range(a, b):
        here = one.get(looks[j], 0)
        two = pair and j > a and pair.get(text[j - 1 : j + 1], 0)
        apart = split and split.get(text[j], 0)
        now: list[int] = []
        for d, x in enumerate(states):
            new = x << 1 & here | 1
            if d:
                y = states[d - 1]
                new |= y | y << 1 | now[-1] << 1
            if two:
                new |= before[d] << 1 & two
            if apart:
                new |= x << 2 & apart
            if softs[j]:
                new |= x
            if soft:
                new |= new << 1 & soft
            now.append(new)
        if now[-1] & whole:
            return True
        before, states = states, now
    return bool(states[-1] & whole)


def windows(stream: Stream, phrase: Phrase, k: int) -> list[tuple[int, int]]:
    """Stretches of the stream that may hold the phrase."""
    own = canonical(phrase.letters)[0]
    m, pad = len(phrase.letters), k + 4
    out: list[tuple[int, int]] = []
    views = [(*stream.canon, own), (stream.looks, range(len(stream.text)), phrase.letters.translate(LOOKS))]
    hard = "".join(c for c, s in zip(phrase.letters, phrase.soft, strict=True) if not s)
    if hard != phrase.letters:  # umlauts written without their dots
        views.append((views[1][0], views[1][1], hard.translate(LOOKS)))
    for text, origin, pattern in views:
        n = len(pattern)
        cuts = [j * n // (k + 1) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece, at = pattern[a:b], text.find(pattern[a:b])
            while piece and at >= 0:
                o = origin[at]
                out.append((max(0, o - 2 * a - pad), min(len(stream.text), o + 2 * (n - a) + pad + (m - n))))
                at = text.find(piece, at + 1)
    if True in stream.soft:  # text that spells an umlaut the phrase doesn't
        (text, bare), pattern, at = stream.bare, phrase.letters.translate(LOOKS), 0
        while (at := text.find(pattern, at)) >= 0:
            out.append((max(0, bare[at] - pad), min(len(stream.text), bare[at] + 2 * m + pad)))
            at += 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return [(a, b) for a, b in merged if may_align(phrase, stream, a, b, k)]


def aligned(phrase: Phrase, stream: Stream, a: int, b: int, most: int, free: bool) -> Iterator[tuple[int, int, int]]:
    """(start, end, cost) of the alignments in [a, b) with a cost of at most most, one for each end."""
    text, soft = stream.text[a:b], stream.soft[a:b]
    n, far = len(text), 1 << 40
    gap = stream.gap
    opens = [free or a + j == 0 or gap[a + j] not in (NONE, SPACED) for j in range(n)]
    before2: list[tuple[int, int]] | None = None
    row = [(0, j) if j < n and (opens[j] or (gap[a + j] == SPACED)) else (far, j) for j in range(n + 1)]
    for i, c in enumerate(phrase.letters):
        now = [(min(far, row[0][0] + (SPELL if phrase.soft[i] else EDIT)), row[0][1])]
        for j in range(1, n + 1):
            t = text[j - 1]
            same = cost_of(c, t)
            if same == 0 and phrase.soft[i] != soft[j - 1]:
                same = SPELL
            best = (row[j - 1][0] + same, row[j - 1][1])
            x = row[j][0] + (SPELL if phrase.soft[i] else EDIT)
            if x < best[0]:
                best = (x, row[j][1])
            x = now[j - 1][0] + (SPELL if soft[j - 1] else EDIT)
            if x < best[0]:
                best = (x, now[j - 1][1])
            if j > 1 and c in JOINED and text[j - 2 : j] == JOINED[c] and row[j - 2][0] + LOOK < best[0]:
                best = (row[j - 2][0] + LOOK, row[j - 2][1])
            if i and before2 is not None and t in JOINED and phrase.letters[i - 1 : i + 1] == JOINED[t] and before2[j - 1][0] + LOOK < best[0]:
                best = (before2[j - 1][0] + LOOK, before2[j - 1][1])
            now.append(best)
        before2, row = row, now
    for j in range(1, n + 1):
        cost, start = row[j]
        end = a + j
        closes = free or end == len(stream.text) or gap[end] != NONE
        if cost <= most and closes:
            yield a + start, end, cost


def how_of(phrase: Phrase, stream: Stream, start: int, end: int, edits: int, look: int, spell: int) -> tuple[str, ...]:
    gaps = stream.gap[start + 1 : end]
    out = []
    if sum(g == SPACED for g in gaps) >= 2:
        out.append("spaced")
    if HYPHEN in gaps:
        out.append("hyphenated")
    if LINE in gaps or BLOCK in gaps:
        out.append("split")
    if not edits and not look and not spell and not out and len(gaps) + 1 == len(phrase.letters):
        breaks = phrase.breaks[1:]
        if any(b and g == NONE for b, g in zip(breaks, gaps, strict=True)):
            out.append("glued")
        if any(not b and g != NONE for b, g in zip(breaks, gaps, strict=True)):
            out.append("broken")
    if look:
        out.append("ocr")
    if spell:
        out.append("spelling")
    if edits:
        out.append("fuzzy")
    return tuple(out) or ("exact",)


def phrase_hits(term: Term, phrase: Phrase, stream: Stream, where: list[tuple[int, int]]) -> Iterator[Found]:
    n = len(phrase.letters)
    k, looks = budget(term, n), max(1, n // 3)
    for a, b in where:
        best: list[tuple[int, int, int]] = []
        for start, end, cost in aligned(phrase, stream, a, b, k * EDIT + looks * LOOK + 99, not term.whole_words):
            edits, look, spell = cost // EDIT, cost % EDIT // LOOK, cost % LOOK
            if edits <= k and look <= looks and start < end:
                best.append((cost, start, end))
        taken: list[tuple[int, int]] = []
        for cost, start, end in sorted(best):
            if all(end <= s or e <= start for s, e in taken):
                taken.append((start, end))
                edits, look, spell = cost // EDIT, cost % EDIT // LOOK, cost % LOOK
                yield Found(term, start, end, max(0.0, 1 - (edits + 0.25 * look) / n), how_of(phrase, stream, start, end, edits, look, spell), edits)


def regex_hits(term: Term, pattern: str, lines: list[Line], stream: Stream) -> Iterator[Found]:
    """Matches in the text with line breaks as spaces, and with lines joined closely."""
    flags = 0 if term.case else re.I
    first: dict[tuple[int, int], int] = {}
    for glue, whole in zip((" ", ""), flats([x.text for x in lines]), strict=True):
        if not is_in(pattern, whole, flags):
            continue
        if not first:
            for k, (n, at) in enumerate(zip(stream.line, stream.at, strict=True)):
                first.setdefault((n, at), k)
        text, place = [], []
        for n, line in enumerate(lines):
            own = re.sub(r"[-­‐]\s*$", "", line.text) if glue == "" else line.text
            text.append(own)
            place += [(n, k) for k in range(len(own))]
            if n + 1 < len(lines):
                text.append(glue)
                place += [(n, -1)] * len(glue)
        flat = "".join(text)
        for m in re.finditer(pattern, flat, flags):
            if m.end() == m.start():
                continue
            if term.whole_words and ((m.start() and flat[m.start()].isalnum() and flat[m.start() - 1].isalnum() and place[m.start() - 1][0] == place[m.start()][0]) or (m.end() < len(flat) and flat[m.end() - 1].isalnum() and flat[m.end()].isalnum() and place[m.end()][0] == place[m.end() - 1][0])):
                continue
            own = [first[p] for p in place[m.start() : m.end()] if p in first]
            if own:
                crossed = stream.line[own[0]] != stream.line[own[-1]]
                yield Found(term, own[0], own[-1] + 1, 1.0, ("regex", "split") if crossed else ("regex",))


def beside(words: Iterable[str], stream: Stream, found: Found, window: int) -> bool:
    around = (stream.text[max(0, found.start - window) : found.start], stream.text[found.end : found.end + window])
    return any(skeleton(w) in x for w in words for x in around)


def zone_of(y0: float, y1: float, height: float) -> str:
    if height <= 0:
        return "body"
    middle = (y0 + y1) / 2 / height
    return "header" if middle < BAND else "footer" if middle > 1 - BAND else "body"


@lru_cache(maxsize=1 << 10)
def pieces(phrase: str, k: int) -> tuple[tuple[str, ...], ...]:
    """Of a phrase that is found with k edits at most: pieces of which a text has one, in the views that windows() looks at, and all of it."""
    p = Phrase.of(phrase)
    hard = "".join(c for c, s in zip(p.letters, p.soft, strict=True) if not s)
    forms = canonical(p.letters)[0], p.letters.translate(LOOKS), hard.translate(LOOKS)
    cut = lambda x: tuple(filter(None, (x[j * len(x) // (k + 1) : (j + 1) * len(x) // (k + 1)] for j in range(k + 1))))
    return cut(forms[0]), cut(forms[1]) + cut(forms[2]), (forms[1],)


def candidates(lines: list[Line], profile: Profile) -> list[Term]:
    """The terms that may be found on a page: in one pass over its text, none that is there is left out."""
    whole = "\n".join(x.text for x in lines)
    plain = folded_by(whole, PLAIN)
    joined = plain
    for one, two in JOINED.items():
        joined = joined.replace(two, one)
    bare = folded_by(whole, HARD) if len(plain) > len(lines) else plain
    views = [x.translate(LOOKS) for x in (joined, plain, bare)]

    def may_be(term: Term) -> bool:
        if any(p in v for m in term.match for ps, v in zip(pieces(m, budget(term, len(phrase_of(m).letters))), views, strict=True) for p in ps):
            return True
        flags = 0 if term.case else re.I
        return any(is_in(r, flat, flags) for r in term.regex for flat in flats([x.text for x in lines]))

    return [t for t in profile.terms if may_be(t)]


def unhyphened(text: str) -> str:
    """A line without the hyphen at its end."""
    own = text.rstrip()
    return own[:-1] if own.endswith(("-", "\u00ad", "\u2010")) else text


def flats(texts: list[str]) -> tuple[str, str]:
    """The text with line breaks as spaces, and with lines joined closely, their hyphens left out."""
    return " ".join(texts), "".join(map(unhyphened, texts))


@lru_cache(maxsize=1 << 10)
def anchor(pattern: str, flags: int) -> tuple[str, int] | None:
    """A character without cases that stands in every match of a regular expression, and how far from its start, if that is fixed."""
    parsed, at = _parser.parse(pattern, flags), 0
    for item in parsed:
        if item[0] is _constants.LITERAL and (c := chr(item[1])).isascii() and not c.isalpha():
            return c, at
        least, most = _parser.SubPattern(parsed.state, [item]).getwidth()
        if least != most:
            return None
        at += least
    return None


def is_in(pattern: str, text: str, flags: int) -> bool:
    """Whether a regular expression has a match in text; where there is an anchor, it is tried around that only."""
    found = anchor(pattern, flags)
    if not found:
        return re.search(pattern, text, flags) is not None
    (c, before), own = found, re.compile(pattern, flags)
    at = text.find(c, before)
    while at >= 0:
        if own.match(text, at - before):
            return True
        at = text.find(c, at + 1)
    return False


def find_on_page(lines: list[Line], profile: Profile, height: float, page: int = 1) -> list[dict]:
    """Hits on one page in the order (y0, x0)."""
    wanted = candidates(lines, profile)
    if not wanted:
        return []
    glance = letters_of(lines)
    where = {term.name: [(phrase, windows(glance, phrase, budget(term, len(phrase.letters)))) for phrase in map(phrase_of, term.match)] for term in wanted}
    wanted = [term for term in wanted if term.regex or any(w for _, w in where[term.name])]
    if not wanted:
        return []
    stream = stream_of(lines)
    out = []
    for term in wanted:
        found = [h for phrase, w in where[term.name] for h in phrase_hits(term, phrase, stream, w)]
        found += [h for r in term.regex for h in regex_hits(term, r, lines, stream)]
        kept: list[Found] = []
        for h in sorted(found, key=lambda h: (-h.score, h.start, h.end)):
            if all(h.end <= x.start or x.end <= h.start for x in kept):
                kept.append(h)
        for h in kept:
            if term.near and not beside(term.near, stream, h, term.window):
                continue
            if term.not_near and beside(term.not_near, stream, h, term.window):
                continue
            parts, boxes = [], []
            for n in dict.fromkeys(stream.line[h.start : h.end]):
                at = [stream.at[k] for k in range(h.start, h.end) if stream.line[k] == n]
                line, a, b = lines[n], min(at), max(at) + 1
                parts.append(line.text[a:b])
                wide = (line.x1 - line.x0) / max(1, len(line.text))
                boxes.append((line.x0 + a * wide, line.y0, line.x0 + b * wide, line.y1))
            text = "\n".join(parts)
            if term.case and not h.edits and "regex" not in h.how and not any([c for c in text if c.isalpha()] == [c for c in p if c.isalpha()] for p in term.match):
                continue
            zone = zone_of(boxes[0][1], boxes[0][3], height)
            if zone in term.zones:
                out.append({"term": term.name, "category": term.category, "severity": term.severity, "page": page, "text": text, "how": list(h.how), "score": h.score, "zone": zone,
                            "x0": min(b[0] for b in boxes), "y0": min(b[1] for b in boxes), "x1": max(b[2] for b in boxes), "y1": max(b[3] for b in boxes)})
    return sorted(out, key=lambda h: (h["y0"], h["x0"]))


HITS = "term string, category string, severity string, page int, text string, how array<string>, score double, zone string, x0 double, y0 double, x1 double, y1 double"


def lines_of(text: str) -> tuple[list[Line], float]:
    """The lines of a stored text by the model's geometry, and its page's height."""
    from sparkfolio.model import CHAR, HEIGHT, LEFT, SHEET, STEP, TOP

    out, block, rows = [], 0, text.split("\n")
    for k, x in enumerate(rows):
        if not x.strip(" "):
            block = k + 1
            continue
        y = TOP + k * STEP
        out.append(Line(x, LEFT, y, LEFT + CHAR * len(x), y + HEIGHT, block))
    return out, float(max(SHEET, 2 * TOP + STEP * len(rows)))


#: Rows of a batch that are taken at once, and rows that are handed on together.
SLICE, HANDED_ON = 256, 8192


def mapped(rows: DataFrame, key: str, column: str, schema: str, hits, look=None) -> DataFrame:
    """key and what hits yields for the value of column, row by row in Arrow batches; memory is bounded by some rows and their hits.

    look turns the values of some rows into what hits gets, or None where that would yield nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = [ids.take(pa.array(kept, pa.int64()))] + [pa.array([h[c] for h in out], kinds[c]) for c in kinds]
            return pa.RecordBatch.from_arrays(columns, names=[key, *kinds])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                ids, out, kept = b.column(0), [], []
                values = b.column(1).to_pylist()
                for k, value in enumerate(look(values) if look else values):
                    for h in hits(value) if value is not None else ():
                        kept.append(k)
                        out.append(h)
                        if len(out) >= HANDED_ON:
                            yield made()
                            out, kept = [], []
                if out:
                    yield made()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.type for f in to_arrow_schema(_parse_datatype_string(schema))}
    return rows.select(key, column).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, {schema}")


def find_in_texts(docs: DataFrame, profile: Profile, key: str = "doc_id") -> DataFrame:
    """key and the hits of the profile in stored texts; each text is one page."""

    def look(texts: list[str | None]) -> list[tuple[str, Profile] | None]:
        return [(text, replace(profile, terms=terms)) if terms else None for text, terms in zip(texts, first_look(texts, profile), strict=True)]

    return mapped(docs, key, "text", HITS, lambda seen: find_on_page(*_page(*seen)), look)


def _page(text: str, profile: Profile) -> tuple[list[Line], Profile, float]:
    lines, height = lines_of(text)
    return lines, profile, height


#: Letters as bytes: look-alikes as one, those that spell an umlaut as 1 to 3, those beyond ASCII as 4, and as often 0 between texts as edits are allowed and once more.
SOFT_BYTES, FOREIGN, APART = {"E": "\x01", "S": "\x02", "A": "\x03"}, "\x04", bytes(4)
BYTES = bytes(ord(skeleton(chr(c)).translate(LOOKS) or chr(c)) if c < 128 else 0 for c in range(256))
NO_LETTER = bytes(c for c in range(5, 128) if not skeleton(chr(c))) + b"\0"
#: What characters beyond ASCII become before that, of those that were met first.
MET: dict[str, str] = {}
MOST_MET = 64


def spelled_as(ch: str) -> str:
    return "".join(SOFT_BYTES[c] if soft else c if c.isascii() else FOREIGN for c, soft in PAIRS[ord(ch)])


BEYOND = Folds(spelled_as)
OWN_MARKS = re.compile("[\x01-\x04]")


def letter_bytes(text: str) -> bytes:
    """The letters of a text as bytes, one for each of its stream."""
    out = OWN_MARKS.sub("", text) if any(c in text for c in "\x01\x02\x03\x04") else text
    if not out.isascii():
        for ch, to in MET.items():
            if ch in out:
                out = out.replace(ch, to)
        if not out.isascii():
            new = set("".join(NOT_ASCII.findall(out)))
            if len(MET) + len(new) <= MOST_MET:
                MET.update((ch, BEYOND[ord(ch)]) for ch in new)
                for ch in new:
                    out = out.replace(ch, MET[ch])
            else:
                out = NOT_ASCII.sub(lambda m: m[0].translate(BEYOND), out)
    return out.encode("ascii").translate(BYTES, NO_LETTER)


@lru_cache(maxsize=1 << 10)
def pattern_of(phrase: Phrase, k: int) -> Pattern | None:
    """A phrase over letter_bytes(), by what may_align() goes by; None if it has letters that aren't told apart there or too many."""
    n = len(phrase.letters)
    kind = width(n)
    if kind is None or not phrase.letters.isascii():
        return None
    one, pair, split, soft = bits_of(phrase)
    byte = lambda c: ord(c.translate(LOOKS))
    table = np.zeros(256, kind)
    for c, bits in one.items():
        table[byte(c)] = bits
    for c, b in SOFT_BYTES.items():
        table[ord(b)] = table[byte(c)]
    apart = np.zeros(256, kind)
    for c, bits in split.items():
        apart[byte(c)] = bits
    return Pattern(n, k, table, apart if split else None, tuple((byte(two[0]), byte(two[1]), bits) for two, bits in pair.items()), soft)


@lru_cache(maxsize=1 << 10)
def byte_pieces(phrase: Phrase, k: int) -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """pieces() over letter_bytes(): those of its views with all letters, pairs that are read as one letter spelled out or not, and of the view without soft ones."""
    joined, plain, bare = pieces(phrase.text, k)
    for one, two in JOINED.items():
        for _ in range(max(x.count(one) for x in joined)):
            joined += tuple(x[:at] + two.translate(LOOKS) + x[at + 1 :] for x in joined for at, c in enumerate(x) if c == one)
            joined = tuple(dict.fromkeys(joined))
    return tuple(x.encode("ascii") for x in dict.fromkeys(joined + plain)), tuple(x.encode("ascii") for x in bare)


SPELLED_OUT = bytes.maketrans("".join(SOFT_BYTES.values()).encode(), "".join(SOFT_BYTES).translate(LOOKS).encode())
SOFT_ONES = "".join(SOFT_BYTES.values()).encode()
#: Characters of texts that are looked through together, where these are more than one.
AT_ONCE = 1 << 22


def first_look(texts: list[str | None], profile: Profile) -> list[tuple[Term, ...]]:
    """Of each stored text, the terms that may be found in it: none that is there is left out, and few that aren't stay.

    The texts that have pieces of a phrase are gone through together, those that spell umlauts apart from the others.
    """
    if len(texts) > 1 and sum(len(x) for x in texts if x is not None) > AT_ONCE:
        half = len(texts) // 2
        return first_look(texts[:half], profile) + first_look(texts[half:], profile)
    there: list[set[int]] = [set() for _ in texts]
    folded: dict[bool, list[tuple[int, bytes, bytes, bytes]]] = {False: [], True: []}
    for k, text in enumerate(texts):
        if text is not None:
            own = letter_bytes(text)
            spelled = any(c in own for c in SOFT_ONES)
            folded[spelled].append((k, own, *((own.translate(SPELLED_OUT), own.translate(None, SOFT_ONES)) if spelled else (own, own))))
    for number, term in enumerate(profile.terms):
        for phrase in map(phrase_of, term.match):
            edits = budget(term, len(phrase.letters))
            pattern = pattern_of(phrase, edits)
            for spelled, group in folded.items():
                if pattern is None:
                    where = [k for k, *_ in group]
                else:
                    parts, alone = byte_pieces(phrase, edits)
                    own = [(k, x) for k, x, plain, bare in group if number not in there[k] and (any(p in plain for p in parts) or spelled and any(p in bare for p in alone))]
                    starts = np.cumsum([0] + [len(x) + len(APART) for _, x in own])[:-1]
                    found = ends(np.frombuffer(APART.join(x for _, x in own), np.uint8), pattern, len(SOFT_ONES) * spelled)
                    where = [own[k][0] for k in np.unique(np.searchsorted(starts, found, "right") - 1)]
                for k in where:
                    there[k].add(number)
    for k, text in enumerate(texts):
        lines = None
        for number, term in enumerate(profile.terms):
            flags = 0 if term.case else re.I
            for r in term.regex:
                found = anchor(r, flags)
                if text is None or number in there[k] or found and found[0] != " " and found[0] not in text:
                    continue
                lines = lines or flats([x for x in text.split("\n") if x.strip(" ")])
                if any(is_in(r, flat, flags) for flat in lines):
                    there[k].add(number)
    return [tuple(t for number, t in enumerate(profile.terms) if number in own) for own in there]


def lines_of_page(page: dict) -> list[Line]:
    return [Line(x["text"] or "", x["x0"], x["y0"], x["x1"], x["y1"], k) for k, b in enumerate(page["blocks"]) for x in b["lines"]]


def find_in_documents(documents: DataFrame, profile: Profile) -> DataFrame:
    """source and the hits in documents of the nested model; pages count from 1."""
    each = lambda pages: [h for p in pages for h in find_on_page(lines_of_page(p), profile, p["height"] or 0, p["index"] + 1)]
    return mapped(documents, "source", "pages", HITS, each)
