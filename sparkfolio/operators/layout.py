"""Reading order, lines, paragraphs and kinds of blocks of a page, from boxes of text.

Each page is laid out on its own, row by row in Arrow batches; nothing is gathered beyond a page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.operators.tables import find_tables
from sparkfolio.operators.terms import mapped

DEPTH, BAND_OVERLAP, STACKED = 12, 0.55, 0.25
BULLETS = re.compile(r"^\s*([•‣◦▪●○■□–\-*·])\s+")
NUMBERED = re.compile(r"^\s*(\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,5}[.)])\s+")


@dataclass(frozen=True)
class Box:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    confidence: float = 1.0
    segments: tuple["Box", ...] = ()

    @property
    def height(self) -> float:
        return self.y1 - self.y0


def overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    """Shared length over the shorter of two stretches."""
    short = min(a1 - a0, b1 - b0)
    return max(0.0, min(a1, b1) - max(a0, b0)) / short if short > 0 else 0.0


def bands(boxes: list[Box]) -> list[list[Box]]:
    """Boxes of one baseline each, top to bottom; the latest band that fits takes a box."""
    out: list[list[Box]] = []
    for b in sorted(boxes, key=lambda b: (b.y0, b.x0)):
        for band in reversed(out[-6:]):
            if overlap(min(x.y0 for x in band), max(x.y1 for x in band), b.y0, b.y1) >= BAND_OVERLAP:
                band.append(b)
                break
        else:
            out.append([b])
    return out


def repeating_columns(boxes: list[Box]) -> bool:
    """Whether the same left edges come back row after row: two or more in three bands each."""
    rows = bands(boxes)
    if len(boxes) < 4 or len(rows) < 3:
        return False
    near = max(1.0, median(b.height for b in boxes))
    edges: list[tuple[float, set[int]]] = []
    for n, row in enumerate(rows):
        for b in row:
            for at, seen in edges:
                if abs(at - b.x0) <= near:
                    seen.add(n)
                    break
            else:
                edges.append((b.x0, {n}))
    return sum(len(seen) >= 3 for _, seen in edges) >= 2


def gaps(stretches: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    """Empty stretches of at least the least length between others, the widest first."""
    out, far = [], None
    for a, b in sorted(stretches):
        if far is not None and a - far >= least:
            out.append((far, a))
        far = b if far is None else max(far, b)
    return sorted(out, key=lambda g: g[0] - g[1])


def merged(boxes: list[Box], limit: float) -> list[Box]:
    """Boxes of one baseline, side by side and at most limit apart, as lines that know their segments."""
    out: list[Box] = []
    for band in bands(boxes):
        run: list[Box] = []
        for b in [*sorted(band, key=lambda b: b.x0), None]:
            if run and (b is None or b.x0 - max(x.x1 for x in run) > limit or any(overlap(x.x0, x.x1, b.x0, b.x1) > STACKED for x in run)):
                parts = tuple(s for x in run for s in (x.segments or (x,)))
                out.append(run[0] if len(run) == 1 else Box(" ".join(x.text for x in run), min(x.x0 for x in run), min(x.y0 for x in run), max(x.x1 for x in run), max(x.y1 for x in run), sum(x.confidence for x in run) / len(run), parts))
                run = []
            if b is not None:
                run.append(b)
    return out


def reads_as_columns(left: list[Box], right: list[Box]) -> bool:
    """Two flows of text side by side: three bands or more each, one box a band."""
    return all(len(rows := bands(side)) >= 3 and len(side) <= 1.3 * len(rows) for side in (left, right))


def reading_order(boxes: list[Box], width: float) -> list[Box]:
    """Lines in the order they are read: cut by columns, then by rows, over and over."""
    boxes = [b for b in boxes if b.text.strip()]
    if not boxes:
        return []
    scale = median(b.height for b in boxes)
    grid = repeating_columns(boxes)
    out: list[Box] = []

    def halves(part: list[Box], cut: tuple[float, float], across: bool) -> tuple[list[Box], list[Box]]:
        at = (cut[0] + cut[1]) / 2
        middle = (lambda b: (b.x0 + b.x1) / 2) if across else (lambda b: (b.y0 + b.y1) / 2)
        return [b for b in part if middle(b) < at], [b for b in part if middle(b) >= at]

    def cut(part: list[Box], depth: int) -> None:
        if len(part) <= 1 or depth > DEPTH:
            out.extend(merged(part, float("inf") if grid else 4 * scale))
            return
        wide = max(b.x1 for b in part) - min(b.x0 for b in part)
        columns = gaps([(b.x0, b.x1) for b in part], max(2 * scale, 0.035 * width))
        if len(part) >= 6 and wide >= 0.6 * width:
            for g in columns[:4]:
                left, right = halves(part, g, True)
                narrow = [max(b.x1 for b in s) - min(b.x0 for b in s) for s in (left, right)]
                if reads_as_columns(left, right) and min(narrow) >= 0.25 * max(narrow):
                    cut(left, depth + 1)
                    cut(right, depth + 1)
                    return
        if rows := gaps([(b.y0, b.y1) for b in part], 0.6 * scale):
            for side in halves(part, rows[0], False):
                cut(side, depth + 1)
            return
        for g in gaps([(b.x0, b.x1) for b in part], max(1.2 * scale, 0.035 * width))[:1]:
            left, right = halves(part, g, True)
            l, r = bands(left), bands(right)
            shared = sum(any(overlap(a[0].y0, a[0].y1, b[0].y0, b[0].y1) >= BAND_OVERLAP for b in r) for a in l)
            if len(l) >= 2 and len(r) >= 2 and not (shared >= 0.6 * min(len(l), len(r)) and (grid or not reads_as_columns(left, right))):
                cut(left, depth + 1)
                cut(right, depth + 1)
                return
        out.extend(merged(part, float("inf") if grid else 4 * scale))

    cut(boxes, 0)
    return out


def paragraphs(lines: list[Box]) -> list[list[Box]]:
    """Lines parted at wide gaps, jumps aside, changes of size and bullets."""
    if not lines:
        return []
    scale = median(b.height for b in lines)
    steps = sorted((b.y0 - a.y1) / max(1.0, a.height) for a, b in zip(lines, lines[1:], strict=False) if -0.5 < (b.y0 - a.y1) / max(1.0, a.height) < 1.5 and max(a.height, b.height) < 1.15 * min(a.height, b.height))
    leading = steps[len(steps) // 4] if len(steps) >= 3 else None
    out = [[lines[0]]]
    for a, b in zip(lines, lines[1:], strict=False):
        gap = b.y0 - a.y1
        part = (
            gap > 0.9 * scale or gap < -scale or overlap(a.x0, a.x1, b.x0, b.x1) <= STACKED or (leading is not None and gap / max(1.0, a.height) - leading > 0.4)
            or max(a.height, b.height) >= 1.45 * min(a.height, b.height) or bool(BULLETS.match(b.text)) or bool(NUMBERED.match(b.text))
        )
        if part:
            out.append([b])
        else:
            out[-1].append(b)
    return out


def kind_of(lines: list[Box], height: float) -> str:
    """heading, list_item or paragraph: tall short text is a heading unless it is a sentence."""
    text = " ".join(b.text for b in lines)
    if BULLETS.match(text) or NUMBERED.match(text):
        return "list_item"
    sentence = len(text.split()) >= 8 and text.rstrip().endswith(".")
    tall = median(b.height for b in lines) > 1.45 * height
    return "heading" if tall and len(lines) <= 2 and len(text) <= 120 and not sentence else "paragraph"


def joins(a: str, b: str) -> str | None:
    """Text of two lines whose word is parted by a hyphen, or None: soft hyphens go, a small letter joins, a capital keeps the hyphen."""
    if a.endswith("­"):
        return a[:-1] + b
    m = re.search(r"[^\W\d_]([-‐])$", a)
    if not m or not b or re.match(r"(?:und|oder|bzw|sowie|and|or|et|ou|y|e)\b", b):
        return None
    if b[0].islower():
        return a[:-1] + b
    return a + b if b[0].isupper() and not re.search(r"\b\w-$", a) else None


def dehyphenated(lines: list[Box]) -> list[Box]:
    """The parted word goes to the line that began it; what is left of the next stays a line."""
    out: list[Box] = []
    for b in lines:
        word, _, rest = b.text.partition(" ")
        if out and (made := joins(out[-1].text, word)) is not None:
            a = out[-1]
            out[-1] = replace(a, text=made, confidence=(a.confidence + b.confidence) / 2, x1=max(a.x1, b.x1) if not rest else a.x1, y1=b.y1 if not rest else a.y1)
            if rest:
                out.append(replace(b, text=rest))
        else:
            out.append(b)
    return out


def lay_out(boxes: list[Box], width: float) -> list[dict]:
    """Blocks of a page in reading order, with lines and, for tables, the grid."""
    lines = reading_order(boxes, width)
    if not lines:
        return []
    height = median(b.height for b in lines)
    out: list[dict] = []
    at = 0
    for a, b, grid in [*find_tables(lines, height), (len(lines), len(lines), None)]:
        for part in paragraphs(lines[at:a]):
            own = dehyphenated(part)
            out.append({"kind": kind_of(part, height), "lines": own, "table": None})
        if grid is not None:
            out.append({"kind": "table", "lines": lines[a:b], "table": grid})
        at = b
    return out


BLOCKS = "block_ord int, kind string, text string, n_lines int, x0 double, y0 double, x1 double, y1 double, n_rows int, n_columns int, cells array<struct<row:int,column:int,column_span:int,text:string>>"


def blocks_of_pages(pages: DataFrame, key: str = "page") -> DataFrame:
    """key and BLOCKS of pages: key and boxes, an array of (text, x0, y0, x1, y1, confidence) beside the page's width."""

    def each(page: dict) -> list[dict]:
        boxes = [Box(b["text"] or "", b["x0"], b["y0"], b["x1"], b["y1"], b["confidence"]) for b in page["boxes"]]
        out = []
        for k, b in enumerate(lay_out(boxes, page["width"] or 0)):
            own, t = b["lines"], b["table"]
            out.append({"block_ord": k, "kind": b["kind"], "text": "\n".join(x.text for x in own), "n_lines": len(own), "x0": min(x.x0 for x in own), "y0": min(x.y0 for x in own), "x1": max(x.x1 for x in own), "y1": max(x.y1 for x in own),
                        "n_rows": t["rows"] if t else None, "n_columns": t["columns"] if t else None, "cells": t["cells"] if t else None})
        return out

    return mapped(pages.select(key, F.struct("width", "boxes").alias("own")), key, "own", BLOCKS, each)
