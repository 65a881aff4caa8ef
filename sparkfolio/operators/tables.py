"""Tables among the lines of a page: rows whose cells stand in the same columns, and their grid."""

from __future__ import annotations

from typing import Any

ROWS, SHARE, COLUMNS, FITS, WIDE = 3, 0.6, 64, 0.2, 0.6

Cell = tuple[float, float, str]


def gutter(gaps: list[float], height: float) -> float:
    """The least gap that parts cells: above words' gaps, where a jump in their sizes shows it."""
    if not gaps:
        return max(0.75 * height, 1.0)
    g = sorted(x for x in gaps if x > 0) or [height]
    quarter = g[int((len(g) - 1) * 0.25 + 0.5)]
    jumps = [(b / a, (a * b) ** 0.5) for k, (a, b) in enumerate(zip(g, g[1:], strict=False)) if b / a >= 1.5 and k + 1 >= 0.1 * len(g)]
    wide = min(2 * quarter, max(jumps)[1]) if jumps else 0.0
    return min(max(0.75 * height, 1.0, wide), max(2.5 * height, 1.0))  # wider gaps part cells anyhow


def cells_of(line: Any, least: float) -> list[Cell]:
    """A line's segments, joined where they stand close."""
    out: list[Cell] = []
    for s in sorted(line.segments or (line,), key=lambda s: s.x0):
        if out and s.x0 - out[-1][1] < least:
            out[-1] = (out[-1][0], max(out[-1][1], s.x1), f"{out[-1][2]} {s.text}")
        else:
            out.append((s.x0, s.x1, s.text))
    return out


def column_bands(cells: list[Cell], least: float) -> list[tuple[float, float]]:
    """Stretches that two cells or more cover, those nearer than the gutter as one."""
    edges = sorted({x for c in cells for x in c[:2]})
    out: list[tuple[float, float]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        middle = (a + b) / 2
        if sum(c[0] <= middle <= c[1] for c in cells) >= 2:
            if out and a - out[-1][1] < least:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def place(cell: Cell, columns: list[tuple[float, float]]) -> tuple[int, int]:
    """First column and number of columns of a cell: those it overlaps by a fifth of the narrower, else the nearest."""
    hit = []
    for k, (a, b) in enumerate(columns):
        narrow = min(b - a, cell[1] - cell[0])
        if narrow > 0 and min(b, cell[1]) - max(a, cell[0]) >= FITS * narrow:
            hit.append(k)
    if hit:
        return hit[0], hit[-1] - hit[0] + 1
    middle = (cell[0] + cell[1]) / 2
    return min(range(len(columns)), key=lambda k: abs((columns[k][0] + columns[k][1]) / 2 - middle)), 1


def find_tables(lines: list[Any], height: float) -> list[tuple[int, int, dict]]:
    """(first line, line after the last, grid) of the tables, in order."""
    ordered = [sorted(x.segments, key=lambda s: s.x0) for x in lines]
    inner = [b.x0 - a.x1 for s in ordered for a, b in zip(s, s[1:], strict=False)]
    least = gutter(inner, height)
    rows = [cells_of(x, least) for x in lines]
    out: list[tuple[int, int, dict]] = []
    at = 0
    while at < len(lines):
        if len(rows[at]) < 2:
            at += 1
            continue
        end = at + 1
        while end < len(lines):
            gap = lines[end].y0 - lines[end - 1].y1
            if gap > 2 * height or gap < -height:
                break
            if len(rows[end]) < 2 and not (rows[end][0][0] >= min(c[0] for c in rows[at]) - height and end + 1 < len(lines) and len(rows[end + 1]) >= 2 and lines[end + 1].y0 - lines[end].y1 <= 2 * height):
                break
            end += 1
        grid = grid_of(rows[at:end], least)
        if grid:
            out.append((at, end, grid))
            at = end
        else:
            at += 1
    return out


def grid_of(rows: list[list[Cell]], least: float) -> dict | None:
    """The grid of rows of cells, or None where they are no table."""
    many = [r for r in rows if len(r) >= 2]
    if len(rows) < ROWS or len(many) < SHARE * len(rows):
        return None
    counts = sorted((len(r) for r in many), reverse=True)
    most = next((k for k in counts if sum(n >= k for n in counts) >= 2), counts[0])
    span = max(c[1] for r in rows for c in r) - min(c[0] for r in rows for c in r)
    columns = column_bands([c for r in many if len(r) >= most for c in r if c[1] - c[0] < WIDE * span], least)
    if not 2 <= len(columns) <= COLUMNS:
        return None
    cells: list[dict] = []
    for n, r in enumerate(rows):
        for c in r:
            column, wide = place(c, columns)
            if cells and cells[-1]["row"] == n and column < cells[-1]["column"] + cells[-1]["column_span"]:
                cells[-1]["text"] += f" {c[2]}"
            else:
                cells.append({"row": n, "column": column, "column_span": wide, "text": c[2]})
    return {"rows": len(rows), "columns": len(columns), "cells": cells}
