"""Operators on pixels, in numpy: contrast, skew, boxes of text from a probability map, tick boxes, decoding of classes.

Recognition itself needs model weights, which this repository doesn't have: `recognized` takes a session of
onnxruntime that the caller loads, and nothing here makes text up.
"""

from __future__ import annotations

import numpy as np


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32) if image.ndim == 3 else image.astype(np.float32)


def is_dark(image: np.ndarray) -> bool:
    """Light text on a dark page, by the mean of a grid of samples."""
    return float(grey(image)[::8, ::8].mean()) < 110


def stretched(image: np.ndarray) -> np.ndarray:
    """Contrast between the 2nd and the 98th percentile to the full range, unless it is next to none."""
    low, high = np.percentile(grey(image), (2, 98))
    if high - low < 16:
        return image
    return np.clip((image.astype(np.float32) - low) * 255 / (high - low), 0, 255).astype(np.uint8)


def despeckled(image: np.ndarray) -> np.ndarray:
    """Lone pixels, which differ from all their neighbours, become their mean, if they are a thousandth of the page."""
    g = grey(image)
    around = np.stack([np.roll(np.roll(g, dy, 0), dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    lone = (np.abs(around - g) > 80).all(axis=0)
    lone[[0, -1]] = lone[:, [0, -1]] = False
    if lone.sum() < 0.001 * lone.size:
        return image
    out = image.copy()
    mean = around.mean(axis=0).astype(np.uint8)
    out[lone] = mean[lone] if image.ndim == 2 else mean[lone][:, None]
    return out


def skew(image: np.ndarray, most: float = 12.0) -> float:
    """Degrees by which lines of text rise to the right: the shear whose row sums vary most; 0 without a clear gain."""
    g = grey(image)
    step = max(1, round(max(g.shape) / 400))
    ink = g[::step, ::step] < 140
    if ink.mean() < 0.0005:
        return 0.0
    y, x = np.nonzero(ink)

    def score(degrees: float) -> float:
        rows = np.round(y + x * np.tan(np.radians(degrees))).astype(np.int64)
        sums = np.bincount(rows - rows.min()).astype(np.float64)
        return float((np.diff(sums) ** 2).sum())

    coarse = max(np.arange(-most, most + 1), key=score)
    best = max((coarse + d / 10 for d in range(-9, 10)), key=score)
    return float(best) if score(best) > 1.02 * score(0.0) and abs(best) > 0.15 else 0.0


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Connected parts (four neighbours) numbered from 1: least numbers spread along runs until none changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        spread = label.copy()
        for axis in (0, 1):
            for back in (False, True):
                s = np.flip(spread, axis) if back else spread
                a, b = (s[1:], s[:-1]) if axis == 0 else (s[:, 1:], s[:, :-1])
                both = (a > 0) & (b > 0) & (b < a)
                a[both] = b[both]
        if (spread == label).all():
            break
        label = spread
    names = np.unique(label[label > 0])
    return np.searchsorted(names, label) * (label > 0) + (label > 0), len(names)


def text_boxes(prob: np.ndarray, threshold: float = 0.3, least: float = 0.6, unclip: float = 1.5, most: int = 1000) -> list[dict]:
    """Boxes of a probability map of text: parts above the threshold with their mean score, grown by their own size."""
    parts, n = labelled(prob > threshold)
    out = []
    for k in range(1, min(n, most) + 1):
        y, x = np.nonzero(parts == k)
        score = float(prob[y, x].mean())
        w, h = x.max() - x.min() + 1, y.max() - y.min() + 1
        if score >= least and min(w, h) >= 3:
            grow = w * h * unclip / (2 * (w + h))
            out.append({"x0": max(0.0, x.min() - grow), "y0": max(0.0, y.min() - grow), "x1": min(prob.shape[1], x.max() + 1 + grow), "y1": min(prob.shape[0], y.max() + 1 + grow), "score": score})
    return sorted(out, key=lambda b: (b["y0"], b["x0"]))


def iou(a: dict, b: dict) -> float:
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    both = max(0.0, w) * max(0.0, h)
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return both / (area(a) + area(b) - both) if both else 0.0


def deduplicated(boxes: list[dict], most: float = 0.5) -> list[dict]:
    """The best of boxes that overlap by more than most."""
    kept: list[dict] = []
    for b in sorted(boxes, key=lambda b: -b["score"]):
        if all(iou(b, k) <= most for k in kept):
            kept.append(b)
    return kept


def tiles(width: int, height: int, side: int = 3840, share: float = 0.15) -> list[dict]:
    """Overlapping tiles of a large page; each owns the stretch up to the middle of its overlaps, so that a box has one owner."""

    def cuts(n: int) -> list[tuple[int, int, float, float]]:
        if n <= side:
            return [(0, n, 0, n)]
        count = -(-(n - int(side * share)) // (side - int(side * share)))
        starts = [round(k * (n - side) / (count - 1)) for k in range(count)]
        edges = [0.0, *((a + side + b) / 2 for a, b in zip(starts, starts[1:], strict=False)), float(n)]
        return [(s, s + side, edges[k], edges[k + 1]) for k, s in enumerate(starts)]

    return [{"x0": a, "x1": b, "own_x0": c, "own_x1": d, "y0": e, "y1": f, "own_y0": g, "own_y1": h} for e, f, g, h in cuts(height) for a, b, c, d in cuts(width)]


def owns(tile: dict, box: dict) -> bool:
    x, y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return tile["own_x0"] <= x < tile["own_x1"] and tile["own_y0"] <= y < tile["own_y1"]


def tick_boxes(image: np.ndarray) -> list[dict]:
    """Small squares of ink with an outline: ticked where their inside has ink, else empty; unclear ones are left out."""
    dark = grey(image) < 140
    parts, n = labelled(dark)
    low, high = max(10.0, 0.006 * image.shape[1]), 0.035 * image.shape[1]
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(parts == k)
        w, h = x.max() - x.min() + 1, y.max() - y.min() + 1
        if not (low <= w <= high and low <= h <= high and max(w, h) <= 1.2 * min(w, h)):
            continue
        own = dark[y.min() : y.max() + 1, x.min() : x.max() + 1]
        if min(own[:2].any(axis=0).mean(), own[-2:].any(axis=0).mean(), own[:, :2].any(axis=1).mean(), own[:, -2:].any(axis=1).mean()) < 0.85:
            continue
        edge = max(2, min(w, h) // 5)
        share = float(own[edge:-edge, edge:-edge].mean()) if min(w, h) > 2 * edge else 0.0
        if share < 0.04 or 0.1 <= share <= 0.6:
            out.append({"x0": int(x.min()), "y0": int(y.min()), "x1": int(x.max()) + 1, "y1": int(y.max()) + 1, "ticked": bool(share >= 0.1)})
    return out


def coloured_ink(image: np.ndarray) -> np.ndarray | None:
    """The ink of stamps as a mask, or None where there is too little of it."""
    spread = image.max(axis=2).astype(np.int16) - image.min(axis=2)
    mask = spread >= 60
    return mask if mask.sum() >= max(400, 0.0002 * mask.size) else None


def decode_classes(scores: np.ndarray, charset: list[str]) -> tuple[str, float, list[int]]:
    """Text, mean probability and steps of the characters: the best class of each step, repeats and class 0 left out."""
    best, p = scores.argmax(axis=1), scores.max(axis=1)
    steps = [k for k in range(len(best)) if best[k] and (k == 0 or best[k] != best[k - 1])]
    return "".join(charset[best[k] - 1] for k in steps), float(np.mean(p[steps])) if steps else 0.0, steps


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise."""
    p = sorted(map(tuple, points))
    if len(p) < 3:
        return np.array(p)

    def half(run: list) -> list:
        out: list = []
        for q in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of the least area around points; one of its sides lies on the hull."""
    h = hull(points).astype(float)
    best, corners = np.inf, None
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        d = (b - a) / (np.linalg.norm(b - a) or 1)
        turn = np.array([d, [-d[1], d[0]]])
        q = h @ turn.T
        low, high = q.min(axis=0), q.max(axis=0)
        if (area := float(np.prod(high - low))) < best:
            best, corners = area, np.array([low, [high[0], low[1]], high, [low[0], high[1]]]) @ turn
    return corners


def recognized(session: object, crops: list[np.ndarray], charset: list[str], height: int = 48) -> list[tuple[str, float]]:
    """Text and confidence of crops by a loaded recognition model: input (n, 3, height, width), output (n, steps, classes)."""
    out: list[tuple[str, float]] = [("", 0.0)] * len(crops)
    order = sorted(range(len(crops)), key=lambda k: crops[k].shape[1] / crops[k].shape[0])
    for at in range(0, len(order), 8):
        part = order[at : at + 8]
        wide = max(max(1, round(crops[k].shape[1] * height / crops[k].shape[0])) for k in part)
        batch = np.zeros((len(part), 3, height, wide), np.float32)
        for j, k in enumerate(part):
            c = crops[k] if crops[k].ndim == 3 else np.repeat(crops[k][:, :, None], 3, axis=2)
            w = max(1, round(c.shape[1] * height / c.shape[0]))
            rows, cols = np.arange(height) * c.shape[0] // height, np.arange(w) * c.shape[1] // w
            batch[j, :, :, :w] = (c[rows][:, cols].transpose(2, 0, 1) / 255 - 0.5) / 0.5
        scores = session.run(None, {session.get_inputs()[0].name: batch})[0]
        for j, k in enumerate(part):
            out[k] = decode_classes(scores[j], charset)[:2]
    return out
