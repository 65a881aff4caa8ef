"""Secret scans (operator 9): fixed patterns, and a linear-chain conditional random field beside them.

The field tags white-space separated tokens as secret begin (B), inside (I) or outside (O) from the
token's shape, the words beside it and features of the whole file, and is decoded by Viterbi. Tokens
that may be B or I are those with both a letter and a digit and CORE characters at least, and those of
SHORT characters at least that hold a clue word (such as `password`) or come one or two tokens behind
one; all others are O by definition, so that a text falls into runs of such tokens which are decoded on
their own, exactly as the whole chain would be. Weights are fitted by stochastic gradient on the
likelihood of generated labelled files (FILES, seeded) of prose, settings and data, with the features
of each file taken as they are in a scan; no text of the corpus is used.

Base spans are whole matches of the patterns; the field's spans are added where they don't overlap
base ones, as kind `field`. Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans, `base_sha256` of the empty string and empty
`spans`; texts and tokens of any length are looked at whole; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.llm.common import map_texts

#: Generated files, passes over them, seed, least characters of a token by itself and of one near a clue, longest token whose shape is kept.
FILES, PASSES, SEED, CORE, SHORT, KEPT = 400, 6, 11, 12, 6, 256
KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
CLUE = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|login|private", re.I | re.A)
PREFIX = re.compile(r"(AKIA|ghp_|sk[-_]|eyJ|xox|pk[-_])")
SAFE = re.compile(r"@|://|^www\.|\.(html?|com|org|net)\b|^[0-9]{1,4}([-/.:][0-9]{1,4})+$|^[0-9a-f]{8}-[0-9a-f]{4}-", re.A)
MARK = re.compile(r"[0-9!#%&$*+]|[a-z][A-Z]")

Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the pattern matches that are long enough."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if HINT.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def shape(token: str) -> tuple[str, ...]:
    """Features of a token by itself, of all its characters."""
    return kept_shape(token) if len(token) <= KEPT else shape_of(token)


def shape_of(token: str) -> tuple[str, ...]:
    core = token.strip("\"'`,;:()[]{}<>")
    n = max(1, len(core))
    digits = sum(c.isdigit() for c in core)
    upper, lower = sum(c.isupper() for c in core), sum(c.islower() for c in core)
    counts = [core.count(c) for c in set(core)]
    entropy = -sum(k / n * math.log2(k / n) for k in counts)
    turns = sum((a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()) for a, b in zip(core, core[1:], strict=False))
    return (
        "bias", f"len{min(6, n // 8)}", f"entropy{min(10, int(2 * entropy))}", f"digits{min(5, 6 * digits // n)}", f"turns{min(5, 8 * turns // n)}",
        f"case{(upper > 0) + 2 * (lower > 0)}", f"mixed{min(4, 5 * min(upper, lower) // n)}",
        "prefix" if PREFIX.match(core) else "noprefix", "safe" if SAFE.search(core) else "unsafe", "other" if re.search(r"[^A-Za-z0-9+/_.=-]", core) else "plain",
    )


kept_shape = lru_cache(maxsize=1 << 14)(shape_of)


def candidate(token: str) -> bool:
    return len(token) >= CORE and DIGIT.search(token) is not None and LETTER.search(token) is not None


@dataclass
class Tokens:
    """A file's tokens with their starts, the numbers of those that are near a clue, and the runs of those that may be secret."""

    at: list[int]
    words: list[str]
    near: set[int]
    runs: list[tuple[int, int]]
    file: tuple[str, ...]


def tokens_of(text: str) -> Tokens | None:
    """None where no token may be secret."""
    clues = [m.start() for m in CLUE.finditer(text)]
    if not clues and DIGIT.search(text) is None:
        return None
    found = [(m.start(), m.group()) for m in TOKEN.finditer(text)]
    at, words = [k for k, _ in found], [w for _, w in found]
    held = {bisect_right(at, k) - 1 for k in clues}
    near = {k + d for k in held for d in range(3) if k + d < len(words)}
    runs: list[tuple[int, int]] = []
    own = 0
    for i, w in enumerate(words):
        alone = candidate(w)
        own += alone
        if alone or (i in near and len(w) >= SHORT):
            if runs and runs[-1][1] == i:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i, i + 1))
    return Tokens(at, words, near, runs, file_features(own, len(held), len(words))) if runs else None


def file_features(n_candidates: int, n_clues: int, n_tokens: int) -> tuple[str, ...]:
    """How much of the file looks like data, and how many clue words it has for that."""
    level = lambda n: 0 if n * 50 < n_tokens else 1 if n * 5 < n_tokens else 2
    return f"file{level(n_candidates)}", f"keys{0 if not n_clues else 1 if n_clues * 4 < n_candidates else 2}"


def features(t: Tokens, i: int) -> list[str]:
    """Features of token i with its neighbours and its file."""
    w, before = t.words[i], t.words[i - 1] if i else ""
    clue = "clue" if i in t.near else "noclue"
    out = [*shape(w), *t.file, clue, f"{clue}:{t.file[0]}"]
    out.append("sign" if before[-1:] in (":", "=") else "nosign")
    out.append("quoted" if w[:1] in "\"'`" else "bare")
    out.append("next" if i + 1 < len(t.words) and candidate(t.words[i + 1]) else "nonext")
    out.append(f"{clue}:{'long' if candidate(w) else 'mark' if MARK.search(w) else 'plainword'}")
    return out


class Field:
    """Weights of features for each tag, and of pairs of tags; O stands around each run of candidates."""

    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.pair = np.zeros((3, 3))
        self.pair[0, 2] = -1e3  # inside follows begin or inside

    def unary(self, fs: list[str]) -> np.ndarray:
        s = np.zeros(3)
        for f in fs:
            if (v := self.w.get(f)) is not None:
                s += v
        return s

    def viterbi(self, u: np.ndarray) -> list[int]:
        best, back = self.pair[0] + u[0], []
        for x in u[1:]:
            m = best[:, None] + self.pair
            back.append(m.argmax(axis=0))
            best = m.max(axis=0) + x
        tags = [int((best + self.pair[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def learn(self, fs: list[list[str]], gold: list[int], rate: float) -> None:
        """A step up the gradient of the log likelihood: observed less expected counts."""
        u = np.array([self.unary(f) for f in fs])
        n = len(u)
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = self.pair[0] + u[0]
        for k in range(1, n):
            a[k] = np.logaddexp.reduce(a[k - 1][:, None] + self.pair, axis=0) + u[k]
        b[-1] = self.pair[:, 0]
        for k in range(n - 2, -1, -1):
            b[k] = np.logaddexp.reduce(self.pair + u[k + 1] + b[k + 1], axis=1)
        z = np.logaddexp.reduce(a[-1] + b[-1])
        p = np.exp(a + b - z)
        for k in range(n):
            g = -p[k]
            g[gold[k]] += 1
            for f in fs[k]:
                self.w[f] = self.w.get(f, 0) * (1 - 1e-4) + rate * g
        for k in range(n + 1):
            if k == 0:
                e = np.zeros((3, 3))
                e[0] = p[0]
            elif k == n:
                e = np.zeros((3, 3))
                e[:, 0] = p[-1]
            else:
                e = np.exp(a[k - 1][:, None] + self.pair + u[k] + b[k] - z)
            e = -e
            e[gold[k - 1] if k else 0, gold[k] if k < n else 0] += 1
            self.pair += 0.3 * rate * e


def labelled_files(n: int = FILES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """Generated files and those of their tokens that are secrets.

    Files of prose have few tokens that may be secret, settings many with clues, and data many without,
    which are no secrets.
    """
    rnd = random.Random(seed)
    pick = lambda chars, a, b: "".join(rnd.choice(chars) for _ in range(rnd.randint(a, b)))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    prose = lambda a, b: " ".join(pick(low, 2, 9) for _ in range(rnd.randint(a, b)))
    mixed = lambda a, b: pick(low + up + num, a, b) + pick(num, 1, 3) + pick(low + up, 2, 6)
    key = lambda: rnd.choice(["password", "API_KEY", "secret", "token", "auth", "Authorization", "client_secret", "pwd", "access_key", "login"])

    def secret() -> str:
        return rnd.choice([mixed(20, 44), mixed(16, 28), "ghp_" + mixed(28, 34), "sk-" + mixed(24, 44), "sk_live_" + mixed(20, 26), "eyJ" + mixed(30, 80), mixed(14, 30) + "==", "xoxb-" + pick(num, 10, 12) + "-" + mixed(18, 24), "AKIA" + pick(up + num, 16, 16)])

    def plain() -> str:
        return rnd.choice([
            pick(low, 2, 8) + pick(num, 1, 2) + "@" + pick(low, 3, 8) + rnd.choice("123456789") + ".example.com", "https://" + pick(low, 4, 9) + ".example.org/" + pick(low, 2, 5) + "/" + pick(num, 1, 4), pick(low, 6, 14) + pick(num, 1, 4),
            pick(up + num, 4, 6) + "-" + pick(num, 8, 10), "ISBN-" + pick(num, 10, 13), pick(low, 5, 9) + "_" + pick(low, 4, 9) + "_" + pick(num, 1, 3), "v" + pick(num, 1, 2) + "." + pick(num, 1, 2) + "." + pick(num, 1, 3) + "-" + pick(low, 3, 6), pick(low, 8, 20) + "###" + pick(num, 2, 4),
            pick(num, 2, 4) + "@mail" + pick(num, 1, 1) + ".example.com", pick(low, 8, 30) + "." + pick(num, 2, 3) + "@mail3.example.com", "-".join(pick(num + "abcdef", k, k) for k in (8, 4, 4, 4, 12)), pick(low, 4, 9).title() + pick(num, 10, 16),
        ])

    def short() -> str:
        """A password that people choose."""
        return rnd.choice([pick(low, 3, 6).title() + pick(num, 1, 3) + pick("!#%&$*+", 1, 2), pick(low + up, 3, 5) + pick("!#%&$*+", 1, 1) + pick(low + num, 3, 5), pick(up, 2, 3) + pick(low, 2, 4) + pick(up, 1, 2) + pick(num, 1, 3) + pick(low, 1, 3)])

    def said(text: str, inside: str) -> tuple[str, set[str]]:
        return text, {t for t in text.split() if inside in t}

    def line(kind: float) -> tuple[str, set[str]]:
        if kind < 0.35:
            s = secret()
            form = rnd.choice(["{k} {s}", "{k}: {s}", "{k} = {s}", "{k} is '{s}'", "Bearer {s}", "use {s}", "with {s}", "{s}", "{s}", '{k} = "{s}"'])
            return said(form.format(k=key(), s=s), s)
        if kind < 0.45:
            s = short()
            return said(rnd.choice(["{k} {s}", "{k}: {s}", "{k} is {s}", '{k} "{s}"']).format(k=rnd.choice(["password", "pwd", "passwd", "login"]), s=s), s)
        if kind < 0.5:
            both = [mixed(20, 40), mixed(20, 40)]
            return "private key " + " ".join(both), set(both)
        if kind < 0.7:
            return f"{key()} {prose(1, 4)}", set()
        return rnd.choice(["{p}", "see {p}", "{p} {p}", "{k} {p}" if rnd.random() < 0.2 else "{p}"]).format(k=key(), p=plain()), set()

    out = []
    for k in range(n):
        kind = k % 4
        if kind < 2:  # prose with little else, of any length
            parts = [x for _ in range(rnd.randint(1, 3)) for x in ((prose(5, 150), set()), line(rnd.random()))] + [(prose(0, 60), set())]
        elif kind == 2:  # settings
            parts = [line(rnd.choice([0.1, 0.4, 0.6, 0.8])) for _ in range(rnd.randint(2, 12))]
        else:  # data: identifiers beside plain values
            parts = [(" ".join(rnd.choice([mixed(16, 28), mixed(16, 28), plain(), pick(low, 3, 8), pick(num, 1, 6)]) for _ in range(rnd.randint(2, 6))), set()) for _ in range(rnd.randint(3, 12))]
        out.append(("\n".join(t for t, _ in parts), set().union(*(x for _, x in parts))))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    field, rnd = Field(), random.Random(SEED)
    files = [(t, secret) for text, secret in labelled_files() if (t := tokens_of(text))]
    for k in range(PASSES):
        rnd.shuffle(files)
        for t, secret in files:
            for a, b in t.runs:
                gold = [0] * (b - a)
                for i in range(a, b):
                    if t.words[i] in secret:
                        gold[i - a] = 2 if i > a and gold[i - a - 1] else 1
                field.learn([features(t, i) for i in range(a, b)], gold, 0.3 / (1 + k))
    return field


def field_spans(text: str, field: Field) -> list[Span]:
    t = tokens_of(text)
    out: list[Span] = []
    for a, b in t.runs if t else ():
        tags = field.viterbi(np.array([field.unary(features(t, i)) for i in range(a, b)]))
        for i, tag in zip(range(a, b), tags, strict=True):
            end = t.at[i] + len(t.words[i])
            if tag == 1:
                out.append((t.at[i], "field", end))
            elif tag == 2:
                out[-1] = (out[-1][0], "field", end)
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, in order of start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[1]))
    base = sorted(base_spans(text), key=order)
    starts, furthest = [b[0] for b in base], list(accumulate((b[2] for b in base), max, initial=0))
    more = [s for s in field_spans(text, field) if furthest[bisect_left(starts, s[2])] <= s[0]]  # the ends of all that begin before its end
    return base, sorted(base + more, key=order)


def scan_secrets(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys of docs with the number of base spans by kind, their digest, and all spans."""
    shown = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def start():
        field = sent.value

        def work(texts: list[str]) -> dict[str, pa.Array]:
            got = [all_spans(t, field) for t in texts]
            made = {f"n_{k}": pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS[:3]}
            made["base_sha256"] = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in got], pa.string())
            made["spans"] = pa.array([shown(every) for _, every in got], pa.string())
            return made

        return work

    return map_texts(docs, keys, start, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
