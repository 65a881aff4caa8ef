"""BPE encoding and decoding (operator 2).

A pre-token's symbols stand in an array; the leaves of a segment tree hold the merge rank of each
symbol with its right neighbour. The root yields the leftmost lowest rank; a merge updates at most
three leaves and the path above each, until the root holds no mergeable pair. Encoded pre-tokens are
kept in a bounded cache of two generations: where the younger is full it becomes the elder, whose words
come back as they are met, so that words of frequent use stay and no text makes the cache grow.

Defined results: null and empty texts have no tokens and decode to the empty text; texts of white
space only likewise. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkfolio.llm.common import map_texts

#: A pre-token that is longer isn't kept in the cache; words of each of the cache's two generations.
CACHED_LENGTH, CACHED_WORDS = 64, 1 << 18
NONE = 1 << 40
#: Letters and digits that the regex module knows and the vocabulary's own library (Unicode 16) doesn't.
NEWER = (
    r"\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a"
    r"7cf\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00"
    r"010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U000"
    r"16ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001"
    r"df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-"
    r"\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U0003"
    r"23b0-\U00033479\U0003d000-\U0003fc3f"
)
FIRST_NEWER = chr(int(NEWER[2:10], 16))
#: Capitals of Unicode 16 that Python doesn't lower.
LOWERED = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{0x10D50 + k: 0x10D70 + k for k in range(22)}}
RAISED = regex.compile(f"[{''.join(map(chr, LOWERED))}]")


def leftmost_merges(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """ids after all merges; merges: left << 32 | right -> (rank, merged id). Lowest rank first, leftmost of equals."""
    n = len(ids)
    if n < 2:
        return ids
    # leaf i is node size + i, its value rank << shift | i: the least is the leftmost of the lowest rank
    size, get = n - 1, merges.get
    shift = size.bit_length()
    none, mask = NONE << shift, (1 << shift) - 1
    tree = [none] * size
    left = ids[0]
    for i in range(size):
        right = ids[i + 1]
        m = get(left << 32 | right)
        tree.append(m[0] << shift | i if m else none)
        left = right
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    follow, before = list(range(1, n + 1)), list(range(-1, size))
    while (least := tree[1]) < none:
        i = least & mask
        j = follow[i]
        left = ids[i] = merges[ids[i] << 32 | ids[j]][1]
        ids[j] = -1
        k = follow[i] = follow[j]
        # new are the leaves of the merged symbol, of the one that is gone, and of the one before
        value = none
        if k < n:
            before[k] = i
            if m := get(left << 32 | ids[k]):
                value = m[0] << shift | i
        at = size + i
        while at and tree[at] != value:
            tree[at] = value
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            value = a if a < b else b
        if j < size and tree[at := size + j] != none:
            value = none
            while at and tree[at] != value:
                tree[at] = value
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                value = a if a < b else b
        h = before[i]
        if h >= 0:
            m = get(ids[h] << 32 | left)
            value = m[0] << shift | h if m else none
            at = size + h
            while at and tree[at] != value:
                tree[at] = value
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                value = a if a < b else b
    return [x for x in ids if x >= 0]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a vocabulary file whose words end in a suffix and whose case is lowered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.shown = {i: f" {s}".encode() for i, s in self.name.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        letters = byte_letters()
        self.inner = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + suffix) for x in letters]
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        older = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{NEWER}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{NEWER}]]")
        self.find_older = regex.compile(older.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])+"), regex.V1).findall
        self.newer = regex.compile(f"[{NEWER}]").search
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.marks = regex.compile("|".join(map(regex.escape, self.special))).findall
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The word's ids as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        ids = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        return array("I", leftmost_merges(ids, self.merges)).tobytes()

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if RAISED.search(text):
                text = text.translate(LOWERED)
            if "Σ" in text:  # lowered letter by letter: no final form
                return "".join(c.lower() for c in text)
        return text.lower()

    def plain(self, text: str, out: list[bytes]) -> None:
        text = self.normal(text)
        words = self.find(text) if text.isascii() or max(text) < FIRST_NEWER or not self.newer(text) else self.find_older(text)
        for at in range(0, len(words), CACHED_WORDS):  # what is met in a part of a text fits into the cache
            part = words[at : at + CACHED_WORDS]
            missing = set(part).difference(self.young)
            if len(self.young) + len(missing) > CACHED_WORDS:
                self.young, self.elder, missing = {}, self.young, set(part)
            young, old, longer = self.young, self.elder.get, {}
            for w in missing:
                (young if len(w) <= CACHED_LENGTH else longer)[w] = old(w) or self.word(w)
            out += [young.get(w) or longer[w] for w in part] if longer else map(young.__getitem__, part)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """All ids as bytes, and the decoded text as UTF-8."""
        out: list[bytes] = []
        if self.cut and "<|" in text:
            marks = self.marks(text)
            for k, part in enumerate(self.cut(text)):
                self.plain(part, out)
                if k < len(marks):
                    out.append(array("I", [self.special[marks[k]]]).tobytes())
        else:
            self.plain(text, out)
        ids = b"".join(out)
        return ids, b"".join(map(self.shown.__getitem__, array("I", ids)))[1:]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.name[i] for i in ids)


@lru_cache(maxsize=2)
def loaded(vocabulary: str) -> WordBpe:
    """The encoder, kept with its cache for all tasks of a Python worker."""
    return WordBpe(vocabulary)


def bpe_encode(docs: DataFrame, vocabulary: str, keys: list[str], with_ids: bool = False) -> DataFrame:
    """keys of docs with n_tokens, ids_sha256 and decoded_sha256 of the text, and the ids themselves if asked for.

    vocabulary: path of the vocabulary file on every executor.
    """

    def start():
        bpe = loaded(vocabulary)

        def work(texts: list[str]) -> dict[str, pa.Array]:
            got = [bpe.encode(t) for t in texts]
            hexes = lambda k: pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string())
            made = {"n_tokens": pa.array([len(x[0]) // 4 for x in got], pa.int64()), "ids_sha256": hexes(0), "decoded_sha256": hexes(1)}
            if with_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(len(x[0]) for x in got) // 4, [None, pa.py_buffer(b"".join([x[0] for x in got]))])
                ends = [0]
                for x in got:
                    ends.append(ends[-1] + len(x[0]) // 4)
                made["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            return made

        return work

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs, keys, start, schema)
