"""MinHash near-dedup (operator 8): a chosen-path set similarity join.

A document's set is that of its distinct word shingles, hashed to 64 bits; documents with equal sets
are one class. In each of TREES independent trees the classes branch by the shingle that is least
under the tree's hash of that level: two sets of similarity s go to the same child with
probability s. A node of LIMIT members at most is a leaf, whose members are compared exhaustively;
a larger node branches on. Nodes that are still larger on level SPLIT branch by two tokens at once, so
that a pair at 0.8 shares a child in 0.96 of cases. Children that are larger than LIMIT are split by
bands of set sizes, two for each class, so that sets whose sizes allow a similarity of 0.8 share a
band; bands of LIMIT members at most are leaves. Classes in larger bands are crowded: an exact
prefix-filter join over them finds every link between two components that is left. A pair at 0.8 thus
comes to a comparison in a tree with probability 0.8 ** 2 * 0.96 at least, and TREES trees miss
0.386 ** TREES, 1 in 90,000.

In the trees of the first round large nodes are also dealt into chunks of LIMIT members, each with the
same PIVOTS, so that a large group of near copies, which no branching splits, becomes one component in
linear work before the other trees are looked at.

The exact join orders the shingles of a set by how many crowded sets have them, rarest first. Two
sets that need t shingles in common have their first common one among the first n - t + 1 of each;
what lies behind it must suffice for t. Shingles that a whole family shares come last, so that they
propose no pairs; the order is by counts of hash buckets, which decides the work, never the result. A
shingle alone in its bucket is in no other set and proposes nothing.

Within a node, short signatures first rule out pairs that are far apart (KEEP of 48 positions equal
at least, at 0.8 below by chance once in 100,000). Links are confirmed on full sets, which travel to
a node only if its members aren't yet in one component. Links of each round are mapped to the
components found so far; those inside one go, and only what is left is contracted further.

Defined results: a null text or one without words has an empty set and is linked with nothing; a
text with fewer words than a shingle is one shingle; repeated rows are linked as equal sets; an
empty table gives an empty result. Rows without a doc_id are linked as all others are, but a
component takes its id from the least doc_id that is there; where none has one, its component_id is
null and one of its rows is kept. Rows that share a doc_id may have different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, map_texts, settled

#: DEPTH: tokens of a tree, one for each level and a second one for the last.
TREES, DEPTH, LIMIT, PIVOTS, KEEP = 12, 4, 48, 4, 24
#: Level on which large nodes branch by two tokens (the next is the last), bits of a bucket of shingles, buckets that are summed up together, entries of a block of a shingle's list.
SPLIT, BUCKET, TOGETHER, BLOCK = 1, 20, 4096, 512
#: Band of a set's size: sizes of a ratio of 0.8 are in the same band or in neighbouring ones.
BAND = "cast(floor(ln(n) / ln(1.2501)) as int)"
#: Trees up to which each round goes; components are contracted in between.
ROUNDS = (2, 6, TREES)
SIGNATURE = TREES * DEPTH
CACHED = 1 << 17
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FACTORS = (np.random.default_rng(8).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class Hashes(dict):
    """64-bit hash of a word, kept once computed."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str, words: int, hashes: Hashes) -> np.ndarray:
    """The distinct hashed shingles in order."""
    tokens = text.encode().translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    s = np.full(n, 0x9E3779B97F4A7C15 + min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        s = (s ^ h[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
    return np.unique(s * np.uint64(0x94D049BB133111EB))


def least(s: np.ndarray) -> np.ndarray:
    """The set's least hash under each of the signature's functions, 32 bits of it."""
    out = np.empty(SIGNATURE, np.uint64)
    step = max(1, (1 << 18) // len(s))
    for k in range(0, SIGNATURE, step):
        out[k : k + step] = (s[None, :] * FACTORS[k : k + step, None]).min(axis=1)
    return (out >> np.uint64(32)).astype(np.uint32)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and text_hash of docs, n_shingles, digest of the set, path (tokens of all trees and levels) and sig (one byte of each)."""

    def start():
        hashes = Hashes()

        def work(texts: list[str]) -> dict[str, pa.Array]:
            sets = [shingle_set(t, words, hashes) for t in texts]
            mins = [least(s) if len(s) else None for s in sets]
            return {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([digest(s) for s in sets], pa.binary()),
                "path": pa.array([m if m is None else m.view(np.int32) for m in mins], pa.list_(pa.int32())),
                "sig": pa.array([m if m is None else m.astype(np.uint8).tobytes() for m in mins], pa.binary()),
            }

        return work

    return map_texts(docs, ["doc_id", "text_hash"], start, "n_shingles bigint, digest binary, path array<int>, sig binary")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that hold whole groups go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def joined(n: int, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that join 0 to n - 1, found by comparing all that aren't joined yet."""
    up, links = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            ra, rb = top(a), top(b)
            if ra != rb and linked(a, b):
                up[rb] = ra
                links.append((a, b))
    return links


def nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tree and members (rep, n, sig) of the leaves and chunks that may hold a link, and node and rep of the crowded classes."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("rep", "n", "sig", "path", tree)
    token = lambda level: F.element_at("path", F.col("tree") * DEPTH + level + 1)
    rows = rows.select("rep", "n", "sig", "tree", F.xxhash64("tree", token(0)).alias("node"), F.array(*map(token, range(1, DEPTH))).alias("rest"))
    member = F.struct("rep", "n", "sig")
    found = []

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node")

    def leaves_of(rows: DataFrame) -> DataFrame:
        """Take the leaves among the nodes; the rows of larger ones."""
        found.append(rows.where(F.col("size") <= LIMIT).groupBy("node", "tree").agg(F.collect_list(member).alias("members")).drop("node"))
        return cut(rows.where(F.col("size") > LIMIT))

    for level in range(SPLIT + 2):
        rows = leaves_of(sized(rows))
        if level in (0, SPLIT + 1):  # groups that no branching splits
            some, chunks = rows.where(F.col("tree") < ROUNDS[0]), F.ceil(F.col("size") / LIMIT).cast("int")
            pivots = [F.min(F.struct(F.xxhash64("rep", F.lit(level), F.lit(k)).alias("turn"), member.alias("member"))).alias(f"p{k}") for k in range(PIVOTS)]
            heads = some.groupBy("node", "tree", "size").agg(*pivots)
            heads = heads.select("node", "tree", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.array_distinct(F.array(*(F.col(f"p{k}.member") for k in range(PIVOTS)))).alias("pivots"))
            dealt = some.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(level), F.lit("chunk")), chunks).cast("int"))
            dealt = dealt.groupBy("node", "tree", "chunk").agg(F.collect_list(member).alias("members"))
            found.append(dealt.join(heads, ["node", "tree", "chunk"]).select("tree", F.array_union("pivots", "members").alias("members")))
        if level <= SPLIT:
            tokens = [F.struct(F.lit(k), F.element_at("rest", level + 1 + k)) for k in range(1 + (level == SPLIT))]
            rows = rows.withColumn("token", F.explode(F.array(*tokens)))
            rows = rows.select("rep", "n", "sig", "tree", F.xxhash64("node", "token").alias("node"), "rest")
    bands = rows.drop("size").withColumn("band", F.explode(F.expr(f"array({BAND}, {BAND} + 1)")))
    crowd = leaves_of(sized(cut(bands.withColumn("node", F.xxhash64("node", "band")).drop("band")))).select("node", "rep")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, crowd


def likely(found: DataFrame) -> DataFrame:
    """members (arrays of rep in order) of the parts of nodes that hang together by signature, each once, with its first tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, lists = b.column("tree").to_pylist(), b.column("members")
            ends, flat = lists.offsets.to_numpy(), lists.values
            reps, ns = flat.field("rep").to_numpy(), flat.field("n").to_numpy()
            sigs = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            out: list[tuple[int, list[int]]] = []
            for tree, a, z in zip(trees, ends, ends[1:], strict=False):
                sig, n, rep = sigs[a:z], ns[a:z], reps[a:z]
                near = (sig[:, None, :] == sig[None, :, :]).sum(axis=2) >= KEEP
                near &= 100 * np.minimum(n[:, None], n[None, :]) >= 80 * np.maximum(n[:, None], n[None, :])
                np.fill_diagonal(near, False)
                left = set(np.flatnonzero(near.any(axis=1)).tolist())
                while left:
                    part, edge = set(), [min(left)]
                    while edge:
                        x = edge.pop()
                        if x not in part:
                            part.add(x)
                            edge += np.flatnonzero(near[x]).tolist()
                    left -= part
                    out.append((tree, sorted({int(rep[x]) for x in part})))
            out = [x for x in out if len(x[1]) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["tree", "members"])

    return found.mapInArrow(run, "tree int, members array<bigint>").groupBy("members").agg(F.min("tree").alias("tree"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a similarity of 0.8 or more."""
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= 80 * (len(both) - same)


def confirm(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b between members of the same part with similarity 0.8 or more on full sets, enough to join all that are linked."""
    rows = parts.select("node", F.explode("members").alias("rep")).join(sets, "rep")
    groups = rows.groupBy("node").agg(F.collect_list(F.struct("rep", "shingles")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links: list[tuple[int, int]] = []
            for members in b.column("members"):
                reps = members.values.field("rep").to_pylist()
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.values.field("shingles")]

                links += [(reps[i], reps[j]) for i, j in joined(len(reps), lambda i, j, own=own: similar(own[i], own[j]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a bigint, b bigint")


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of sets fall into each bucket.

    Each task sums up its own rows, and hands on the buckets that occur by groups of TOGETHER; these are
    added up in two steps, so that no task gets a part from each of very many.
    """
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET, np.int64)
        for b in batches:
            for x in b.column("shingles"):
                np.add.at(n, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - BUCKET)).astype(np.int64), 1)
        yield packed({g: n[g * TOGETHER : (g + 1) * TOGETHER] for g in range((1 << BUCKET) // TOGETHER)})

    def packed(groups: dict[int, np.ndarray]) -> pa.RecordBatch:
        at = {g: np.flatnonzero(n) for g, n in groups.items()}
        full = [g for g in groups if len(at[g])]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([np.stack([at[g], groups[g][at[g]]]).tobytes() for g in full], pa.binary())], names=["together", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, parts in zip(b.column("together").to_pylist(), b.column("parts"), strict=True):
                n = np.zeros(TOGETHER, np.int64)
                for part in parts.values:
                    at, times = np.frombuffer(part.as_buffer(), np.int64).reshape(2, -1)
                    n[at] += times
                yield packed({g: n})

    got = sets.select("shingles").mapInArrow(own, "together int, part binary")
    for some in ([F.pmod(F.spark_partition_id(), F.lit(256))], []):
        lists = got.groupBy("together", *some).agg(F.collect_list("part").alias("parts"))
        got = lists.select("together", "parts").mapInArrow(added, "together int, part binary")
    out = np.zeros(1 << BUCKET, np.int64)
    with small_batches(sets.sparkSession, 16):
        for g, part in got.collect():  # of all buckets, 16 MB at most
            at, times = np.frombuffer(part, np.int64).reshape(2, -1)
            out[g * TOGETHER + at] = times
    return out


def proposed(sets: DataFrame) -> DataFrame:
    """Pairs a, b of the sets (rep, label, shingles) of different labels that may be similar: none that is similar is left out."""
    spark = sets.sparkSession
    sent = spark.sparkContext.broadcast(bucket_counts(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for b in batches:
            tokens, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x in b.column("shingles"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = common[(s >> np.uint64(64 - BUCKET)).astype(np.int64)]
                most = len(s) - -(-4 * len(s) // 5) + 1  # the least that a set of similarity 0.8 has in common
                first = np.lexsort((s, n))[:most]
                met = np.flatnonzero(n[first] > 1)
                tokens.append(s[first[met]].view(np.int64))
                places.append(met)
            sizes = np.array([len(x.as_buffer()) // 8 for x in b.column("shingles")], np.int64)
            times = [len(t) for t in tokens[1:]]
            flat, place = np.concatenate(tokens), np.concatenate(places)
            columns = [np.repeat(x, times) for x in (b.column("rep").to_numpy(), b.column("label").to_numpy(), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(flat), *map(pa.array, columns), pa.array(place)], names=["token", "rep", "label", "n", "place"])

    entries = cut(sets.select("rep", "label", "shingles").mapInArrow(prefixes, "token bigint, rep bigint, label bigint, n bigint, place bigint"))
    lists = entries.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
    rows = entries.join(lists.select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "token")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # every block meets every one
    member = F.struct("rep", "label", "n", "place", "block")
    met = rows.groupBy("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(member).alias("members"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("members")
            ends, flat = column.offsets.to_numpy(), column.values
            rep, label, n, place, block = (flat.field(k).to_numpy() for k in ("rep", "label", "n", "place", "block"))
            cross = b.column("low").to_numpy() != b.column("high").to_numpy()
            work = np.cumsum(np.diff(ends).astype(np.int64) ** 2)
            at = 0
            while at < len(work):
                stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 21), side="right")))
                e = ends[at : stop + 1]
                own = np.repeat(np.arange(at, stop), np.diff(e))
                times = np.repeat(e[1:], np.diff(e)) - np.arange(e[0], e[-1]) - 1
                x = np.repeat(np.arange(e[0], e[-1]), times)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
                ok = (label[x] != label[y]) & (~np.repeat(cross[own], times) | (block[x] != block[y]))
                x, y = x[ok], y[ok]
                ok = 9 * np.minimum(n[x] - place[x], n[y] - place[y]) >= 4 * (n[x] + n[y])
                ok &= 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
                x, y = rep[x[ok]], rep[y[ok]]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
                at = stop

    with small_batches(spark, 256):
        return cut(met.select("low", "high", "members").mapInArrow(pairs, "a bigint, b bigint").distinct())


def links_between(sets: DataFrame) -> DataFrame:
    """All links a, b between the sets (rep, label, shingles) of different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(k)] for k in ("x", "y"))
            ok = pa.array([similar(*s) for s in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    pairs = proposed(sets)
    full = lambda k, name: sets.select(F.col("rep").alias(k), F.col("shingles").alias(name))
    return pairs.join(full("a", "x"), "a").join(full("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def total_of(labels: DataFrame) -> object:
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """rep and label (the least rep reachable) of all ends of the edges a, b.

    Each round hooks every end onto its least neighbour, follows the hooks to their ends, and goes on
    with the edges that are left between those: their number falls by a large factor each time.
    """
    edges = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
        before, now = None, total_of(hooks)
        while before != now:  # hooks lead to smaller numbers, so they end
            further = hooks.where("rep != label").select(F.col("rep").alias("label"), F.col("label").alias("next"))
            hooks = cut(hooks.join(further, "label", "left").select("rep", F.coalesce("next", "label").alias("label")))
            before, now = now, total_of(hooks)
        labels = hooks if labels is None else cut(mapped(labels, "label", hooks))
        edges = cut(mapped(mapped(edges, "a", hooks), "b", hooks).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def mapped(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """rows with the column's numbers replaced by their labels, where they have one."""
    of = labels.where("rep != label").select(F.col("rep").alias(column), F.col("label").alias("mapped_to"))
    return rows.join(of, column, "left").withColumn(column, F.coalesce("mapped_to", column)).select(*rows.columns)


def contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (rep, label) with the components joined that the links a, b connect."""
    if labels is None:
        return components(links)
    further = cut(components(mapped(mapped(links, "a", labels), "b", labels)))
    return mapped(labels, "label", further).unionByName(further.join(labels, "rep", "left_anti"))


def split_still(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """node of the rows (node, rep) whose members aren't in one component."""
    label = mapped(rows.select("node", "rep").withColumn("label", F.col("rep")), "label", labels)
    return label.groupBy("node").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("node")


def linked(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """rep and label of the classes that have links: the least rep of their component."""
    spark = docs.sparkSession

    def meetings() -> DataFrame:
        found, crowd = nodes(classes)
        alone = crowd.select(F.array("rep").alias("members"), F.lit(TREES).alias("tree"), "node")
        return likely(found).withColumn("node", F.xxhash64("members")).unionByName(alone)

    with small_batches(spark, 1000):
        parts = settled(spark, meetings)
    crowd = parts.where(F.col("tree") == TREES).select("node", F.col("members")[0].alias("rep"))
    wanted = parts.select(F.explode("members").alias("rep")).distinct().join(classes.select("rep", "digest", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "rep")

    def start():
        hashes = Hashes()

        def work(texts: list[str]) -> dict[str, pa.Array]:
            sets = [shingle_set(t, words, hashes) for t in texts]
            return {"own": pa.array([digest(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}

        return work

    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["text_hash"] == wanted["hash"]))
    sets = map_texts(texts, ["rep", "digest"], start, "own binary, shingles binary").where("own = digest")
    sets = cut(sets.select("rep", "shingles")).dropDuplicates(["rep"])
    labels, low = None, 0
    for high in ROUNDS:
        some = parts.where((F.col("tree") >= low) & (F.col("tree") < high)).select("node", "members")
        if labels is not None:
            some = some.join(split_still(some.select("node", F.explode("members").alias("rep")), labels), "node", "left_semi")
        with small_batches(spark, 64):
            new = cut(confirm(some, sets))
        if labels is None or not new.isEmpty():
            labels = settled(spark, lambda old=labels, new=new: contracted(old, new))
        low = high
    crowd = cut(crowd.join(split_still(crowd, labels), "node", "left_semi").select("rep").distinct())
    if not crowd.isEmpty():
        crowded = mapped(sets.join(crowd, "rep").withColumn("label", F.col("rep")), "label", labels).select("rep", "label", "shingles")
        new = settled(spark, lambda: links_between(cut(crowded)))
        if not new.isEmpty():
            labels = settled(spark, lambda: contracted(labels, new))
    return labels


def judged(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row of docs.

    Classes are known by the number of their first row in the sketches, whatever doc_id says.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketches = cut(sketch(docs, words).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct("row", "doc_id", "text_hash", F.col("n_shingles").alias("n"), "path", "sig")).alias("x")
    classes = sketches.where("n_shingles > 0").groupBy("digest").agg(first, F.min("doc_id").alias("least_id"))  # min passes over nulls
    classes = cut(classes.select("digest", F.col("x.row").alias("rep"), "least_id", "x.doc_id", "x.text_hash", "x.n", "x.path", "x.sig"))
    labels = settled(docs.sparkSession, lambda: linked(docs, classes, words))
    of = classes.select("digest", "rep", "least_id").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    groups = of.groupBy("label").agg(F.min("least_id").alias("group_id"), F.min("rep").alias("first_row"))
    of = of.join(groups, "label").select("digest", "group_id", "first_row")
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "digest", "row").join(of, "digest", "left")
    component = F.when(F.col("first_row").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))
    kept = F.when(component.isNotNull(), F.col("doc_id").eqNullSafe(component)).otherwise(F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs; shingles have so many words."""
    return judged(docs, words).drop("text_hash")


def keep_one_of_near(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component those with the least doc_id, or one where none has a doc_id."""
    kept = settled(docs.sparkSession, lambda: judged(docs, words).where("kept").select("doc_id", "text_hash", F.expr("doc_id is null and n_shingles > 0").alias("single")).distinct())

    def those(rows: DataFrame, marked: DataFrame) -> DataFrame:
        return rows.join(marked, rows["doc_id"].eqNullSafe(marked["doc_id"]) & (F.xxhash64(rows["text"]) == marked["text_hash"]), "left_semi")

    nameless = those(docs.where("doc_id is null"), kept.where("single")).dropDuplicates(["text"])
    return those(docs, kept.where("not single")).unionByName(nameless)
