"""Masked pseudo-likelihood scores from a bidirectional window network.

Each word is predicted from the two words before and the two after it, by a small
network in numpy with a hierarchical softmax. The leaves of its tree are the most
frequent words, each with an embedding of its own, and one leaf for the rest of
each class of endings; every inner node has a vector that meets the context, and
starts from the counts below it. A word of such a rest has the leaf's probability
times its share of the rest, from its count in the whole corpus: the counts of the
more frequent ones go to every worker, the others stay in a table and are joined
in by key. Each rest has one more count, for words that the corpus lacks. A
document's score is the sum of its words' conditional log-probabilities.

Four passes: word counts; coding of the texts as leaves; training; scoring. Training
takes each distinct coded text once, weighed by its number of copies. The texts are
dealt to shards by a hash of what they hold, a shard is trained in order of that
hash, and the shards of a round begin with the same network and are averaged, each
row of parameters by how often each shard used it. So a score depends on the rows
of a table, not on the files or partitions in which they come.
"""

from __future__ import annotations

import heapq
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, shipped, slices, text_bytes, words

ENDINGS = 256
#: Most words with leaves of their own, and most other words whose counts every worker holds.
VOCABULARY = 16_384
HELD = 262_144
SIDE = 2
WIDTH = 8
HIDDEN = 24
BATCH = 8192
RATE = 0.02
#: Words of a shard, the most shards, and how often their networks are averaged.
SHARD = 2_000_000
MOST_SHARDS = 4096
ROUNDS = 2
#: Words of a shard that are mixed before they make batches.
BLOCK = 1 << 18
#: Parameters of a network that are averaged together.
CHUNK = 4096
#: Distinct words that a worker counts before it hands them on.
_MOST_KNOWN = 500_000


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) over all texts; counted in workers before the shuffle."""

    def run(batches):
        seen: dict[bytes, int] = {}

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()

        get = seen.get
        for batch in slices(batches, 0):
            for text in text_bytes(batch.column(0)):
                if text:
                    for word in words(text):
                        seen[word] = get(word, 0) + 1
                if len(seen) > _MOST_KNOWN:
                    yield from out()
        yield from out()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """Words with leaves, most frequent first; then words whose counts are held."""

    words: list[bytes]
    counts: np.ndarray
    leaves: int  # so many of the words have leaves
    rests: np.ndarray  # counts of the words of each class without leaves


def vocabulary(counts: DataFrame, size: int = VOCABULARY, held: int = HELD) -> Vocabulary:
    """From whole-corpus counts. A word's count decides alone, so words of about one
    count are in or out together: a histogram of counts, of a bounded number of
    rows, tells from which count on there are at most ``size`` words, or ``held``.
    The driver gets those words and a row a class."""
    # Single counts up to 16, then sixteenths of an octave.
    step = F.when(F.col("n") <= 16, F.col("n") * 16).otherwise(F.floor(F.log2("n") * 16) + 256)
    histogram = sorted(((r["b"], r["k"]) for r in counts.groupBy(step.cast("int").alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    cuts = []
    for most in (size, size + held):
        cut, total = None, 0
        for b, k in histogram:
            total += k
            if total > most:
                break
            cut = b
        cuts.append(cut)
    inner = F.lit(False) if cuts[0] is None else step >= cuts[0]
    outer = F.lit(False) if cuts[1] is None else step >= cuts[1]
    got = counts.where(outer).select("word", "n", inner.alias("leaf")).toArrow()
    rows = sorted(zip(got["leaf"].to_pylist(), got["n"].to_pylist(), got["word"].to_pylist(), strict=True), key=lambda r: (not r[0], -r[1], r[2]))
    tail = F.when(F.octet_length("word") <= 3, F.col("word")).otherwise(F.expr("substring(word, octet_length(word) - 2, 3)"))
    rests = np.zeros(ENDINGS)
    for r in counts.where(~inner).groupBy((F.crc32(tail) % ENDINGS).cast("int").alias("c")).agg(F.sum("n").alias("n")).collect():
        rests[r["c"]] = r["n"]
    return Vocabulary([w for _, _, w in rows], np.array([n for _, n, _ in rows], float), sum(leaf for leaf, _, _ in rows), rests)


class Tree(NamedTuple):
    """A Huffman tree; leaves are words, then the rests of the classes of endings."""

    leaves: int  # of words
    starts: np.ndarray  # where each leaf's path begins in nodes and signs
    sizes: np.ndarray  # the length of each leaf's path
    nodes: np.ndarray
    signs: np.ndarray  # 1 to the right, -1 to the left
    base: np.ndarray  # log of the counts to the right over those to the left, of each node


def tree(v: Vocabulary) -> Tree:
    # One more for each rest: a class always leaves mass for words never seen.
    weights = v.counts[: v.leaves].tolist() + (v.rests + 1).tolist()
    n = len(weights)
    heap = [(x, i) for i, x in enumerate(weights)]
    heapq.heapify(heap)
    parent, side, base = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.float32), np.zeros(n - 1, np.float32)
    for k in range(n - 1):
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[a, b]], side[[a, b]], base[k] = n + k, (-1, 1), math.log(y / x)
        heapq.heappush(heap, (x + y, n + k))
    at, steps = np.arange(n), []
    while (parent[at] >= 0).any():
        steps.append((parent[at] - n, side[at]))
        at = np.where(parent[at] >= 0, parent[at], at)
    nodes, signs = (np.stack(x, axis=1) for x in zip(*steps, strict=True))
    on = nodes >= 0
    sizes = on.sum(axis=1)
    return Tree(v.leaves, np.cumsum(sizes) - sizes, sizes, nodes[on], signs[on], base)


class _Places(dict):
    """Words to their place in the vocabulary; others to a negative class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - ending_class(word)


class Coder:
    """Texts to leaves, and to what the words of rests add to the score."""

    def __init__(self, v: Vocabulary):
        self.places, self.leaves = _Places({w: i for i, w in enumerate(v.words)}), v.leaves
        held = np.array([ending_class(w) for w in v.words[v.leaves :]], np.int64)
        per_rest = -np.log(v.rests + 1)
        # By place, then by class from the end: the leaf, and the log of the share of
        # the rest (of one occurrence, for words whose count is not held).
        self.leaf = np.concatenate([np.arange(v.leaves), v.leaves + held, v.leaves + np.arange(ENDINGS)[::-1]]).astype(np.uint16)
        self.share = np.concatenate([np.zeros(v.leaves), per_rest[held] + np.log(v.counts[v.leaves :]), per_rest[::-1]])

    def code(self, text: bytes | None) -> tuple[np.ndarray, float, list[bytes]]:
        """The leaves of a text's words, the sum of their shares, and the words
        whose counts are not held."""
        if not text:
            return np.empty(0, np.uint16), 0.0, []
        found = words(text)
        place = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        rare = [found[i] for i in np.flatnonzero(place < 0).tolist()]
        return self.leaf.take(place, mode="wrap"), float(self.share.take(place, mode="wrap").sum()), rare


_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def padded(texts: list[np.ndarray], padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Coded texts one after the other with SIDE paddings around each, and the
    places of their words."""
    gap = np.full(SIDE, padding, np.uint16)
    flat = np.concatenate([gap] + [x for t in texts for x in (t, gap)])
    return flat, np.flatnonzero(flat != padding)


class Network:
    """Embeddings of the words around, one hidden layer, a vector for each node."""

    def __init__(self, tree: Tree, flat: np.ndarray | None = None, seed: int = 0):
        self.tree, n = tree, len(tree.sizes)
        self.padding = n
        self.shapes = [(n + 1, WIDTH), (len(_OFFSETS) * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, WIDTH), (n - 1, WIDTH)]
        self.cuts = np.cumsum([math.prod(x) for x in self.shapes])[:-1]
        if flat is None:
            rng = np.random.default_rng(seed)
            spread = [1 / math.sqrt(WIDTH), 1 / math.sqrt(self.shapes[1][0]), 0, 1 / math.sqrt(HIDDEN), 0]
            flat = np.concatenate([rng.normal(0, x, math.prod(shape)) for x, shape in zip(spread, self.shapes, strict=True)])
        # Views of one vector, which steps change in place.
        self.flat = flat.astype(np.float32)
        self.parts = [p.reshape(s) for p, s in zip(np.split(self.flat, self.cuts), self.shapes, strict=True)]
        self.m, self.v, self.step = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def forward(self, flat: np.ndarray, at: np.ndarray):
        """With a column for each node on the way to each word: its logit, sign and more."""
        e, w1, b1, w2, v = self.parts
        around = np.stack([flat.take(at + o) for o in _OFFSETS], axis=1).reshape(-1)
        x = e.take(around, axis=0).reshape(len(at), -1)
        h = np.tanh(x @ w1 + b1)
        t, leaf = self.tree, flat.take(at)
        sizes = t.sizes.take(leaf)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        owner = np.repeat(np.arange(len(at)), sizes)
        step = np.arange(ends[-1]) + (t.starts.take(leaf) - starts).take(owner)
        node, sign = t.nodes.take(step), t.signs.take(step)
        g = np.ascontiguousarray((h @ w2).take(owner, axis=0).T)
        u = np.ascontiguousarray(v.take(node, axis=0).T)
        z = sign * ((g * u).sum(axis=0) + t.base.take(node))
        return around, x, h, g, u, node, sign, owner, starts, z

    def logs(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of each word's leaf, given the words around it."""
        out = np.empty(len(at))
        for lo in range(0, len(at), BATCH):
            *_, starts, z = self.forward(flat, at[lo : lo + BATCH])
            # One logarithm a word, of the product over its path of 1 + exp(-z).
            odds = 1 + np.exp(np.minimum(-z, 30)).astype(float)
            out[lo : lo + BATCH] = -np.log(np.multiply.reduceat(odds, starts))
        return out

    def train(self, flat: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        """One pass of Adam over weighed words, in an order that mixes the texts."""
        order = np.random.default_rng(len(at)).permutation(len(at))
        for lo in range(0, len(at), BATCH):
            pick = order[lo : lo + BATCH]
            self._update(flat, at[pick], weight[pick] / weight[pick].sum())

    def _update(self, flat: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        _, w1, _, w2, _ = self.parts
        around, x, h, g, u, node, sign, owner, starts, z = self.forward(flat, at)
        r = (-sign * weight.astype(np.float32).take(owner)) / (1 + np.exp(np.minimum(z, 60)))
        g *= r
        u *= r
        dg = np.add.reduceat(u, starts, axis=1).T
        dh = (dg @ w2.T) * (1 - h * h)
        dx = np.ascontiguousarray((dh @ w1.T).reshape(-1, WIDTH).T)
        total = lambda rows, d, n: np.stack([np.bincount(rows, weights=d[k], minlength=n) for k in range(WIDTH)], axis=1)
        de, dv = total(around, dx, self.shapes[0][0]), total(node, g, self.shapes[4][0])
        grad = np.concatenate([d.reshape(-1) for d in (de, x.T @ dh, dh.sum(0), h.T @ dg, dv)]).astype(np.float32)
        self.step += 1
        self.m += np.float32(0.1) * (grad - self.m)
        grad *= grad
        self.v += np.float32(0.01) * (grad - self.v)
        scale = np.sqrt(self.v / np.float32(1 - 0.99**self.step)) + np.float32(1e-8)
        self.flat -= np.float32(RATE / (1 - 0.9**self.step)) * self.m / scale

    def used(self, seen: np.ndarray) -> np.ndarray:
        """How often each parameter was used, from how often each leaf was met."""
        t = self.tree
        passed = np.bincount(t.nodes, weights=np.repeat(seen, t.sizes), minlength=len(t.base))
        dense = self.cuts[3] - self.cuts[0]
        return np.concatenate([np.repeat(np.append(seen, seen.sum()), WIDTH), np.full(dense, seen.sum()), np.repeat(passed, WIDTH)])


def code(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, codes, share, rare) for each row of docs; ``row`` is a number
    of its own, codes the leaves as 16-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = Coder(sent.value)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, most=8 << 20):
            codes, share, rare = zip(*map(coder.code, text_bytes(batch.column(1))), strict=True)
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(share, pa.float64()), pa.array(rare, pa.list_(pa.binary()))],
                ["row", "doc_id", "codes", "share", "rare"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"row bigint, doc_id {kind}, codes binary, share double, rare array<binary>")


def train(coded: DataFrame, plan, n_words: int, shard_words: int = SHARD, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters trained on all coded texts, in rounds of shards. A round's
    networks are added up by chunks in the cluster; the driver gets one network. A
    lost task is run again on the same rows. ``plan`` is the tree, sent to workers."""
    spark = coded.sparkSession
    size = max(shard_words, -(-n_words // MOST_SHARDS))
    shards = max(1, -(-n_words // size))
    rounds = min(rounds, shards)
    distinct = coded.where(F.octet_length("codes") > 0).groupBy("codes").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("codes"))
    dealt = distinct.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    dealt = keep(dealt, "shards")
    flat = Network(plan.value).flat
    for turn in range(rounds):
        begun = spark.sparkContext.broadcast(flat)  # a few numbers a word of the vocabulary
        mine = dealt.where(F.col("shard") % rounds == turn).repartitionById(-(-shards // rounds), F.floor(F.col("shard") / rounds).cast("int"))
        mine = mine.sortWithinPartitions("shard", "h", "codes")
        nets = keep(mine.select("shard", "n", "codes").mapInArrow(_trainer(plan, begun), "shard int, k bigint, n binary, x binary"), "networks")
        got = sorted(nets.groupBy("k").applyInArrow(_mean, "k bigint, x binary").collect(), key=lambda r: r["k"])
        if got:
            flat = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32)
        drop(nets)
    drop(dealt)
    return flat


def _trainer(plan, begun):
    """Trains a network for each shard of a partition, ordered by shard."""

    def run(batches):
        tree, held, size, now = plan.value, [], 0, None
        net, seen = None, None

        def learn():
            nonlocal size, seen
            flat, at = padded([c for c, _ in held], net.padding)
            weight = np.repeat([float(n) for _, n in held], [len(c) for c, _ in held])
            net.train(flat, at, weight)
            seen += np.bincount(flat[at], weights=weight, minlength=len(seen))
            held.clear()
            size = 0

        def done():
            if held:
                learn()
            # A parameter that no shard used stays as it began.
            n = net.used(seen) + 1e-3
            at = range(0, len(n), CHUNK)
            cut = lambda x: pa.array([x[k : k + CHUNK].astype(np.float32).tobytes() for k in at], pa.binary())
            shard = pa.array([now] * len(at), pa.int32())
            return pa.RecordBatch.from_arrays([shard, pa.array(list(at), pa.int64()), cut(n), cut(net.flat)], ["shard", "k", "n", "x"])

        for batch in batches:
            for shard, n, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    if net is not None:
                        yield done()
                    net, seen, now = Network(tree, begun.value), np.zeros(len(tree.sizes)), shard
                held.append((np.frombuffer(codes, np.uint16), n))
                size += len(codes) // 2
                if size >= BLOCK:
                    learn()
        if net is not None:
            yield done()

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """Means of one chunk's parameters over at most MOST_SHARDS shards, added up in their order."""
    total = weight = 0
    for row in rows.sort_by("shard").select(["n", "x"]).to_batches(max_chunksize=256):
        for n, x in zip(row.column(0), row.column(1), strict=True):
            n = np.frombuffer(n.as_py(), np.float32).astype(float)
            total, weight = total + n * np.frombuffer(x.as_py(), np.float32), weight + n
    return pa.table({"k": rows["k"][:1], "x": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})


@shipped
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = VOCABULARY, held: int = HELD, shard_words: int = SHARD) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, log_likelihood, per_word).

    log_likelihood is the sum over the words of log p(word | two words on either
    side), in nats; per_word its mean, null without words. Null and empty texts
    have no words and a sum of 0. Counts and training cover all of docs. Repeated
    rows each get theirs and count as copies; an empty table gives an empty result.
    A text of any length is one row of 16-bit codes; only that row must fit in memory."""
    spark = docs.sparkSession
    counts = keep(count_words(docs, text_col), "words")
    known = vocabulary(counts, size, held)
    sent = spark.sparkContext.broadcast(known)  # at most ``size`` and ``held`` words
    plan = spark.sparkContext.broadcast(tree(known))
    coded = keep(code(docs, sent, id_col, text_col), "coded")
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    net = spark.sparkContext.broadcast(train(coded.select("codes"), plan, n_words, shard_words))
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        network = Network(plan.value, net.value)
        for batch in slices(batches, 2, most=4 << 20):
            texts = [np.frombuffer(c, np.uint16) for c in batch.column(2).to_pylist()]
            flat, at = padded(texts, network.padding)
            total = np.concatenate([[0.0], np.cumsum(network.logs(flat, at))])
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            own = total[ends] - total[ends - sizes] + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(own)], ["row", "doc_id", "n_words", "log_likelihood"])

    rows = coded.select("row", "doc_id", "codes", "share").mapInArrow(run, f"row bigint, doc_id {kind}, n_words bigint, log_likelihood double")
    # A word that is not in the table has a count of 1, which adds nothing.
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts.where("n > 1"), "word")
    sums = rare.groupBy("row").agg(F.round(F.sum(F.log("n")), 9).alias("more"))
    whole = rows.join(sums, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return whole.select("doc_id", "n_words", "log_likelihood", mean.alias("per_word"))
