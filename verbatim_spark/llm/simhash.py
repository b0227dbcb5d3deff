"""SimHash near-duplicates by tiled exact comparison.

Each text becomes a 64-bit fingerprint: the majority of the bits of its word
shingles' XXH64. Distinct fingerprints are laid out in the order of the
population counts of their four 16-bit quarters and cut into tiles. The
quarters' counts of two fingerprints differ in sum by at most their Hamming
distance, so a pair of tiles whose ranges are further apart than the radius is
skipped; the others are compared exactly, with numpy's exclusive-or and bit
counts, again only where the counts of two runs of rows are near enough. A task
returns stars of what the links it finds connect, never all the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shipped, slices, text_bytes
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 32768
_BLOCK = 4096


def fingerprint_bytes(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts; None and texts without words give 0."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for at, text in enumerate(texts):
        found = (text or b"").translate(_LOWER).split()
        if not found:
            continue
        if len(found) <= shingle:
            hashes = [digest(b" ".join(found), seed)]
        else:
            line = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            starts = [0, *ends[: -shingle].tolist()]
            hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        out[at] = _majority(np.array(hashes, np.uint64))
    return out


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _majority(hashes: np.ndarray) -> np.uint64:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # as many ones as a byte can count
        part = hashes[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).view(">u8")[0].astype(np.uint64)


@shipped
def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) for every row; a null, empty or blank text has 0. The
    long holds the fingerprint's 64 bits, so it may be negative."""

    def run(batches):
        for batch in slices(batches):
            fp = fingerprint_bytes(text_bytes(batch.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def quarter_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Union-find over positions that remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def compare(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Stars (n x 2 fingerprints: one and the least of its component) that connect
    what the links between two tiles connect, or within one if ``right`` is None.
    Stars settle in fewer rounds than the links themselves would."""
    same = right is None
    a, keys_a, starts_a = _ordered(left)
    b, keys_b, starts_b = (a, keys_a, starts_a) if same else _ordered(right)
    forest = Forest(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    order_b = keys_b[:, 0] * 64 + keys_b[:, 1]
    for n, (p, q) in enumerate(keys_a.tolist()):
        for r in range(max(0, p - radius), min(32, p + radius) + 1):
            spare = radius - abs(p - r)
            first, last = np.searchsorted(order_b, [r * 64 + max(0, q - spare), r * 64 + min(32, q + spare) + 1])
            first = max(first, n) if same else first
            if first < last:
                _meet(forest, a, starts_a[n], starts_a[n + 1], b, starts_b[first], starts_b[last], shift, radius)
    if not forest.kept:
        return np.empty((0, 2), np.uint64)
    both = a if same else np.concatenate([a, b])
    met = np.unique(np.array(forest.kept))
    roots = np.array([forest.root(x) for x in met.tolist()])
    # Least as Spark compares them, as signed numbers.
    order = np.lexsort((both[met].view(np.int64), roots))
    first = np.concatenate([[True], roots[order][1:] != roots[order][:-1]])
    centre = both[met[order]][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return np.stack([both[met[order]], centre], axis=1)[~first]


def _ordered(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered by the population counts of their halves, the
    distinct pairs of counts, and where each begins (and the end)."""
    counts = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint32).reshape(-1, 2)).astype(np.int64)
    order = np.lexsort((counts[:, 1], counts[:, 0]))
    keys, starts = np.unique(counts[order], axis=0, return_index=True)
    return fp[order], keys, np.append(starts, len(fp))


def _meet(forest, a, a0, a1, b, b0, b1, shift, radius) -> None:
    for at in range(a0, a1, _BLOCK):
        rows = a[at : min(a1, at + _BLOCK), None]
        step = max(1, (1 << 18) // len(rows))
        for lo in range(b0, b1, step):
            hit = np.bitwise_count(rows ^ b[None, lo : min(b1, lo + step)]) <= radius
            if hit.any():
                for i, j in zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True):
                    forest.link(at + i, lo + j + shift)


@shipped
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    seed: int = SEED, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per row of docs: (doc_id, fp long, component_id).

    component_id is the least non-null id among the rows reachable over links of
    ``radius`` or fewer differing bits, null if they have none. Rows with equal
    texts, and all without words (fingerprint 0), are in one component. Repeated
    rows stay repeated; an empty table gives an empty result; other columns of
    docs are not looked at.
    """
    rows = keep(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    # A hot group of copies is reduced to one row before anything is shuffled.
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = keep(nodes, "nodes")
    roots = components(links(nodes.select("fp"), radius, tile))
    named = (
        nodes.join(roots, nodes["fp"] == roots["node"], "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = keep(named.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of
    all pairs within the radius. The driver sees one line of ranges a tile."""
    spark = fps.sparkSession
    n = fps.count()
    parts = max(1, -(-n // tile))
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"q{k}") for k in range(4)]
    laid = fps.select("fp", *quarters)
    if parts > 1:
        laid = laid.repartitionByRange(parts, "q0", "q1", "q2", "q3", "fp")

    def cut(batches):
        held = [np.concatenate([b["fp"].to_numpy() for b in group]) for group in _grouped(batches, tile)]
        for fp in held:
            fp = fp.view(np.uint64)
            q = quarter_counts(fp)
            yield pd.DataFrame({"fps": [fp.tobytes()], "low": [q.min(axis=0).tolist()], "high": [q.max(axis=0).tolist()]})

    tiles = laid.mapInPandas(cut, "fps binary, low array<int>, high array<int>")
    tiles = keep(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    ranges = tiles.select("tile", "low", "high").orderBy("tile").toPandas()
    if ranges.empty:
        return spark.createDataFrame([], "a bigint, b bigint")
    ids = ranges["tile"].to_numpy()
    low, high = np.stack(ranges["low"].to_numpy()), np.stack(ranges["high"].to_numpy())
    sent = spark.sparkContext.broadcast((ids, low, high))

    def deal(batches):
        ids, low, high = sent.value
        for batch in batches:
            for key, fp in zip(batch["tile"], batch["fps"], strict=True):
                at = int(np.searchsorted(ids, key))
                gap = np.maximum(0, np.maximum(low - high[at], low[at] - high)).sum(axis=1)
                other = ids[gap <= radius]
                yield pd.DataFrame({"i": np.minimum(other, key), "j": np.maximum(other, key), "tile": key, "fps": [fp] * len(other)})

    def meet(key, group):
        group = group.sort_values("tile")
        sides = [np.frombuffer(x, np.uint64) for x in group["fps"]]
        found = compare(sides[0], sides[1] if len(sides) > 1 else None, radius).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    dealt = tiles.select("tile", "fps").mapInPandas(deal, "i bigint, j bigint, tile bigint, fps binary")
    return dealt.groupBy("i", "j").applyInPandas(meet, "a bigint, b bigint")


def _grouped(batches, most: int):
    """Batches, put together until a tile is full."""
    group, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), most):
            part = batch.iloc[at : at + most]
            if size and size + len(part) > 2 * most:
                yield group
                group, size = [], 0
            group.append(part)
            size += len(part)
    if size:
        yield group


def fingerprint_hex(fp):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
