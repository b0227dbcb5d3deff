"""A quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives each document a place on a
line; ordered thresholds cut the line into grades. P(grade > k) is the logistic
function of the place less threshold k, so expected grades and tail
probabilities come from the same shared weights.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices, text_bytes, words

BITS = 18
#: The bound of what is learned from: about so many rated rows, of whole texts, chosen
#: by a hash of their ids.
SAMPLE = 6000
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_BEGINNINGS = [(n, bytes([1, n])) for n in (4, 5, 6)]
#: Distinct words whose weights a worker remembers.
_MOST_KNOWN = 500_000


@functools.lru_cache(maxsize=1 << 17)
def shape(token: bytes) -> bytes:
    """A token's kinds of characters without repeats: ``b"Ab***"`` gives ``b"Aa*"``."""
    kinds = token.translate(_SHAPE)
    return bytes(b for i, b in enumerate(kinds[:16]) if i == 0 or kinds[i - 1] != b)


def place_of(feature: bytes, bits: int = BITS) -> int:
    return zlib.crc32(feature) & ((1 << bits) - 1)


def features(text: bytes | None) -> dict[bytes, float]:
    """Presence of each word, of each beginning of words (of 4, 5 and 6 bytes), of
    each shape by the fifth of the tokens that have it, and of the tenths of tokens
    and lines that are not repeats."""
    if not text:
        return {}
    out = dict.fromkeys(words(text), 1.0)
    whole = list(out)
    for n, mark in _BEGINNINGS:
        out.update(dict.fromkeys({mark + w[:n] for w in whole if len(w) > n}, 1.0))
    tokens, lines = text.split(), text.split(b"\n")
    for kind, n in Counter(map(shape, tokens)).items():
        out[b"\x00%d" % (5 * n // len(tokens)) + kind] = 1.0
    out[b"\x02%d" % (10 * len(set(tokens)) // max(len(tokens), 1))] = 1.0
    out[b"\x03%d" % (10 * len(set(lines)) // len(lines))] = 1.0
    return out


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, place: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - place[:, None], -60, 60)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, bits: int = BITS, epochs: int = 40,
        rate: float = 0.05, decay: float = 2e-4, batch: int = 64, least_share: float = 0.004, least_z: float = 5.0, seed: int = 0) -> Model:
    """Adam, slowing down, on the mean negative log-likelihood of (grade, places, values) rows;
    rarer grades weigh more, by the root of their share. Features of under
    ``least_share`` of the rows are left out, since they would be learned by heart,
    and so are those whose rows' grades aren't off the mean by ``least_z``
    standard errors: else what every text has would add up with its length."""
    rng = np.random.default_rng(seed)
    size = 1 << bits
    rows = _telling(rows, size, least_share, least_z)
    w, m, v = (np.zeros(size, np.float32) for _ in range(3))
    first, gaps = 0.0, np.zeros(max(grades - 2, 0))  # threshold k + 1 = threshold k + exp(gap)
    tm, tv = np.zeros(grades - 1), np.zeros(grades - 1)
    grade = np.array([r[0] for r in rows], np.int64)
    share = np.bincount(grade, minlength=grades) / max(len(rows), 1)
    weigh = np.where(share > 0, 1 / np.sqrt(np.maximum(share, 1e-9)), 0)
    step, steps = 0, max(1, epochs * -(-len(rows) // batch))
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = [rows[i] for i in order[at : at + batch]]
            grad, t_grad = gradients(w, first, gaps, pick, weigh / len(pick), grades)
            grad = grad.astype(np.float32) + decay * w
            step += 1
            slow = rate * (1 - (step - 1) / steps)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            w -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            tm += 0.1 * (t_grad - tm)
            tv += 0.01 * (t_grad * t_grad - tv)
            move = slow * (tm / (1 - 0.9**step)) / (np.sqrt(tv / (1 - 0.99**step)) + 1e-6)
            first -= move[0]
            gaps = np.clip(gaps - move[1:], -6, 3)
    return Model(w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def gradients(w: np.ndarray, first: float, gaps: np.ndarray, rows, weigh: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sum over (grade, places, values) rows of the negative log-likelihood,
    weighed by grade: for the weights, and for the first threshold and the
    logarithms of the gaps between thresholds."""
    sizes = np.array([len(r[1]) for r in rows])
    where, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    place = np.bincount(owner, weights=w[where] * value, minlength=len(rows))
    cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), [np.inf]])
    g = np.array([r[0] for r in rows], np.int64)
    above = 1 / (1 + np.exp(np.clip(cuts[g] - place, -60, 60)))  # P(y >= g)
    beyond = 1 / (1 + np.exp(np.clip(cuts[g + 1] - place, -60, 60)))  # P(y > g)
    prob = np.maximum(above - beyond, 1e-9)
    up, down = above * (1 - above) / prob, beyond * (1 - beyond) / prob
    push = -(up - down) * weigh[g]
    # Thresholds: the lower one of a row lowers, the upper one raises its probability.
    by_cut = np.bincount(g, weights=up * weigh[g], minlength=grades)[1:] - np.bincount(g, weights=down * weigh[g], minlength=grades)[:-1]
    tail = np.cumsum(by_cut[::-1])[::-1]
    return np.bincount(where, weights=value * push[owner], minlength=len(w)), np.concatenate([[tail[0]], tail[1:] * np.exp(gaps)])


def _telling(rows, size: int, least_share: float, least_z: float):
    """The rows with only those features that tell something of the grade."""
    if not rows:
        return rows
    grade = np.array([g for g, _, _ in rows], float)
    held, total = np.zeros(size), np.zeros(size)
    for g, where, _ in rows:
        each = np.unique(where)
        held[each] += 1
        total[each] += g
    n = np.maximum(held, 1)
    z = np.abs(total / n - grade.mean()) * np.sqrt(n) / max(float(grade.std()), 1e-9)
    good = (held >= max(3, least_share * len(rows))) & (z >= least_z)
    return [(g, where[mine], value[mine]) for g, where, value in rows for mine in [good[where]]]


@shipped
def learn(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """A model from about ``sample`` rated rows. Rows without id, text or grade are
    left out; of several ratings of an id the least counts, and each of several
    texts of an id is learned with it, in order of their hashes. The sample's bound
    also bounds what is broadcast and what the driver gets: a row a text, with an
    entry for each distinct word and beginning of a word."""
    rated = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade"))
    rated = rated.dropna().where(F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.broadcast(rated.where(place < sample / max(n, 1)))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.where("text IS NOT NULL").join(chosen, "doc_id").select("doc_id", "text", "grade", F.xxhash64("text").alias("h"))

    def run(batches):
        for batch in slices(batches):
            found = [features(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()), batch.column(3), batch.column(2),
                    pa.array([[place_of(k, bits) for k in f] for f in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.float32())),
                ],
                ["id", "h", "grade", "places", "vals"],
            )

    got = source.mapInArrow(run, "id string, h bigint, grade int, places array<int>, vals array<float>").toArrow().sort_by([("id", "ascending"), ("h", "ascending")])
    if not got.num_rows:
        return fit([], grades, bits)
    places, values = (got.column(c).combine_chunks() for c in ("places", "vals"))
    ends = places.offsets.to_numpy()
    flat, weight = places.values.to_numpy(), values.values.to_numpy()  # views, not lists
    rows = [(g, flat[a:b], weight[a:b]) for g, a, b in zip(got.column("grade").to_pylist(), ends[:-1], ends[1:], strict=True)]
    return fit(rows, grades, bits)


@shipped
def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tails array<double>) per row; tails[k] is
    P(grade > k). Null and empty texts are at place 0 of the line. Repeated rows each
    get theirs; long texts are read whole; other columns are not looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    bits = int(model.weights.size).bit_length() - 1

    def run(batches):
        model, known = sent.value, {}
        weights = model.weights.astype(float)
        for batch in slices(batches):
            place = np.zeros(batch.num_rows)
            for at, text in enumerate(text_bytes(batch.column(1))):
                total = 0.0
                for k, v in features(text).items():
                    x = known.get(k)
                    if x is None:
                        if len(known) > _MOST_KNOWN:
                            known.clear()
                        x = known[k] = weights[place_of(k, bits)]
                    total += x * v
                place[at] = total
            tails = model.tails(place)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64()))],
                ["doc_id", "expected_grade", "tails"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, expected_grade double, tails array<double>")
