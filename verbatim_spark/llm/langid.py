"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes is counted from
labelled texts and frozen. The code length of a byte after its context is that
of the longest context that has seen the byte, plus the escapes of the longer
contexts that have not (method C: a context with t symbols seen n times gives a
symbol count/(n + t) and the escape t/(n + t); below order 0 all 256 bytes are
equal). A context starts at a word's beginning, so a word's length doesn't
depend on its neighbours, and each distinct word is scored once a batch.

Since statistics are frozen, each (context, byte) pair that any language has
seen gets its whole code length for every language in advance, escapes
included; scoring is then table lookups in numpy.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices, text_bytes, words

ORDER = 4
#: The bound of what is learned from: about so many texts a language, whole, chosen
#: by a hash of the text.
SAMPLE = 600
#: Longer words are scored in pieces of so many bytes.
PIECE = 64
UNDETERMINED = "und"
_EMPTY = np.uint64(0)


def word_bytes(text: bytes) -> list[bytes]:
    """Words without their digits, each with a blank before and after it."""
    return [b" " + w + b" " for w in words(text.translate(_NO_DIGITS))]


_NO_DIGITS = bytes(32 if 48 <= b <= 57 else b for b in range(256))


def count_grams(texts: list[bytes], order: int = ORDER) -> Counter:
    """Counts of (context + byte) strings of 1 to order + 1 bytes; the blank
    before a word is context only."""
    seen = Counter()
    for text in texts:
        seen.update(word_bytes(text))
    grams: Counter = Counter()
    for word, n in seen.items():
        for end in range(2, len(word) + 1):
            for start in range(max(0, end - order - 1), end):
                grams[word[start:end]] += n
    return grams


class Model:
    """Frozen code lengths in bits of all grams that some language has seen."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        contexts: list[dict[bytes, list[int]]] = []
        for lang in self.langs:
            totals: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
            for gram, n in counts[lang].items():
                entry = totals[gram[:-1]]
                entry[0] += n
                entry[1] += 1
            contexts.append(totals)
        self._escape = lambda i, context: (
            math.log2((sum(e) / e[1])) if (e := contexts[i].get(context)) else 0.0
        )
        grams = sorted(set().union(*map(set, counts.values())), key=len)
        lengths: dict[bytes, tuple[float, ...]] = {b"": (8.0,) * len(self.langs)}
        for gram in grams:
            # A gram's suffixes were seen wherever it was, and are shorter.
            lower = lengths[gram[1:]] if len(gram) > 1 else lengths[b""]
            row = []
            for i, lang in enumerate(self.langs):
                n = counts[lang].get(gram)
                if n:
                    row.append(math.log2(sum(contexts[i][gram[:-1]]) / n))
                else:
                    row.append(self._escape(i, gram[:-1]) + lower[i])
            lengths[gram] = tuple(row)
        del lengths[b""]
        self.lengths = _Lookup(lengths, len(self.langs))
        every = sorted(set().union(*map(set, contexts)) - {b""}, key=len)
        self.escapes = _Lookup({c: tuple(self._escape(i, c) for i in range(len(self.langs))) for c in every}, len(self.langs))
        self.bottom = np.array([self._escape(i, b"") + 8.0 for i in range(len(self.langs))], np.float32)
        del self._escape

    def word_lengths(self, distinct: list[bytes]) -> np.ndarray:
        """Bits of each word (with its blanks) in each language."""
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        flat = np.frombuffer(b"".join(distinct), np.uint8).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begin = np.repeat(starts, sizes)
        at = np.arange(len(flat))
        coded = at > begin
        left = np.zeros((len(flat), len(self.langs)), np.float32)
        # packed[k]: the k + 1 bytes that end here, and their number on top.
        packed = [flat + np.uint64(1 << 56)]
        for k in range(1, self.order + 1):
            before = np.zeros_like(flat)
            before[k:] = flat[:-k]
            packed.append((packed[-1] & np.uint64((1 << 56) - 1)) + (before << np.uint64(8 * k)) + np.uint64((k + 1) << 56))
        open_ = np.flatnonzero(coded)
        for k in range(self.order, -1, -1):
            mine = open_[at[open_] - begin[open_] >= k] if k else open_
            hit = self.lengths.find(packed[k][mine])
            left[mine[hit >= 0]] += self.lengths.values[hit[hit >= 0]]
            missed = mine[hit < 0]
            if k:
                context = self.escapes.find(packed[k - 1][missed - 1])
                left[missed[context >= 0]] += self.escapes.values[context[context >= 0]]
                done = np.zeros(len(flat), bool)
                done[mine[hit >= 0]] = True
                open_ = open_[~done[open_]]
            else:
                left[missed] += self.bottom
        return np.add.reduceat(left, starts, axis=0)

    def text_lengths(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and the bytes that were coded."""
        number: dict[bytes, int] = {}
        index, ends = [], [0]
        for text in texts:
            found = words(text.translate(_NO_DIGITS)) if text else []
            index += [number.setdefault(w, len(number)) for w in found]
            ends.append(len(index))
        out, coded = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not number:
            return out, coded
        lengths = self._distinct(list(number))
        size = np.fromiter((len(w) + 1 for w in number), np.int64, len(number))
        index = np.array(index, np.int64)
        for at, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                out[at] = lengths[index[a:b]].sum(axis=0, dtype=np.float64)
                coded[at] = size[index[a:b]].sum()
        return out, coded

    def _distinct(self, distinct: list[bytes]) -> np.ndarray:
        """Bits of distinct words; long ones in pieces that keep their context."""
        parts, owner = [], []
        for n, word in enumerate(distinct):
            whole = b" " + word + b" "
            if len(whole) <= PIECE:
                parts.append(whole)
                owner.append(n)
            else:
                for at in range(0, len(whole) - self.order, PIECE - self.order):
                    parts.append(whole[at : at + PIECE])
                    owner.append(n)
        bits = np.zeros((len(parts), len(self.langs)))
        for at in range(0, len(parts), 1 << 15):
            bits[at : at + (1 << 15)] = self._pieces(parts[at : at + (1 << 15)], owner[at : at + (1 << 15)], owner[at - 1] if at else -1)
        out = np.zeros((len(distinct), len(self.langs)))
        np.add.at(out, np.array(owner), bits)
        return out

    def _pieces(self, parts, owner, last):
        """Code lengths; a piece that continues a word gives no length to the
        bytes of context that it repeats."""
        whole = self.word_lengths(parts)
        before = [last, *owner[:-1]]
        again = [n for n, (a, b) in enumerate(zip(before, owner, strict=True)) if a == b]
        if again:
            whole[again] -= self.word_lengths([parts[n][: self.order] for n in again])
        return whole


class _Lookup:
    """Packed byte strings -> rows of values, by open addressing in numpy."""

    def __init__(self, rows: dict[bytes, tuple[float, ...]], width: int):
        self.bits = max(4, (4 * len(rows) + 1).bit_length())
        self.values = np.array(list(rows.values()), np.float32).reshape(len(rows), width)
        keys = np.array([int.from_bytes(k, "big") + (len(k) << 56) for k in rows], np.uint64)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.row = np.full(1 << self.bits, -1, np.int64)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            _, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.row[slot[put]] = keys[put], put
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            if not len(todo):
                break
            there = self.keys[slot[todo]]
            same = there == keys[todo]
            out[todo[same]] = self.row[slot[todo[same]]]
            todo = todo[~same & (there != _EMPTY)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


@shipped
def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` distinct texts a language, of any length: those
    whose hash lies below the language's share. Copies of a text are chosen together
    and count once; null and empty texts and null languages are left out."""
    source = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    source = source.dropna().where("text <> ''")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    counted = source.groupBy("lang").agg(F.count("*").alias("n"))
    shares = F.broadcast(counted.select("lang", (F.lit(float(sample)) / F.col("n")).alias("share")))  # a row a language
    chosen = source.join(shares, "lang").where(place < F.col("share")).select("lang", "text").distinct()

    def run(batches):
        counts = defaultdict(Counter)
        for batch in slices(batches, most=4 << 20):
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                counts[lang].update(count_grams([text], order))
        for lang, grams in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(list(grams), pa.binary()), pa.array(list(grams.values()), pa.int64())],
                ["lang", "gram", "n"],
            )

    rows = chosen.mapInArrow(run, "lang string, gram binary, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The sample's bound bounds these rows.
    table = rows.toArrow()
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, gram, n in zip(*(table.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[lang][gram] = n
    return Model(counts, order)


@shipped
def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, [keep_cols,] lang_pred, score, bits_per_byte).

    lang_pred is the language with the least code length (the first in order of
    names if several have it), score its share of the likelihood if all were
    equally likely before, bits_per_byte its code length. A null text, one without
    a letter, and any text if no language was learned are ``und`` with score 0.
    Repeated rows each get theirs; long texts are scored whole, word by distinct
    word; columns not asked for aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kept = list(keep_cols or [])

    def run(batches):
        model = sent.value
        for batch in slices(batches, most=4 << 20):
            bits, coded = model.text_lengths(text_bytes(batch.column(1)))
            letter = np.array(batch.column(2).to_pylist(), bool)
            if model.langs:
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                ok = letter & (coded > 0)
                names = np.where(ok, np.array(model.langs, object)[best], UNDETERMINED)
                rate = np.where(ok, least / np.maximum(coded, 1), 0.0)
                score = np.where(ok, score, 0.0)
            else:
                names, score, rate = [UNDETERMINED] * len(bits), np.zeros(len(bits)), np.zeros(len(bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[3:], pa.array(list(names), pa.string()), pa.array(score), pa.array(rate)],
                ["doc_id", *kept, "lang_pred", "score", "bits_per_byte"],
            )

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), letter.alias("_letter"), *[F.col(c).alias(c) for c in kept])
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return source.mapInArrow(
        run,
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, {fields + ', ' if fields else ''}lang_pred string, score double, bits_per_byte double",
    )
