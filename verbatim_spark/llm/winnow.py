"""Document fingerprints by winnowing, in DataFrame functions alone.

Each word is hashed once. A k-gram's hash is the polynomial in its words' hashes,
modulo a prime, and is rolled: all k-grams of a text grow together by one word a
step, from the hashes of the k-grams one word shorter. Each window of ``window``
consecutive k-grams keeps its least hash, the rightmost of equal ones, with its
place. Two texts that share window + k - 1 consecutive words share a fingerprint
entry.

A hash and its place are packed into one long: the hash's 33 bits, then 30 bits
that fall as the place rises, so the least long is the rightmost least hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import lower_ascii

K = 5
WINDOW = 4
#: The modulus (the largest prime under 2**33) and the base, under 2**29: products fit in a long.
PRIME = 2**33 - 9
BASE = 433_494_437
_PLACES = 30
_LAST = (1 << _PLACES) - 1
#: Rows of one range of ids that are ordered together, and the most ranges.
RANGE_ROWS = 512
MOST_RANGES = 1 << 14
_FAN = 128


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def packed(words: Column, k: int = K, window: int = WINDOW) -> Column:
    """The kept k-grams of an array of words, packed, in order of place. Fewer
    than k words are one k-gram, fewer k-grams than a window one window."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    return let(words, lambda w: F.when(F.size(w) > 0, _packed(w, k, window)).otherwise(F.array().cast("array<bigint>")))


def _packed(words: Column, k: int, window: int) -> Column:
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    placed = F.transform(let(hashed, lambda h: rolled(h, k)), lambda g, i: F.shiftleft(g, _PLACES).bitwiseOR(F.lit(_LAST) - i.cast("bigint")))

    def windows(grams):
        least, step = grams, 1
        while step < window:  # least of 2, 4, ... neighbours; past the end there is none
            least = let(least, _least_of_two(step))
            step *= 2
        return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(grams) - (window - 1), F.lit(1))))

    return let(placed, windows)


def rolled(hashes: Column, k: int) -> Column:
    """Hashes of the runs of k words; fewer words are one run."""
    step = lambda a, x: (a * BASE + x) % PRIME
    n = F.greatest(F.size(hashes) - (k - 1), F.lit(0))
    grams = F.slice(hashes, F.lit(1), n)
    for at in range(1, k):
        grams = F.zip_with(grams, F.slice(hashes, F.lit(at + 1), n), step)
    return F.when(F.size(hashes) >= k, grams).otherwise(F.array(F.aggregate(hashes, F.lit(0).cast("bigint"), step)))


def _least_of_two(step: int):
    return lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.least(a, b))


def entries(fp: Column) -> Column:
    """array<struct<hash, place>> of a packed fingerprint; places are words from 0."""
    return F.transform(fp, lambda x: F.struct(_hash(x).alias("hash"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int").alias("place")))


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, _PLACES)


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, _hash))


def shown(fp: Column) -> Column:
    """hash:place in hexadecimal and decimal, comma-joined."""
    return F.concat_ws(",", F.transform(entries(fp), lambda x: F.concat_ws(":", F.lower(F.hex(x["hash"])), x["place"])))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""

    def of(x):
        common = F.size(F.array_intersect(x["a"], x["b"]))
        return F.coalesce(common / F.nullif(F.size(x["a"]) + F.size(x["b"]) - common, F.lit(0)), F.lit(1.0))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, entries array<struct<hash, place>>) per row; null and empty texts,
    and those without words, have no entries."""
    words = word_array(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), entries(packed(words, k, window)).alias("entries"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, part, ghost, key, h): every row once with ghost false, laid
    out so that ``lead`` over (part, ghost, key descending, h) gives each row
    the next one in descending doc_id, and the first one after the last.

    Ids (integers; null counts as less than all) and, among rows with equal ids,
    hashes of their texts put the rows in order. The order is cut into ranges at its
    quantiles, so that a range may also begin inside the rows of one id. Only each
    range's last place goes to the driver, one a range; the rows that have it are
    put at the end of the range above as well, and those of the last of all at the
    end of the lowest range. Rows that repeat one id and text can't be told apart
    and share a range, where they follow each other. Null texts count as empty; an
    empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, low, high = source.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    low, high = (low, high) if low is not None else (1, 1)
    least = max(-(2**63), low - 1)
    keyed = source.withColumn("key", F.coalesce("doc_id", F.lit(least).cast("bigint"))).withColumn("h", F.xxhash64("text"))
    # A hash's upper bits follow the id if they fit; they order as the whole hash does.
    bits = min(16, max(0, 62 - max(abs(least), abs(high)).bit_length()))
    within = F.lit((1 << bits) - 1) - (F.shiftright("h", 64 - bits) + (1 << bits >> 1)) if bits else F.lit(0)
    keyed = keyed.withColumn("o", F.col("key") * (1 << bits) + within)
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    at = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("o", at, 10 * max(ranges, 1000))).first()[0] or [])) if at and n else []
    part = _range_of(F.col("o"), cuts)
    heads = sorted(keyed.groupBy(part.alias("part")).agg(F.max("o").alias("o")).collect())
    ghosts = [(heads[i]["o"], heads[(i + 1) % len(heads)]["part"]) for i in range(len(heads))]
    spread = F.broadcast(docs.sparkSession.createDataFrame(ghosts, "o bigint, ghost_part int"))  # at most MOST_RANGES rows
    return (
        keyed.join(spread, "o", "left")
        .withColumn("where", F.explode(F.filter(
            F.array(F.struct(part.alias("part"), F.lit(False).alias("ghost")), F.struct(F.col("ghost_part").alias("part"), F.lit(True).alias("ghost"))),
            lambda x: x["part"].isNotNull(),
        )))
        .select("doc_id", "text", "where.part", "where.ghost", "key", "h")
    )


def _range_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts not above the key, found in two steps."""
    count = lambda values: F.size(F.filter(values, lambda c: c <= key))
    listed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    if len(cuts) <= _FAN:
        return count(listed(cuts))
    rows = [cuts[i : i + _FAN] for i in range(0, len(cuts), _FAN)]
    row = count(listed([r[0] for r in rows]))
    inner = F.element_at(F.array(*[listed(r) for r in rows]), F.greatest(row, F.lit(1)))
    return F.when(row == 0, 0).otherwise((row - 1) * _FAN + count(inner)).cast("int")
