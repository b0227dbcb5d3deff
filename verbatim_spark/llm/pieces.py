"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next one.
If no piece of the model has a marker after another character, merges never
cross a chunk's start, so the ids of a text are those of its chunks in order.
Each distinct chunk is segmented once by the library and its ids are joined back
by position. The table lives in a Python worker and is emptied at a bound, which
changes no result.
"""

from __future__ import annotations

import contextlib
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices

MARK = "▁"
#: Chunks and characters of them that a worker holds at most.
MOST_CHUNKS = 200_000
MOST_CHARS = 4_000_000
#: Chunks given to the library in one call.
_GROUP = 128
_CHUNK = re.compile(" +[^ ]*")


def public_model() -> str:
    """The path of the public BPE model with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut(text: str) -> list[str]:
    """The chunks of a text, each without its first marker: the library puts one
    before a text, so that is also what gives the chunk's ids."""
    text = text.replace(MARK, " ")
    if text[0] == " " or "  " in text:
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ")


class ChunkTable:
    """Ids and decoded bytes of chunks for one model."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.plain = np.array([not (self.processor.is_control(i) or self.processor.is_unknown(i)) for i in range(len(pieces))])
        probe = "  a  b   ﬁ "
        if self.processor.decode(self.processor.encode(probe)) != probe:
            raise ValueError("this model normalises its input; its chunks can't be told from the text")
        self.ids: dict[str, bytes] = {}
        self.chars = 0

    def add(self, chunks: list[str]) -> None:
        """Segments chunks that aren't known yet."""
        if len(self.ids) + len(chunks) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.ids.clear()
            self.chars = 0
        plain = [c for c in chunks if c and c[0] != " "]
        for at in range(0, len(plain), _GROUP):
            self._add_plain(plain[at : at + _GROUP])
        if len(plain) < len(chunks):
            for chunk in chunks:
                if not chunk:  # a lone marker; to the library it is an empty text, without ids
                    self.ids[chunk] = np.array([self.processor.piece_to_id(MARK)], np.int32).tobytes()
                elif chunk[0] == " ":
                    self.ids[chunk] = np.array(self.processor.encode(chunk), np.int32).tobytes()
        self.chars += sum(map(len, chunks))

    def _add_plain(self, chunks: list[str]) -> None:
        """Chunks with one marker, put in a row for the library: each begins at
        the one piece that has its marker."""
        flat = np.array(self.processor.encode(" ".join(chunks)), np.int32)
        cuts = [*np.flatnonzero(self.marked[flat]).tolist(), len(flat)]
        data = flat.tobytes()
        for chunk, a, b in zip(chunks, cuts[:-1], cuts[1:], strict=True):
            self.ids[chunk] = data[4 * a : 4 * b]

    @property
    def _lone(self) -> list[int]:
        return [self.processor.piece_to_id(MARK)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets at which each text begins."""
        parts, offsets, at = [], [0], 0
        for text in texts:
            if text:
                chunks = cut(text)
                new = set(chunks).difference(self.ids)
                if new:
                    was = len(self.ids)
                    self.add(list(new))
                    if len(self.ids) < was:  # emptied: known chunks went too
                        self.add(list(set(chunks).difference(self.ids)))
                joined = b"".join([self.ids[c] for c in chunks])
                at += len(joined) // 4
                parts.append(joined)
            offsets.append(at)
        return np.frombuffer(b"".join(parts), np.int32), np.array(offsets, np.int64)

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each id but control and unknown ones adds to a text, in UTF-8."""
        pieces = map(self.processor.id_to_piece, range(self.processor.get_piece_size()))
        return [
            bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, markers as spaces, the first one
        dropped, bytes put together. Ids that encoding never gives for a text
        (control and unknown ones, bytes that are no UTF-8) are left to the library."""
        if not len(ids):
            return ""
        if self.plain[ids].all():
            surfaces = self.surfaces
            data = b"".join([surfaces[i] for i in ids.tolist()])
            with contextlib.suppress(UnicodeDecodeError):
                return (data[1:] if self.marked[ids[0]] else data).decode()
        return self.processor.decode(ids.tolist())


@lru_cache(maxsize=2)
def _table(name: str) -> ChunkTable:
    with open(SparkFiles.get(name), "rb") as file:
        return ChunkTable(file.read())


def _sent(docs: DataFrame, model: str) -> str:
    """Sends the model file to the executors once; its size is fixed."""
    context = docs.sparkSession.sparkContext
    name = model.rsplit("/", 1)[-1]
    if name not in {f.rsplit("/", 1)[-1] for f in context.listFiles}:
        context.addFile(model)
    return name


@shipped
def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row: the library's ids, without begin or end.
    A null text is encoded as an empty one, to no ids."""
    name = _sent(docs, model)

    def run(batches):
        for batch in slices(batches, most=4 << 20):
            flat, offsets = _table(name).encode(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


@shipped
def decode(encoded: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded`` to a table with ``ids``; null ids decode to null."""
    name = _sent(encoded, model)
    source = encoded.select(*(keep or [c for c in encoded.columns if c != "decoded"]))
    names = source.columns
    at = names.index("ids")

    def run(batches):
        for batch in slices(batches, at, most=4 << 20):
            column = batch.column(at)
            table, flat, offsets = _table(name), column.values.to_numpy(), column.offsets.to_numpy()
            texts = [
                table.decode(flat[a:b]) if ok else None
                for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, decoded string")
