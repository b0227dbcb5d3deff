"""Token counts by trie-shared dynamic programming.

A text's pre-tokens (chunks that begin at whitespace markers) are segmented by a
unigram model: the pieces of a public vocabulary with costs by their rank, and
bytes for characters without a piece. A worker inserts each distinct pre-token
in a trie; a node holds the least cost, and the number of tokens, of the prefix
that it stands for, so a prefix that many pre-tokens share is computed once, and
a pre-token's count is read at its last node.

Costs are integers, so equal sums are equal; of equally cheap segmentations the
one with fewer tokens counts.
"""

from __future__ import annotations

import math

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices
from .pieces import MARK, cut

#: Nodes, and terminal counts, that a worker holds at most; then it begins anew, to
#: no other result.
MOST_NODES = 600_000
#: Longer pre-tokens are segmented with a sliding window instead of nodes.
LONGEST = 200
_SCALE = 1_000_000


def unigram_costs(model: str) -> tuple[dict[str, int], int]:
    """Costs of a vocabulary's pieces and of one byte. A piece of rank r is taken
    as having a probability in proportion to 1 / (r + 10) (Zipf's law); a byte
    costs as much as a piece ten times as rare as the last."""
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    normal = [
        i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))
    ]
    normal.sort(key=lambda i: (-p.get_score(i), i))
    cost = lambda rank: round(_SCALE * math.log(rank + 10))
    return {p.id_to_piece(i): cost(rank) for rank, i in enumerate(normal)}, cost(10 * len(normal))


#: A cost and a number of tokens are held as one integer, cost << _SHIFT | tokens:
#: sums add both, and the least is the cheapest with the fewest tokens.
_SHIFT = 40


class Trie:
    def __init__(self, costs: dict[str, int], byte_cost: int, most_nodes: int = MOST_NODES):
        self.costs = {piece: (cost << _SHIFT) + 1 for piece, cost in costs.items()}
        self.byte_cost, self.most = (byte_cost << _SHIFT) + 1, most_nodes
        self.longest = max(map(len, costs), default=1)
        ends: dict[str, set[int]] = {}
        for piece in costs:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        #: By last two characters, the lengths that pieces have.
        self.sizes = {pair: sorted(n) for pair, n in ends.items()}
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: Child of a node by a character: key node << 21 | code point.
        self.child: dict[int, int] = {}
        self.best: list[int] = [0]

    def _single(self, char: str) -> int:
        own = self.costs.get(char)
        return len(char.encode()) * self.byte_cost if own is None else own

    def count(self, token: str) -> int:
        """The number of tokens of one pre-token."""
        found = self.terminal.get(token)
        if found is None:
            found = self._insert(token) if len(token) <= LONGEST else self._slide(token)
        return found

    def _insert(self, token: str) -> int:
        if len(self.best) > self.most:
            self.clear()
        if len(self.terminal) > self.most:
            self.terminal.clear()
        child, best, costs, at = self.child, self.best, self.costs, 0
        scores = [0]  # of the prefixes along the path
        for end, char in enumerate(token, 1):
            key = at << 21 | ord(char)
            at = child.get(key)
            if at is None:
                at = child[key] = len(best)
                least = scores[-1] + self._single(char)
                for n in self.sizes.get(token[max(0, end - 2) : end], ()):
                    if n > end:
                        break
                    own = costs.get(token[end - n : end])
                    if own is not None and scores[-n] + own < least:
                        least = scores[-n] + own
                best.append(least)
            scores.append(best[at])
        found = self.terminal[token] = scores[-1] & ((1 << _SHIFT) - 1)
        return found

    def _slide(self, token: str) -> int:
        """The same over the last few prefixes only."""
        scores = [0]
        for end, char in enumerate(token, 1):
            least = scores[-1] + self._single(char)
            for n in self.sizes.get(token[max(0, end - 2) : end], ()):
                if n <= end and (own := self.costs.get(token[end - n : end])) is not None:
                    least = min(least, scores[-n] + own)
            scores.append(least)
            del scores[: -self.longest]
        return scores[-1] & ((1 << _SHIFT) - 1)


def pre_tokens(text: str) -> list[str]:
    return [MARK + c.replace(" ", MARK) for c in cut(text)] if text else []


@shipped
def count(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) per row; null and empty texts have none.

    There is no shuffle: each worker keeps a trie for the texts it meets."""
    sent = docs.sparkSession.sparkContext.broadcast(unigram_costs(model))  # as large as the vocabulary

    def run(batches):
        trie = Trie(*sent.value)
        for batch in slices(batches, most=8 << 20):
            n, total = [], []
            for text in batch.column(1).to_pylist():
                found = pre_tokens(text)
                n.append(len(found))
                total.append(sum(map(trie.count, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_pre_tokens bigint, n_tokens bigint")
