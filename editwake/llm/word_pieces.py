"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest piece at each place of a word,
first pieces at its start and others further on. The automaton does this without
going back: the pieces form a trie, and each of its nodes has a failure link to
where matching goes on when no child fits, and the number of pieces that are
complete by then. These popped counts are computed once; counting the pieces of
a word adds them up on the way, and no piece is ever built.

A word for which no pieces fit counts as one unknown token. Words are runs of
letters and digits, other visible characters are words of their own; whole texts
are read. Null and empty texts have no tokens. Repeated rows come out alike.
"""

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from editwake.llm.common import Memo, held, prepare

WORD = re.compile(r"\w+|[^\w\s]")
NONE = -1


class Automaton:
    """The trie of first and further pieces, with failure links and popped counts."""

    def __init__(self, first: frozenset[str], further: frozenset[str]):
        self.start, self.inside = 0, 1
        self.children: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((self.start, first), (self.inside, further)):
            for text in pieces:
                node = root
                for c in text:
                    found = self.children[node].get(c)
                    if found is None:
                        found = self.children[node][c] = len(self.children)
                        self.children.append({})
                        piece.append(False)
                    node = found
                piece[node] = piece[node] or bool(text)
        self.link = [NONE] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque([self.start, self.inside])
        while queue:
            node = queue.popleft()
            for c, child in self.children[node].items():
                queue.append(child)
                if piece[child]:
                    self.link[child], self.popped[child] = self.inside, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at != NONE and c not in self.children[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at != NONE:
                    self.link[child], self.popped[child] = self.children[at][c], count
        self.memo = Memo(self.count)

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if no pieces fit."""
        node, count = self.start, 0
        for c in word:
            while c not in self.children[node]:
                count += self.popped[node]
                node = self.link[node]
                if node == NONE:
                    return 0
            node = self.children[node][c]
        while node != self.inside:
            count += self.popped[node]
            node = self.link[node]
            if node == NONE:
                return 0
        return count

    def counts(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        memo = self.memo
        words = WORD.findall(text)
        found = [memo[word] for word in words]
        unknown = found.count(0)
        return len(words), sum(found) + unknown, unknown


def automaton_of(pieces: tuple[str, ...], mark: str) -> Automaton:
    """The automaton, built once in each worker; first pieces carry the mark."""
    first = frozenset(p[len(mark) :] for p in pieces if p.startswith(mark)) - {""}
    further = frozenset(p for p in pieces if not p.startswith(mark)) - {""}
    return held(("automaton", pieces, mark), lambda: Automaton(first, further))


def marked_pieces(model_path: str) -> tuple[str, ...]:
    """The ordinary pieces of a SentencePiece model, whose word starts carry a mark."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    return tuple(p.piece for p in proto.pieces if p.type == 1)


def token_counts(
    docs: DataFrame, pieces: tuple[str, ...], mark: str = "▁", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: the id, ``n_words``, ``n_tokens`` and ``n_unknown``.

    The vocabulary, which has a fixed size, is sent to the workers.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = automaton_of(sent.value, mark)
        for batch in batches:
            found = [automaton.counts(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_tokens", "n_unknown"])

    schema = f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
