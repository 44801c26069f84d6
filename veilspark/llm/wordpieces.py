"""Token counts by the linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import FirstSeen

WORD = r"[^\W_]+|[^\w\s]|_"


class PieceCounter:
    """Counts the pieces of greedy longest-match-first splitting in one pass over a word.

    The trie has one root for pieces that begin a word and one for those that continue it.  A failure link leads from a
    node to where matching goes on once the longest pieces of its string are taken off, and ``popped`` is how many
    pieces that takes off, so pieces are counted and never built.
    """

    def __init__(self, first: list[str], later: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.edges[node].get(c)
                    if nxt is None:
                        nxt = self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                    node = nxt
                if piece:
                    ends.add(node)
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.edges[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, taken = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.edges[at]:
                    taken += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.edges[at][c], taken

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the word cannot be split."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = n = 0
        for c in word:
            while True:
                nxt = edges[node].get(c)
                if nxt is not None:
                    node = nxt
                    break
                if fail[node] < 0:
                    return 0
                n += popped[node]
                node = fail[node]
        while node != 1:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n


def vocabulary(model_file: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, from a SentencePiece file: the word mark tells them apart."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if "▁" not in p]


def _count(first: list[str], later: list[str]):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_tokens", "n_unknown")])

    def run(batches):
        automaton = PieceCounter(first, later)
        find, memo = re.compile(WORD).findall, FirstSeen(automaton.count)
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for text in batch.column(1).to_pylist():
                counts = list(map(memo.__getitem__, find(text))) if text else []
                unknown = counts.count(0)
                out[0].append(len(counts)), out[1].append(sum(counts) + unknown), out[2].append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.int64()) for o in out)], schema=schema)

    return run


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of each whole text.

    Words are runs of letters and digits; any other visible character is a word of its own.  A word that the vocabulary cannot split counts as
    one token, the unknown one.  Null and empty texts have zero words; repeated rows give repeated rows and a null id
    stays null.  Other columns are not read; an empty table gives an empty result.
    """
    first, later = vocabulary(model_file)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(first, later), "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
