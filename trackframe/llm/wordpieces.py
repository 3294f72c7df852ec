"""Greedy word-piece counts by a linear-time longest-match automaton.

A trie of the vocabulary gets failure links: where the next character has no
edge, the link of node v leads to the node that has read the rest of v's string
after its longest-match pieces are cut off, and a number stored at v says how
many pieces that popped. One pass over a word then gives the number of pieces
that greedy longest-match-first makes of it; no piece is ever built.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import small_batches

#: Words are runs of letters, digits and underscores, and single other characters.
WORD = re.compile(r"\w+|[^\w\s]")
MEMO = 500_000


class Automaton:
    """Counts the pieces of words.

    ``first`` are the pieces that begin a word, ``rest`` those that continue it.
    With ``bare`` a word that none of ``first`` begins has a piece for its beginning
    alone, and all of it is cut by ``rest``. A word that greedy matching can't cut
    counts as one unknown piece.
    """

    def __init__(self, first: Iterable[str], rest: Iterable[str], bare: bool = False):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0: the word's start, 1: after a piece
        self.is_piece = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                if piece:
                    self._add(root, piece)
        self.fail: list[int] = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        if bare:
            self.fail[0], self.popped[0] = 1, 1
        self._link()
        self.memo: dict[str, int] = {}

    def _add(self, node: int, piece: str) -> None:
        for c in piece:
            after = self.edges[node].get(c)
            if after is None:
                after = self.edges[node][c] = len(self.edges)
                self.edges.append({})
                self.is_piece.append(False)
            node = after
        self.is_piece[node] = True

    def _link(self) -> None:
        level = [0, 1]
        while level:  # breadth first: links of shorter strings come first
            below = []
            for parent in level:
                for c, node in self.edges[parent].items():
                    below.append(node)
                    if self.is_piece[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    z, n = self.fail[parent], self.popped[parent]
                    while z >= 0 and c not in self.edges[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[node], self.popped[node] = self.edges[z][c], n
            level = below

    def count(self, word: str) -> int:
        """The number of pieces of a word, 0 of the empty one, -1 if it can't be cut."""
        node, n = 0, 0
        for c in word:
            after = self.edges[node].get(c)
            while after is None:
                n += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return -1
                after = self.edges[node].get(c)
            node = after
        while node > 1:  # the end of the word pops what is left
            n += self.popped[node]
            node = self.fail[node]
        return n if node == 1 or not word else -1

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, pieces, unknown words) of a whole text (null: empty)."""
        words, pieces, unknown, memo = WORD.findall(text or ""), 0, 0, self.memo
        for word in words:
            n = memo.get(word)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = memo[word] = self.count(word.encode("utf-8", "surrogatepass").decode("latin-1"))
            if n < 0:
                unknown += 1
                n = 1
            pieces += n
        return len(words), pieces, unknown


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> Automaton:
    """The automaton of a file of base64 tokens and ranks: those with a leading space begin a word.

    Where none fits, the space alone does: the file has all single bytes, so every word can be cut.
    """
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]).decode("latin-1") for line in lines]
    return Automaton((t[1:] for t in tokens if t[0] == " "), (t for t in tokens if t[0] != " "), bare=" " in tokens)


def piece_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_pieces, n_unknown) of every row's whole text; a map without shuffle.

    Null and empty texts have zeros; unknown words count one piece. Null ids and
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, n_pieces long, n_unknown long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = byte_vocabulary(path)
        for texts in batches:
            yield pd.DataFrame([automaton.text(t) for t in texts], columns=["n_words", "n_pieces", "n_unknown"])

    return docs.select(F.col(id_col).alias("id"), count(text_col).alias("n")).select("id", "n.*")
