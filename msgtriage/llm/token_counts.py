"""Token counts under a unigram model, by dynamic programming over a trie.

A vocabulary gives pieces and scores (log-probabilities). The tokens of a
pre-token are the pieces of its best segmentation: the largest sum of scores,
then the fewest pieces. A character that no piece covers stands for itself, as
one token per UTF-8 byte, at ``BYTE_SCORE`` each.

The forward score of a prefix depends on that prefix alone. So the distinct
pre-tokens go into a trie whose nodes are prefixes; a node's best score and
number of tokens are computed once, from the nodes above it, whichever
pre-tokens share it, and a pre-token's count is read off its last node.

Pre-tokens are words with the white space before them as one mark, as in the
vocabulary. Counting moves no rows: every task keeps one trie and drops it when
it has ``MAX_NODES`` nodes, which bounds memory and changes no count. Null text
is an empty text; it has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import sentencepiece
from pyspark.sql import Column, functions as F

MARK = "▁"
BYTE_SCORE = -20.0
MAX_NODES = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    #: Piece to score. Scores are sums of a few terms, so equal segmentations compare equal.
    scores: dict[str, float]

    @staticmethod
    def from_sentencepiece(path: str) -> Vocabulary:
        """The ordinary pieces of a model file.

        A model of merges has ranks for scores; a piece's probability is then
        taken as inversely proportional to its rank.
        """
        import math

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        plain.sort(key=model.get_score, reverse=True)
        norm = math.log(sum(1 / (k + 2) for k in range(len(plain))))
        return Vocabulary({model.id_to_piece(i): round(-math.log(k + 2) - norm, 6) for k, i in enumerate(plain)})


class Trie:
    """Prefixes of pre-tokens with their forward scores.

    A node is a number. ``children`` maps (node, character) to a node; the path to
    a node is kept while one walks down, so nodes need not store their text.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        #: Counts of pre-tokens seen, by their last node.
        self.terminal: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        """The number of tokens of a pre-token; adds its missing prefixes."""
        known = self.terminal.get(pre_token)
        if known is not None:
            return known
        if len(self.best) > MAX_NODES:
            self.clear()
        children, best, tokens, scores = self.children, self.best, self.tokens, self.scores
        path = [0]
        node = 0
        for i, character in enumerate(pre_token):
            below = children.get((node, character))
            if below is None:
                below = len(best)
                children[node, character] = below
                width = len(character.encode("utf-8", "surrogatepass"))
                top, fewest = best[node] + BYTE_SCORE * width, tokens[node] + width
                for start in range(max(0, i + 1 - self.longest), i + 1):
                    score = scores.get(pre_token[start:i + 1])
                    if score is not None:
                        above = path[start]
                        value = best[above] + score
                        if value > top or value == top and tokens[above] + 1 < fewest:
                            top, fewest = value, tokens[above] + 1
                best.append(top)
                tokens.append(fewest)
            node = below
            path.append(node)
        found = tokens[node]
        # A very long pre-token has nodes of its own only; they need not be kept.
        if len(pre_token) <= 256:
            self.terminal[pre_token] = found
        elif len(best) > MAX_NODES:
            self.clear()
        return found


def pre_tokens(text: str) -> list[str]:
    return [MARK + word for word in text.split()]


def counter(vocabulary: Vocabulary):
    """A column function: text to struct<n_pretokens, n_tokens>."""

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(vocabulary.scores)
        for texts in batches:
            rows = []
            for text in texts:
                found = pre_tokens(text or "")
                known = trie.terminal.get
                rows.append((len(found), sum([known(p) or trie.count(p) for p in found])))
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"], dtype="int64")

    def apply(text: Column) -> Column:
        return count(text)

    return apply
