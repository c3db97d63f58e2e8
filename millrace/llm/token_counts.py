"""Tokens of texts under a unigram model, counted by dynamic programming over a trie of pre-tokens.

The best segmentation of a pre-token's first bytes is the same for all pre-tokens that begin with them. So the
distinct pre-tokens of a task are put into a trie whose nodes hold the best score of the bytes down to them and the
tokens of that segmentation; each node is computed once, and a text's count is a sum over its pre-tokens' ends.
"""

from __future__ import annotations

import base64
import math

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import add_columns, raw_text

#: A public vocabulary: base64 of each token and its rank. Not part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern of pre-tokens that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Trie nodes that a task holds before it starts a new trie.
NODES = 1_000_000
#: Pre-tokens of more bytes than this are computed by themselves and held nowhere.
LONG = 256


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Log-probabilities of the tokens. The file ranks tokens but tells no frequencies, so they follow Zipf's law:
    the token of rank r has weight 1 / (r + 1)."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    whole = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - whole for token, r in ranks.items()}


def suffix_trie(scores: dict[bytes, float]) -> dict:
    """The tokens from their last byte to their first, as nested dicts; a token's score is under the key -1."""
    root: dict = {}
    for token, score in scores.items():
        node = root
        for byte in reversed(token):
            node = node.setdefault(byte, {})
        node[-1] = score
    return root


class Trie:
    """Nodes of bytes: the child of a node for each byte, the best score of the path down to it, and its number of
    tokens. Of equally good segmentations the one with fewer tokens counts."""

    def __init__(self, suffixes: dict):
        self.suffixes = suffixes
        self.children: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def step(self, word: bytes, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """The best score and its tokens for the first ``end`` bytes, from those of fewer bytes. A byte that is no
        token itself counts as one, at a score below any token's."""
        top, least = best[end - 1] - 50.0, tokens[end - 1] + 1
        node, start = self.suffixes, end
        while start:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            score = node.get(-1)
            if score is not None:
                score += best[start]
                if score > top or (score == top and tokens[start] + 1 < least):
                    top, least = score, tokens[start] + 1
        return top, least

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token, which is put into the trie; nodes that are there already are not computed anew."""
        best, tokens = [0.0], [0]
        if len(word) > LONG:
            for end in range(1, len(word) + 1):
                top, n = self.step(word, end, best, tokens)
                best.append(top)
                tokens.append(n)
            return tokens[-1]
        node = 0
        for end, byte in enumerate(word, 1):
            edge = node << 8 | byte
            node = self.children.get(edge)
            if node is None:
                top, n = self.step(word, end, best, tokens)
                node = self.children[edge] = len(self.best)
                self.best.append(top)
                self.tokens.append(n)
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        return tokens[-1]


class Counts(dict):
    """Tokens of each pre-token: the ends of a trie. Both start anew when the trie holds ``NODES`` nodes."""

    def __init__(self, scores: dict[bytes, float]):
        super().__init__()
        self.trie = Trie(suffix_trie(scores))

    def __missing__(self, word: str) -> int:
        if len(self.trie.best) >= NODES:
            self.clear()
            self.trie = Trie(self.trie.suffixes)
        raw = word.encode("utf-8", "surrogatepass")
        n = self.trie.count(raw)
        if len(raw) <= LONG:
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id, ``n_pretokens`` and ``n_tokens`` of its best segmentation.

    A null or empty text has none. Null ids stay null; repeated rows are each counted; ties go to fewer tokens.
    Whole texts are read however long; an empty table gives no rows; other columns are ignored, whatever their
    names. ``vocabulary`` is read by the driver and sent to the tasks; its size is fixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        counts, pattern = Counts(sent.value), regex.compile(PATTERN)

        def of(texts: list[bytes]) -> list:
            n_words, n_tokens = [], []
            for raw in texts:
                words = pattern.findall(raw.decode("utf-8", "replace"))
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            return [n_words, n_tokens]

        return of

    return add_columns(docs, {id_col: F.col(id_col)}, [raw_text(text_col)], make, "n_pretokens bigint, n_tokens bigint")
