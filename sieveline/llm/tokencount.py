"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

The best segmentation of a prefix does not depend on what follows it, so the distinct pre-tokens of
a task stand in a trie and each node computes the forward score of its prefix once: the best sum of
piece scores that ends there, and the pieces it takes. A pre-token's count is stored where it ends,
and a document's count is the sum over its pre-tokens. Nothing is shuffled; a trie that exceeds
``MAX_NODES`` is begun anew, which changes no count.

A pre-token is a run without ASCII white space, with the word mark in front. Pieces are those of a
public vocabulary; their scores are a Zipf estimate from their rank, -log(rank + 2), unless others are
given. A character that no piece holds counts one token for each of its UTF-8 bytes, each worth less
than any piece. Of segmentations with equal scores the one whose last piece is longest wins.

Null and empty texts have no tokens. Equal rows count each for itself; other columns are ignored.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm.common import blocks, id_and_text

MARK = "▁"
MAX_NODES = 400_000


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    longest: int
    byte_score: float

    @staticmethod
    def of(scores: dict[str, float]) -> "Vocabulary":
        return Vocabulary(scores, max(map(len, scores)), min(scores.values()) - 10)


@cache
def public_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece file with scores from their ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    usable = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    return Vocabulary.of({model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(usable)})


class Trie:
    """Prefixes with their forward scores and token counts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.terminal: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets the nodes; the counts of whole pre-tokens stay."""
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: bytes) -> int:
        """The tokens of a pre-token."""
        found = self.terminal.get(word)
        if found is None:
            found = self.terminal[word] = self._insert(MARK + word.decode())
            if len(self.score) > MAX_NODES:
                self.clear()
        return found

    def _insert(self, word: str) -> int:
        children, path, node = self.children, [0], 0
        for end, char in enumerate(word, 1):
            child = children.get((node, char))
            if child is None:
                child = children[node, char] = self._forward(word, end, path)
            path.append(child)
            node = child
        return self.tokens[node]

    def _forward(self, word: str, end: int, path: list[int]) -> int:
        """A new node for ``word[:end]``, scored from the nodes of its prefixes."""
        scores, best, tokens = self.vocabulary.scores, -math.inf, 0
        for start in range(max(0, end - self.vocabulary.longest), end):
            piece = scores.get(word[start:end])
            if piece is not None and self.score[path[start]] + piece > best:
                best, tokens = self.score[path[start]] + piece, self.tokens[path[start]] + 1
        if best == -math.inf:
            size = len(word[end - 1].encode())
            best = self.score[path[-1]] + size * self.vocabulary.byte_score
            tokens = self.tokens[path[-1]] + size
        self.score.append(best)
        self.tokens.append(tokens)
        return len(self.score) - 1


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(public_vocabulary(vocabulary_path))
        for batch in batches:
            for part, texts in blocks(batch):
                if len(trie.terminal) > MAX_NODES:
                    trie.terminal.clear()
                split = [t.split() for t in texts]
                for word in set().union(*split):
                    trie.count(word)
                tokens = [sum(map(trie.terminal.__getitem__, words)) for words in split]
                columns = [part.column("doc_id"), pa.array(map(len, split), pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    narrow = id_and_text(docs, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, n_words long, n_tokens long")
