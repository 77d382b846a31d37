"""Token counts by a unigram model, with one dynamic program per shared prefix.

The vocabulary is a public one; its order is by rank, so pieces follow a Zipf
law over their ranks. The best split of a word is found by forward scores over
its prefixes. A batch's distinct words are inserted in a trie by walking them in
sorted order: the scores of a shared prefix stand on the current path and are
used again, and each word's terminal count is stored.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from tariffscope.llm.common import add_columns

#: Marks the start of a word in the vocabulary.
WORD_START = "▁"
#: Word counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64

_MODELS: dict[str, "Unigram"] = {}


class Unigram:
    """Best splits of words under ``score[piece]``; characters outside the vocabulary cost their UTF-8 bytes."""

    def __init__(self, score: dict[str, float], byte_score: float):
        self.score, self.byte_score = score, byte_score
        self.longest = max(map(len, score), default=1)
        self.known: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> "Unigram":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        harmonic = sum(1 / rank for rank in range(1, size + 1))
        pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        score = {piece: -math.log(rank * harmonic) for rank, piece in enumerate(pieces, 1)}
        return cls(score, -math.log(size * harmonic))

    def count_sorted(self, words: list[str]) -> list[int]:
        """Tokens of each of the sorted, distinct ``words``."""
        path = ""
        best: list[tuple[float, int]] = [(0.0, 0)]  # of each prefix of the path: score, minus tokens
        counts, get, longest = [], self.score.get, self.longest
        for word in words:
            text = WORD_START + word
            shared = len(commonprefix((path, text)))
            del best[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode(errors="surrogatepass"))
                score, tokens = best[end - 1]
                top = (score + size * self.byte_score, tokens - size)
                for start in range(max(0, end - longest), end):
                    piece = get(text[start:end])
                    if piece is not None:
                        score, tokens = best[start]
                        found = (score + piece, tokens - 1)
                        if found > top:
                            top = found
                best.append(top)
            path = text
            counts.append(-best[-1][1])
        return counts

    def totals(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        distinct: set[bytes] = set().union(*split) if split else set()
        unknown = sorted(w.decode() for w in distinct if w not in self.known)
        found = {w.encode(): n for w, n in zip(unknown, self.count_sorted(unknown), strict=True)}
        here = found | {w: self.known[w] for w in distinct if w in self.known}
        fresh = {w: n for w, n in found.items() if len(w) <= LONGEST_REMEMBERED}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
        self.known |= fresh
        get = here.__getitem__
        return [sum(map(get, words)) for words in split]


def model_of(path: str) -> Unigram:
    """One per worker process and vocabulary."""
    if path not in _MODELS:
        _MODELS[path] = Unigram.from_file(path)
    return _MODELS[path]


def counts(bodies: pa.Array, path: str) -> dict[str, object]:
    texts = bodies.to_pylist()
    return {"n_words": [len(t.split()) for t in texts], "n_tokens": model_of(path).totals(texts)}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Every input row as ``row`` with its words and the tokens of their best splits.

    Words are runs without ASCII white space. A null or empty text has no token.
    Splits of equal score count the fewer tokens. Repeated rows are counted one
    by one, extra columns stay inside ``row``, an empty table gives an empty
    result; words of any length are split whole.
    """
    return add_columns(docs, "n_words long, n_tokens long", lambda bodies: counts(bodies, path))
