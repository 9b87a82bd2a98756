"""Token counts under a unigram model, with forward scores shared along a trie.

The pre-tokens of a block of texts go into one trie. The best score of a prefix depends on the prefix alone, so it is
computed once per node: over the pieces that end there, the score of the node before the piece plus the
piece's. What stands at the node where a word ends is its number of tokens.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T

#: Stands before each word, as in the vocabulary file.
WORD_START = "▁"
#: Words with more characters are scored alone, so that the trie stays as deep as words usually are.
TRIE_DEPTH = 64
#: Added to the lowest score for a character that is no piece.
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces and scores of a vocabulary file.

    A unigram file's scores are used as they are. Files of other kinds list pieces by rank; their scores are the
    logarithms of a Zipf law over the ranks. Where the file has byte pieces, a character that is no piece counts as the bytes
    of its UTF-8 form, else as one token.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        unigram = any(model.get_score(i) != round(model.get_score(i)) for i, _ in names)
        self.scores = {p: model.get_score(i) if unigram else -math.log(rank + 2.0) for rank, (i, p) in enumerate(names)}
        self.by_bytes = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.powers = np.array([pow(int(_BASE), n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        self.tables = {}
        for n in range(1, self.longest + 1):
            some = [p for p in self.scores if len(p) == n]
            if some:
                points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
                h = np.zeros(len(some), np.uint64)
                for k in range(n):
                    h = h * _BASE + points[:, k]
                order = np.argsort(h)
                self.tables[n] = (h[order], np.array([self.scores[p] for p in some])[order])


    def unknown_tokens(self, points: np.ndarray) -> np.ndarray:
        """Tokens of each code point that is no piece."""
        extra = (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return 1 + extra * self.by_bytes


@cache
def pieces(path: str) -> Pieces:
    """The worker's copy of a vocabulary file."""
    return Pieces(path)


def count_alone(model: Pieces, word: str) -> int:
    """The same recurrence over one word, without a trie."""
    best, number = [0.0], [0]
    alone = model.unknown_tokens(np.frombuffer(word.encode("utf-32-le"), np.uint32)).tolist()
    for end in range(1, len(word) + 1):
        score, count = best[end - 1] + model.unknown, number[end - 1] + alone[end - 1]
        known = False
        for n in range(1, min(model.longest, end) + 1):
            piece = model.scores.get(word[end - n:end])
            if piece is None:
                continue
            value = (best[end - n] + piece, -number[end - n] - 1)
            if (n == 1 and not known) or value > (score, -count):
                score, count = value[0], -value[1]
            known = True
        best.append(score)
        number.append(count)
    return number[-1]


def count_words(model: Pieces, words: list[str]) -> np.ndarray:
    """Tokens of each word (distinct, not empty): one trie for all of at most TRIE_DEPTH characters.

    The highest score wins, of equal scores the one with fewer tokens.
    """
    result = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for k in np.flatnonzero(lengths > TRIE_DEPTH).tolist():
        result[k] = count_alone(model, words[k])
    alive = np.flatnonzero(lengths <= TRIE_DEPTH)
    if not len(alive):
        return result
    chosen = [words[k] for k in alive.tolist()]
    points = np.frombuffer("".join(chosen).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = lengths[alive]
    starts = np.cumsum(sizes) - sizes
    room = int(sizes.sum()) + 1
    parent, best, number = np.zeros(room, np.int64), np.zeros(room), np.zeros(room, np.int64)
    prefix = np.zeros(room, np.uint64)
    node, used = np.zeros(len(alive), np.int64), 1
    left = np.arange(len(alive))
    for depth in range(int(sizes.max())):
        left = left[sizes[left] > depth]
        edges, which = np.unique(node[left] << 21 | points[starts[left] + depth], return_inverse=True)
        new = slice(used, used + len(edges))
        up = edges >> 21
        parent[new] = up
        prefix[new] = prefix[up] * _BASE + (edges & 0x1FFFFF).astype(np.uint64) + np.uint64(1)
        score, count = best[up] + model.unknown, number[up] + model.unknown_tokens(edges & 0x1FFFFF)
        known = np.zeros(len(edges), bool)
        ancestor = np.arange(used, used + len(edges))
        for n in range(1, min(model.longest, depth + 1) + 1):
            ancestor = parent[ancestor]
            if n not in model.tables:
                continue
            hashes, values = model.tables[n]
            wanted = prefix[new] - prefix[ancestor] * model.powers[n]
            at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            hit = hashes[at] == wanted
            value, total = best[ancestor] + values[at], number[ancestor] + 1
            better = hit & ((value > score) | ((value == score) & (total < count)) | ((n == 1) & ~known))
            score, count = np.where(better, value, score), np.where(better, total, count)
            known |= hit
        best[new], number[new] = score, count
        node[left] = which + used
        used += len(edges)
    result[alive] = number[node]
    return result


def count_tokens(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words and n_tokens of every row, over whole texts.

    Words are what white space separates. A null or empty text has none; repeated rows are counted alike; an
    empty table gives an empty one. Memory is bounded by a block of texts or, beyond that, one text.
    """

    def run(batches):
        model = pieces(path)
        for rows, texts in T.text_blocks(batches, "__text"):
            split = [(t or b"").split() for t in texts]
            index = {w: k for k, w in enumerate(dict.fromkeys(w for words in split for w in words))}
            counts = count_words(model, [WORD_START + w.decode("utf-8") for w in index])
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            places = np.fromiter((index[w] for words in split for w in words), np.int64, int(sizes.sum()))
            totals = np.bincount(np.repeat(np.arange(len(split)), sizes), weights=counts[places] if len(places) else None, minlength=len(split))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), pa.array(totals.astype(np.int64))], ["id", "n_words", "n_tokens"])

    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    kind = documents.schema[id].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint").withColumnRenamed("id", id)
