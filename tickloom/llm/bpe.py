"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word merges all places of its
lowest-rank pair; ranks are found by binary search over the sorted pair keys.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as T

#: Stands between pieces while they are split together; no word pattern matches white space.
_BREAK = "\n"
#: Bytes of text encoded at once. A block's distinct pieces are merged together: larger blocks merge less, smaller ones hold less.
BLOCK_BYTES = 1 << 20
_NO_RANK = np.int64(1) << np.int64(40)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE file of the tokenizers library with word ends: symbols, ranks, specials, split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.width = max(self.tokens) + 1
        keys, merged = [], []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(self.ids[left] * self.width + self.ids[right])
            merged.append(self.ids[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = order.astype(np.int64)
        self.merged = np.array(merged, np.int64)
        letters = _byte_characters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in letters], np.int64)
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"] + "|" + _BREAK, regex.V0)
        self.text_of = [self.tokens.get(i, "") for i in range(self.width)]
        self.number_of = [str(i) for i in range(self.width)]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.special_marks = tuple(s.encode() for s in self.specials)


def merge_rounds(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words (UTF-8 bytes, not empty), one after the other, and their number per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths) - 1
    symbols = vocabulary.inner[data]
    symbols[ends] = vocabulary.last[data[ends]]
    owner = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        same = owner[1:] == owner[:-1]
        keys = np.where(same, symbols[:-1] * vocabulary.width + symbols[1:], -1)
        at = np.minimum(np.searchsorted(vocabulary.pair_keys, keys), len(vocabulary.pair_keys) - 1)
        ranks = np.append(np.where(vocabulary.pair_keys[at] == keys, vocabulary.pair_ranks[at], _NO_RANK), _NO_RANK)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(ranks, first)
        sizes = np.diff(np.append(first, len(symbols)))
        active = lowest < _NO_RANK
        going = np.repeat(active, sizes)
        if not active.all():
            done.append((owner[~going], symbols[~going]))
            if not active.any():
                break
        picked = (ranks == np.repeat(lowest, sizes)) & going
        where = np.flatnonzero(picked)
        # of pairs that overlap (a a a) every second one counts, from the left
        run = np.cumsum(np.append(True, np.diff(where) != 1)) - 1
        head = where[np.append(True, np.diff(where) != 1)]
        where = where[(where - head[run]) % 2 == 0]
        symbols = symbols.copy()
        symbols[where] = vocabulary.merged[ranks[where]]
        keep = going
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    owners = np.concatenate([o for o, _ in done]) if done else np.empty(0, np.int64)
    ids = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int64)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return ids[order], counts


def lower(text: str) -> str:
    """Lower case character by character: a capital sigma never becomes the final form."""
    return text.replace("\u03a3", "\u03c3").lower()


class Encoder:
    """Encodes a block of texts: distinct pieces between ASCII white space once, then the texts from them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without special tokens, and their number per piece.

        All pieces are normalised, lower-cased and split in one go. No character composes with a line break.
        """
        joined = unicodedata.normalize("NFC", _BREAK.join(p.decode("utf-8") for p in pieces))
        words = [w.encode() for w in self.vocabulary.words.findall(lower(joined))]
        breaks = np.fromiter((w == b"\n" for w in words), bool, len(words))
        piece = np.cumsum(breaks)[~breaks]
        ids, per_word = merge_rounds(self.vocabulary, [w for w in words if w != b"\n"])
        return ids, np.bincount(piece, weights=per_word, minlength=len(pieces)).astype(np.int64)

    def _piece_with_specials(self, piece: bytes) -> list[int]:
        v, ids = self.vocabulary, []
        for part in v.special_pattern.split(piece.decode("utf-8")):
            if part in v.specials:
                ids.append(v.specials[part])
            elif part:
                ids += self._pieces([part.encode()])[0].tolist()
        return ids

    def encode(self, texts: list[bytes]) -> list[tuple[str, int, str]]:
        """For each text: its ids joined by a space, their number, and the decoded text."""
        v, split = self.vocabulary, [t.split() for t in texts]
        distinct = dict.fromkeys(p for words in split for p in words)
        special = [p for p in distinct if any(m in p for m in v.special_marks)] if any(
            m in t for t in texts for m in v.special_marks) else []
        plain = [p for p in distinct if p not in set(special)] if special else list(distinct)
        ids, counts = self._pieces(plain) if plain else (np.empty(0, np.int64), np.empty(0, np.int64))
        ids, ends = ids.tolist(), np.cumsum(counts)
        numbers, tokens = [v.number_of[i] for i in ids], [v.text_of[i] for i in ids]
        for piece, start, end in zip(plain, (ends - counts).tolist(), ends.tolist()):
            distinct[piece] = (" ".join(numbers[start:end]), " ".join(tokens[start:end]), end - start)
        for piece in special:
            found = self._piece_with_specials(piece)
            distinct[piece] = (" ".join(v.number_of[i] for i in found), decode(v, found), len(found))
        out = []
        for words in split:
            found = [x for x in map(distinct.__getitem__, words) if x[2]]
            out.append((" ".join([x[0] for x in found]), sum([x[2] for x in found]), " ".join([x[1] for x in found])))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def decode(vocabulary: Vocabulary, ids) -> str:
    """Token strings joined by one space, as the file names no decoder; special tokens stay."""
    return " ".join(vocabulary.tokens[int(i)] for i in ids)


def encode_documents(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (array<int>) and decoded text of every row; a null text counts as empty. Other columns are ignored."""

    def run(batches):
        tool = encoder(path)
        for rows, texts in T.text_blocks(batches, "__text", BLOCK_BYTES):
            found = tool.encode([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([np.array(x[0].split(), np.int32) for x in found], pa.list_(pa.int32())),
                pa.array([x[2] for x in found])], ["id", "ids", "decoded"])

    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    kind = documents.schema[id].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id)


def encode_digest(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Whole texts are encoded; a null or empty text gives no tokens and the digests of the empty string. Repeated rows
    give repeated results, an empty table an empty one. Memory is bounded by a block of texts or, beyond that, one text.
    """

    def run(batches):
        tool = encoder(path)
        for rows, texts in T.text_blocks(batches, "__text", BLOCK_BYTES):
            found = tool.encode([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([x[1] for x in found], pa.int64()),
                pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in found]),
                pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in found])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = documents.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    kind = documents.schema[id].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)
