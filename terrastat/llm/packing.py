"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, equal lengths share a bucket."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm import arrays

LONGEST = 4096
#: Token lists of words held by a Python worker; a full store is emptied, which costs time only.
MOST_WORDS = 150_000
#: One run of these bytes after a letter or digit is a token source of its own in the tokenizer's word pattern.
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b".,!%&$*#;:?")] = True
ALNUM = np.zeros(256, dtype=bool)
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: Latin letters whose lower case and normal form are plain, and runs of marks: one token source each.
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,!%&$*#;:?]+")
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of many texts through the ids of their distinct words.

    The tokenizer drops blanks, so a text's ids are those of its words one after the other. Trailing marks are split off
    where the word pattern cuts there anyway, A-Z counts as lower case (the tokenizer lowers it); words with ``<`` may
    spell a special token and are given to it as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {b: alphabet.pre_tokenize_str(chr(b))[0][0][-1] for b in range(0x21, 0x7F)}
        for b in range(0x80, 0x100):  # the two bytes of a Latin letter
            lead, rest = alphabet.pre_tokenize_str(chr(b))[0][0]
            self.visible[chr(b).encode()[0]], self.visible[chr(b).encode()[1]] = lead, rest
        self.store: dict[int, bytes] = {}

    def word_ids(self, word: bytes) -> bytes | None:
        text = word.decode()
        if SIMPLE.fullmatch(text):
            shown = text.lower() if text.isascii() else "".join(self.visible[b] for b in text.lower().encode())
            return np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        return None

    def learn(self, keys: list[int], words: list[bytes]) -> None:
        hard = []
        for key, word in zip(keys, words):
            ids = self.word_ids(word)
            if ids is None:
                hard.append((key, word.decode()))
            else:
                self.store[key] = ids
        for (key, _), found in zip(hard, self.tokenizer.encode_batch_fast([w for _, w in hard], add_special_tokens=False)):
            self.store[key] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and, per text, where its ids start (with the end)."""
        w = arrays.split_words(texts)
        b = w.buffer
        if not len(w.starts):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        spelled = np.r_[0, np.cumsum(b == ord("<"))]
        raw = spelled[w.ends] > spelled[w.starts]
        plain_at = np.maximum.accumulate(np.where(MARKS[b], -1, np.arange(len(b))))
        cut = np.maximum(plain_at[w.ends - 1] + 1, w.starts)
        last = b[np.maximum(cut - 1, 0)]
        before = b[np.maximum(cut - 2, 0)]
        letter = ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= w.starts))
        split = (cut > w.starts) & (cut < w.ends) & letter & ~raw
        cut = np.where(split, cut, w.ends)
        starts, ends = np.empty(len(cut) + int(split.sum()), np.int64), np.empty(len(cut) + int(split.sum()), np.int64)
        at = np.arange(len(cut)) + np.cumsum(split) - split
        starts[at], ends[at] = w.starts, cut
        starts[at[split] + 1], ends[at[split] + 1] = cut[split], w.ends[split]
        keys = arrays.hash_ranges(arrays.LOWER[b], starts, ends)
        if raw.any():
            keys[at[raw]] = arrays.hash_ranges(b, w.starts[raw], w.ends[raw], seed=5)
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        if len(self.store) > MOST_WORDS:
            self.store.clear()
        new = [i for i, k in enumerate(names) if k not in self.store]
        self.learn([names[i] for i in new], [b[starts[where[i]] : ends[where[i]]].tobytes() for i in new])
        ids = [self.store[k] for k in names]
        size = np.array([len(x) for x in ids]) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.r_[0, np.cumsum(size)[:-1]]
        n = size[inverse]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first_unit = np.r_[at, len(starts)][w.first]
        return flat[step + np.repeat(begin[inverse], n)], np.r_[0, np.cumsum(n)][first_unit]


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def binary_pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: as many of the longest as fit, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = LONGEST, with_tokens: bool = True) -> DataFrame:
    """Sequences of ``docs (doc_id, text)``, each one piece of one document and a power of two long: no padding, no mixing.

    ``tokenizer`` is the path of a vocabulary file that every executor has. A document's ids end with ``end_id``; a missing or
    empty text has that id alone. Result per sequence: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    bucket`` and, ``with_tokens``, the ids. ``bucket`` is the exponent of the length: equal buckets form dense batches.
    ``sequence_id`` counts within a task's rows. ``doc_id`` may be missing or repeated: each row is packed by itself.
    Documents are cut where they are read, so nothing is shuffled and a hot source costs nothing.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch, texts in arrays.slices(batches):
            ids, first = own.encode(texts)
            who, start, length, crc, total, tokens = [], [], [], [], [], []
            for d in range(len(texts)):
                doc = np.append(ids[first[d] : first[d + 1]], np.uint32(end_id)).astype("<u4")
                at = 0
                for n in binary_pieces(len(doc), longest):
                    piece = doc[at : at + n]
                    who.append(d)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(doc))
                    if with_tokens:
                        tokens.append(piece.astype(np.int32))
                    at += n
            columns = [batch.column("doc_id").take(pa.array(who, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]]
            columns.append(pa.array([n.bit_length() - 1 for n in length], pa.int32()))
            if with_tokens:
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["tokens"] * with_tokens])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", tokens array<int>" * with_tokens
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = plain.mapInArrow(run, schema).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["tokens"] * with_tokens)
