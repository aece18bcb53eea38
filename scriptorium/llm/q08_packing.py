"""op8: all documents as token pieces in sequences of 2048."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import packing
from ._common import materialise, table

CAPACITY = 2048
_KEPT_WORDS = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


# Latin-1 in lower case with blanks for white space, and its classes: two neighbours without a common bit belong to two pre-tokens.
# In folded text _OTHER is free to stand for a word that is not cut here.
_NUMBER, _LETTER, _MARK, _BLANK = 0, 1, 2, 3
_WHITE = b"\t\n\x0b\x0c\r \x85\xa0"
_FOLDED = bytes(32 if b in _WHITE else ord(chr(b).lower()) for b in range(256))
_OTHER = b"\x85"
_CLASSES = bytes(_NUMBER if b in _OTHER else _BLANK if b in _WHITE else _LETTER if chr(b).isalpha() else _NUMBER if chr(b).isnumeric() else _MARK for b in range(256))
_ENDINGS = re.compile(b"'(?:s|t|re|ve|m|ll|d)")


def _latin(text: str) -> bool:
    if text.isascii() or len(text) < 20:
        return text.isascii() or max(text) <= "\xff"
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pre_tokens(low: bytes) -> list[bytes]:
    """The tokenizer's pre-tokens of folded text: runs of letters, single numbers, English endings, runs of other marks."""
    kind = np.frombuffer(low.translate(_CLASSES), np.uint8)
    cut = (kind[1:] & kind[:-1]) == 0  # after each byte but the last
    for m in _ENDINGS.finditer(low):
        if m.start() == 0 or kind[m.start() - 1] != _MARK:
            cut[m.start()] = False
            cut[m.end() - 1 : m.end()] = True
    at = np.flatnonzero(cut) + 1
    return np.insert(np.frombuffer(low, np.uint8), at, 32).tobytes().split()


class WordIds(dict):
    """Ids of pre-tokens (bytes) and words (str), as little-endian bytes.

    Latin-1 text is in normal form already, so it is lower-cased and cut here as
    the tokenizer does it, and the model takes each pre-token once. The tokenizer
    drops white space, and none of its steps looks across it, so other texts go
    by words: those of Latin-1 as above, the rest, and what holds a special token,
    through the whole tokenizer. At most ``_KEPT_WORDS`` are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.model = whole.encode, whole.model.tokenize
        self.special = re.compile("|".join([re.escape(t.content) for t in whole.get_added_tokens_decoder().values()]) or "(?!)")
        letters = _byte_letters()
        self.letters = str.maketrans({chr(c): "".join([letters[b] for b in chr(c).encode()]) for c in range(256)})

    def _ids(self, word: bytes | str) -> bytes:
        if isinstance(word, str):
            return np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        shown = word.decode("latin-1")
        return array("I", [t.id for t in self.model(shown if word.isalpha() else shown.translate(self.letters))]).tobytes()

    def __missing__(self, word: bytes | str) -> bytes:
        ids = self._ids(word)
        if len(self) >= _KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        text = text or ""
        special = self.special.search(text) is not None
        if not special and _latin(text):
            return b"".join(map(self.__getitem__, pre_tokens(text.encode("latin-1").translate(_FOLDED))))
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        other = [not _latin(w) or (special and self.special.search(w) is not None) for w in words]
        low = b" ".join([_OTHER if o else w.encode("latin-1").translate(_FOLDED) for w, o in zip(words, other, strict=True)])
        rest = compress(words, other)
        return b"".join([self[next(rest) if t == _OTHER else t] for t in pre_tokens(low)])


_LOADED: dict[str, WordIds] = {}


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; only documents longer than ``capacity`` ids are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _LOADED.setdefault(tokenizer, None) or WordIds(tokenizer)
        _LOADED[tokenizer] = words
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = materialise(tokenise(docs, str(tokenizer)), "op8-pieces")
    return packing.pack(pieces, CAPACITY, ["doc_id", "piece", "ids_crc32"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
