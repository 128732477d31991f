"""Token ids of whole documents by the public tokenizers, computed inside Spark tasks.

Most of a text's chunks repeat, so each distinct chunk is encoded once per Python worker and its ids are reused. A
chunk is a word of Latin letters with the single space before it, other non-space characters, or a run of white space:
both tokenizers cut there before they merge, so the ids of the text are the ids of its chunks in order. A text that holds
the literal of an added token, which the library gives one id wherever it stands, is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries of a worker's chunk cache. A chunk enters when it is met in a second batch, until the cache is full.
CACHE_ENTRIES = 300_000
_SEEN_BITS = 22
# Longer chunks are encoded but not kept.
CACHED_CHARS = 64

# What white space is differs between libraries outside ASCII; texts with such characters are encoded as a whole.
_UNUSUAL_POINTS = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_UNUSUAL_SPACE = re.compile("[" + "".join(map(chr, _UNUSUAL_POINTS)) + "]")
_SPACE = r" \t\n\r\x0b\x0c"
# Latin letters (without the one whose lower case is two characters) up to an ASCII character that is neither letter, digit nor underscore: nothing joins or composes across that.
_LETTERS = "[A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F))) + "]+"
_WORD = _LETTERS + r"(?=[\x00-/:-@\[-^`{-\x7f]|\Z)"
_WORD_ALONE = re.compile(f" ?{_LETTERS}")
_CHUNKS = re.compile(rf"[{_SPACE}]+(?![^{_SPACE}])| ?{_WORD}| ?[^{_SPACE}]+|[{_SPACE}]+")
# For tokenizers that give white space no ids.
_CHUNKS_WITHOUT_SPACE = re.compile(rf"{_WORD}|[^{_SPACE}]+")


class _Letters(dict):
    """A character as the tokenizer's model sees it, after normalizing and pre-tokenizing."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, point: int) -> str:
        own = self.tokenizer
        text = own.normalizer.normalize_str(chr(point)) if own.normalizer else chr(point)
        self[point] = "".join(part for part, _ in own.pre_tokenizer.pre_tokenize_str(text))
        return self[point]


class Encoder:
    """Encodes texts to little-endian unsigned 16-bit ids; all the public vocabularies fit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # In any case, since a normalizer may change it; texts without the tokens' common sign needn't be searched.
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.sign = re.match(r"[\W\d_]*", os.path.commonprefix(added)).group()
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("the vocabulary has more than 65,536 ids")
        if sys.byteorder != "little":
            raise ValueError("ids are stored in little-endian order")
        self.model = self.tokenizer.model
        self.letters = _Letters(self.tokenizer)
        self.cache: dict[str, bytes] = {}
        self.seen = bytearray(1 << _SEEN_BITS)
        drops_space = not self.tokenizer.encode(" \n", add_special_tokens=False).ids
        self.chunks = (_CHUNKS_WITHOUT_SPACE if drops_space else _CHUNKS).findall

    def _add(self, chunks: list[str]) -> None:
        """Put the ids of chunks into the cache."""
        cache, tokenize, letters, alone = self.cache, self.model.tokenize, self.letters, _WORD_ALONE.fullmatch
        others = []
        for chunk in chunks:
            # A word is one pre-token, so the model can take it without the steps before.
            if alone(chunk):
                cache[chunk] = array("H", [x.id for x in tokenize(chunk.translate(letters))]).tobytes()
            else:
                others.append(chunk)
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            cache.update(zip(part, (array("H", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text (null: none) and the end id."""
        last = array("H", [end]).tobytes()
        chunks = [[text] if _UNUSUAL_SPACE.search(text) or (self.sign in text and self.added.search(text)) else self.chunks(text) for text in (x or "" for x in texts)]
        cache, seen, mask = self.cache, self.seen, (1 << _SEEN_BITS) - 1
        missing: set[str] = set()
        for own in chunks:
            missing.update(own)
        missing = list(missing.difference(cache))
        self._add(missing)
        get = cache.__getitem__
        found = [b"".join(map(get, own)) + last for own in chunks]
        full = len(cache) - len(missing) > CACHE_ENTRIES
        for chunk in missing:
            at = hash(chunk) & mask
            if full or not seen[at] or len(chunk) > CACHED_CHARS:
                del cache[chunk]
            seen[at] = 1
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and Python worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text in ``column`` each, or a single longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if batch.num_rows > at:
        yield batch.slice(at)


def with_tokens(docs: DataFrame, columns: list[str], tokenizer: str, end: int, text_col: str = "text") -> DataFrame:
    """``columns`` of every document with ``ids`` (binary, 16-bit little-endian) of its whole text and the end id."""
    taken = docs.select(*columns, F.col(text_col).alias("_text"))
    schema = docs.select(*columns).withColumn("ids", F.lit(b"")).schema

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, len(columns)):
                ids = own.encode(part.column(len(columns)).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*columns, "ids"])

    return taken.mapInArrow(encode, schema)
