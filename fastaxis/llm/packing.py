"""Operator 10, cost-balanced packing of tokenised documents into sequences.

A partition's documents are tokenised and packed in batches of about ``batch_tokens``
tokens. A batch opens as many sequences as its tokens fill. Full pieces of long documents take
whole sequences. What is left of each document is assigned in descending order to the sequence
of the lowest estimated cost (``linear * tokens + quadratic * sum of squared piece lengths``)
that has room for it. Where none has, a further sequence is opened, as long as no more than
the share ``padding`` of the batch's tokens is padded; then a document is cut over the sequences
with the most room. A batch that is too small for a last padded sequence (the end of a small
partition) has sequences of powers of two for its rest, which need no padding, and its documents are cut to fill
them. Nothing is shuffled; a task keeps one batch of ids (or one long document).

sequence_id is (task's partition << 33) + a count, so that it is unique over the table and
the same when a lost task is run again.

Defined results: a null or empty text is its end token alone; repeated rows are packed as
often as they occur; a null doc_id stays null in its pieces; an empty table gives no
pieces. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words for which the vocabulary's own pre-token pattern can be applied here: visible characters below U+0250
#: whose normal forms are settled. All other words go through the tokenizer as they are.
_PLAIN = regex.compile(r"[!-~¡-įı-ɏ]+")
#: The pre-token pattern of word_bpe_49k.json (fixed values of that file).
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CACHED = 400_000


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary uses for each byte: visible Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARACTERS = _byte_characters()


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space: each distinct word is encoded once a batch.

    Words that _PLAIN describes are cut and lower-cased here, and their parts go through the
    tokenizer's model, with a bounded cache; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """The ids of one lower-cased pre-token, as 32-bit little-endian numbers."""
        coded = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        ids = np.array([t.id for t in self.model.tokenize(coded)], "<u4").tobytes()
        if len(self.cache) >= _CACHED:
            self.cache.clear()
        self.cache[part] = ids
        return ids

    def word(self, word: str) -> bytes:
        cache = self.cache
        if word.isascii() or _PLAIN.fullmatch(word):
            lower = word.lower()
            if lower.isalpha():
                return cache.get(lower) or self.part(lower)
            if lower.isprintable() and _PLAIN.fullmatch(word):
                return b"".join(cache.get(x) or self.part(x) for x in _PRE_TOKEN.findall(lower))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and the n + 1 offsets."""
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        per_text = np.asarray(words.offsets, np.int64)
        per_text = per_text - per_text[0]
        coded = words.flatten().dictionary_encode()
        found = [self.word(w) if w else b"" for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(sizes) - sizes
        at = np.asarray(coded.indices, np.int64)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) - np.repeat(ends - lengths - begin[at], lengths)]
        return ids, np.concatenate([[0], ends])[per_text]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float, padding: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of these lengths: pieces as (document, start, length, sequence, offset).

    Without padding every sequence is filled to its end; ties go to the earlier document or sequence.
    """
    total = int(lengths.sum())
    full, rest = divmod(total, capacity)
    spare = int(padding * total) - (capacity - rest) % capacity
    if spare >= 0:
        rooms, further = [capacity] * (full + (rest > 0)), spare // capacity
    else:
        rooms, further = [capacity] * full + [1 << b for b in reversed(range(capacity.bit_length())) if rest >> b & 1], 0
    # Sequences that are not open yet have no room.
    room = np.array(rooms + [0] * further, np.int64)
    opened = len(rooms)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, at: int) -> None:
        pieces.append((doc, start, length, at, int(used[at])))
        used[at] += length
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    following = 0
    for doc in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[doc]) - capacity + 1, capacity):
            put(int(doc), start, capacity, following)
            following += 1
    rest = lengths % capacity
    for doc in np.argsort(-rest, kind="stable"):
        length, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        while length:
            fits = np.flatnonzero(room >= length)
            if not len(fits) and opened < len(room):
                room[opened], fits, opened = capacity, np.array([opened]), opened + 1
            at = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            part = min(length, int(room[at]))
            put(int(doc), start, part, at)
            start, length = start + part, length - part
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 1024, batch_tokens: int = 1 << 21, padding: float = 0.02) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and the CRC-32 of its ids."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        base, count = TaskContext.get().partitionId() << 33, 0
        keys: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            pieces = assign(lengths, capacity, linear, quadratic, padding)
            crc = [zlib.crc32(parts[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            cols = np.array(pieces, np.int64).reshape(-1, 5).T
            out = pa.record_batch(
                [pa.array([keys[d] for d in cols[0]], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array(crc, pa.int64()), pa.array(lengths[cols[0]]), pa.array(cols[3] + (base + count)), pa.array(cols[4])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            count += int(cols[3].max(initial=-1)) + 1
            keys.clear()
            parts.clear()
            held = 0
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
            for lo, hi in _ranges(size):
                flat, offsets = words.batch(batch.column(1).slice(lo, hi - lo))
                for i in range(hi - lo):
                    own = np.empty(offsets[i + 1] - offsets[i] + 1, "<u4")
                    own[:-1], own[-1] = flat[offsets[i] : offsets[i + 1]], end_id
                    keys.append(ids[lo + i])
                    parts.append(own)
                    held += len(own)
                    if held >= batch_tokens:
                        yield flush()
        if parts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _ranges(size: np.ndarray, most: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or of one row."""
    lo, held = 0, 0
    for i, n in enumerate(size):
        if held + n > most and i > lo:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(size):
        yield lo, len(size)
