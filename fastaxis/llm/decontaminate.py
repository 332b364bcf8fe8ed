"""Operator 9, benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Both sides are normalised alike (A-Z lower-cased; words are runs of digits, letters and
non-ASCII bytes). The windows of all items go into one automaton; each document is
normalised, scanned once, and the matches are mapped to its words and, in
``hit_spans``, to character offsets of the original text.

The automaton is built in each Python worker from the items. Test sets are small: one
automaton takes ``shard_bytes`` of their text, which bounds what is broadcast and what a worker
holds. Items beyond that go to further automata, one of which is read, broadcast and held at a
time, and the documents are scanned once for each; so no size of the benchmark is left out, but
a large one takes time in proportion.

Defined results: a null or wordless text has no words and no hits; a null or wordless
item has no window; repeated rows give repeated results; an empty benchmark hits nothing;
items without an id still mark words but are not listed. Further columns of the
documents are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import text_bytes

#: Bytes of item text that one automaton takes. Windows of ten words overlap: each byte makes some ten nodes of 32 bytes.
SHARD_BYTES = 512 << 10
#: Bytes of documents that are held while the automata of several shards scan them in turn.
GROUP_BYTES = 32 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "doc_id long, start long, end long"

_NORMAL = np.array([b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256)], np.uint8)


class Matcher:
    """The automaton of some items, and the scan of one normalised text."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        owners: dict[str, list] = {}
        for item, text in items:
            words = _NORMAL[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()
            for j in range(max(1, len(words) - window + 1) if words else 0):
                part = words[j : j + window]
                owners.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), []).append(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), key.count(" ") - 1, tuple(dict.fromkeys(ids))))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Marks the words inside matches in ``hit`` and adds the items found."""
        if self.empty or not words:
            return
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ends = None
        for end, (_, count, ids) in self.automaton.iter(text):
            if ends is None:  # the place of the space after each word
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            last = int(np.searchsorted(ends, end))
            hit[last - count + 1 : last + 1] = True
            items.update(ids)


def shards(items: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """Lists of items of at most ``most`` bytes of text each, or of one item; only one list is held at a time."""
    out, size = [], 0
    for x in items:
        n = len((x[1] or "").encode())
        if out and size + n > most:
            yield out
            out, size = [], 0
        out.append(x)
        size += n
    if out:
        yield out


_built: dict[str, Matcher] = {}


def _matchers(key: str, parts: list[Broadcast], window: int) -> Iterator[Matcher]:
    """The matchers of the shards, one at a time; that of a single shard is kept for the worker's next task."""
    for part in parts:
        found = _built.get(key)
        if found is None:
            found = Matcher(part.value, window)
            if len(parts) == 1:
                _built.clear()
                _built[key] = found
        yield found


def grouped(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches that reach ``most`` bytes each, but for the last."""
    out, size = [], 0
    for batch in batches:
        out.append(batch)
        size += batch.nbytes
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, emit, schema, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Scans the texts in the second column; emit(batch, data, normal, offsets, counts, hits) makes the result of a batch.

    The automaton of a single shard is built once a worker. Of several, one is held at a time and scans
    group_bytes of texts before the next is built: as often as a task has groups, however small its batches are.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    parts = [context.broadcast(part) for part in shards(map(tuple, items.toLocalIterator()), shard_bytes)]
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, group_bytes if len(parts) > 1 else 1):
            texts = []
            for batch in group:
                data, offsets = text_bytes(batch.column(1))
                normal = _NORMAL[data].tobytes()
                texts.append((batch, data, normal, offsets, np.zeros(len(batch), np.int64), {}))
                if not parts:
                    texts[-1][4][:] = np.fromiter((len(normal[lo:hi].split()) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(batch))
            for matcher in _matchers(key, parts, window):
                for batch, _, normal, offsets, counts, hits in texts:
                    for i in range(len(batch)):
                        w = normal[offsets[i] : offsets[i + 1]].split()
                        counts[i] = len(w)
                        hit, found = hits.get(i) or (np.zeros(len(w), bool), set())
                        before = len(found)
                        matcher.scan(w, hit, found)
                        if len(found) > before or hit.any():
                            hits[i] = hit, found
            for one in texts:
                yield from emit(*one)

    return docs.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: its words, its words inside windows of items, the items found."""
    none = hashlib.sha256(b"").hexdigest()

    def emit(batch, data, normal, offsets, counts, hits):
        ids, n = batch.column(0), len(batch)
        n_hit, n_items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [none] * n
        for i, (hit, found) in hits.items():
            named = sorted(str(x) for x in found if x is not None)
            n_hit[i], n_items[i], sha[i] = hit.sum(), len(named), hashlib.sha256(",".join(named).encode()).hexdigest()
        yield pa.record_batch([ids, pa.array(counts), pa.array(n_hit), pa.array(n_items), pa.array(sha), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _scan(_texts(docs), benchmark, window, shard_bytes, emit, SCHEMA, group_bytes)


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The runs of hit words as code point offsets (end exclusive) of the original text."""

    def emit(batch, data, normal, offsets, counts, hits):
        out = ([], [], [])
        keys = batch.column(0).to_pylist() if hits else []
        for i, (hit, _) in hits.items():
            lo, hi = offsets[i], offsets[i + 1]
            flat = np.frombuffer(normal[lo:hi], np.uint8) != 32
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flat, [False]])))
            starts, ends = edge[::2], edge[1::2]
            point = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
            run = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
            for a, b in zip(run[::2], run[1::2], strict=True):
                for column, x in zip(out, (keys[i], int(point[starts[a]]), int(point[ends[b - 1]])), strict=True):
                    column.append(x)
        yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "end"])

    return _scan(_texts(docs), benchmark, window, shard_bytes, emit, SPANS)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text holds no window of an item."""
    # The columns stand in a struct, so that none of their names matters here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def emit(batch, data, normal, offsets, counts, hits):
        dirty = np.zeros(len(batch), bool)
        dirty[[i for i, (hit, _) in hits.items() if hit.any()]] = True
        yield batch.filter(pa.array(~dirty)).select(["row"])

    left = _scan(whole, benchmark, window, shard_bytes, emit, whole.select("row").schema)
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
