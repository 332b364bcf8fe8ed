"""Operator 4, removal of repeated byte strings by the interval tree of an enhanced suffix array.

A global suffix array needs all texts in one place. This one is built in pieces that hold
together what can repeat: of the ``GRAM``-byte grams in each ``length``-byte window, the one
with the least hash is the window's anchor, so equal windows have equal anchors at equal
places. An anchor's context is the text of the windows that it anchors (at most 2 * length -
GRAM bytes). Contexts are dealt by the anchor's hash, those of an anchor that occurs more
than BLOCK times by their own hash too, so that no task holds all of a frequent one's:

* an equal context at a smaller place covers all of a context; this is settled within each
  Arrow batch first, so that a passage that many documents share is sent once a batch;
* where one anchor has different contexts, the bytes of one occurrence of each are fetched,
  and a suffix array of their windows is sorted (an anchor with more than BLOCK contexts is
  divided into blocks by the contexts' hash; each block tells the first place of each of its
  windows, and of those that several blocks have, all but the very first are covered). One scan of its common prefixes with a
  stack yields the intervals of suffixes with a common prefix of at least ``length`` bytes;
  those whose suffixes differ in the byte to their left, or begin a context, are the maximal
  repeats, with all occurrences. All but the first occurrence are covered.

Texts are shuffled once by doc_id, for the fetching and for the removal alike. Between the
two halves stands a written table of covered ranges and contexts to fetch. Contexts are
compared by 128 bits of hash, windows by their bytes.

Defined results: null is an empty text; an empty table gives none; further columns are not
read. If doc_ids repeat or are null, rows are put in the order of doc_id (nulls last) and
text, and the earlier of two rows counts as the smaller document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import mix, powers, slices, text_bytes, written

GRAM = 32
_I, _U = np.int64, np.uint64
#: Bytes of contexts for which one suffix array is sorted, if no single anchor has more.
ARRAY_BYTES = 2 << 20
#: Different contexts of one anchor that go to one task; those of a hot anchor are divided.
BLOCK = 1024


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data) + 1)[0][: len(data)], dtype=_U, out=sums[1:])
    return sums


def between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from lo to hi."""
    return mix((sums[hi] - sums[lo]) * powers(len(sums))[1][lo] + (hi - lo).astype(_U) * _U(0xD6E8FEB86659FD93))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: document, its gram's hash, its context's hash, first window, number of windows, the anchor's place in the first."""
    n, span = len(data), length - GRAM + 1
    nothing = (np.zeros(0, _I),) * 6
    if n < length:
        return nothing
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    grams = between(sums, at, at + GRAM)
    # The order is by 33 bits of the hash, then by place: a text of Spark's has less than 2^31 bytes.
    least = (mix(grams) >> _U(31) << _U(31)) | at.astype(_U)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not len(doc):
        return nothing
    window = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    anchor = (least[window] & _U((1 << 31) - 1)).astype(_I)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([cut, [len(doc)]]))
    first = window[cut]
    inside = anchor[cut] - first
    context = mix(between(sums, first, first + count + length - 1) + inside.astype(_U) * _U(0x9FB21C651E98DF25))
    return doc[cut], grams[anchor[cut]].astype(_I), context.astype(_I), first - offsets[doc[cut]], count, inside


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of ranges, as (doc, start, end)."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new) - 1
    # A running maximum of the ends within each document: documents are set apart by an offset.
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step)
    cut = np.flatnonzero(np.concatenate([[True], new[1:] | (start[1:] + group[1:] * step > reach[:-1])]))
    last = np.concatenate([cut[1:], [len(doc)]]) - 1
    return doc[cut], start[cut], reach[last] - group[last] * step


#: kind 0: a covered range (at, to); 1: an anchor's context (at, to = windows * 128 + the anchor's place).
_ROWS = ["gram", "context", "doc", "at", "to", "kind"]


def _batch(columns, kind: int) -> pa.RecordBatch:
    columns = [np.asarray(c, _I) for c in columns]
    return pa.record_batch([*map(pa.array, columns), pa.array(np.full(len(columns[0]), kind, np.int8))], names=_ROWS)


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), _I)
            data, offsets = text_bytes(batch.column(1))
            found = []
            for lo, hi in slices(offsets):
                doc, *rest = anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                found.append((ids[lo:hi][doc], *rest))
            if not found:
                continue
            doc, gram, context, at, count, inside = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((at, doc, context, gram))
            same = np.zeros(len(order), bool)
            same[1:] = (gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])
            later = order[same]
            d, s, e = _runs(doc[later], at[later], at[later] + count[later] + length - 1)
            yield _batch((mix(d.astype(_U)), np.zeros(len(d)), d, s, e), 0)
            keep = order[~same]
            for part in np.array_split(keep, max(1, len(keep) >> 18)):
                yield _batch((gram[part], context[part], doc[part], at[part], count[part] * 128 + inside[part]), 1)

    return docs.mapInArrow(run, "gram long, context long, doc long, at long, to long, kind byte")


def _settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered ranges of equal contexts; one context of each kind for anchors that have several. Rows come in order; only the last row's state is held.

    A divided anchor's other contexts can be elsewhere: each of its kinds gives one.
    """
    last: tuple[int, int] | None = None  # the anchor and context of the row before
    single: tuple | None = None  # the first context of the last anchor, while it is the only one
    for batch in batches:
        if not len(batch):
            continue
        gram, context, doc, at, to, kind, divided = (np.asarray(batch.column(i)) for i in range(7))
        done = kind == 0
        yield _batch((gram[done], context[done], doc[done], at[done], to[done]), 0)
        gram, context, doc, at, to, divided = (c[~done].astype(_I) for c in (gram, context, doc, at, to, divided))
        if not len(gram):
            continue
        before = last or (~int(gram[0]), 0)
        same_gram = gram == np.concatenate([[before[0]], gram[:-1]])
        same = same_gram & (context == np.concatenate([[before[1]], context[:-1]]))
        yield _batch((gram[same], context[same], doc[same], at[same], at[same] + to[same] // 128 + length - 1), 0)
        new = np.flatnonzero(~same)
        last = (int(gram[-1]), int(context[-1]))
        if not len(new):
            continue
        # Of the distinct contexts, those whose anchor has another before or after; the last anchor's single one waits.
        starts = ~same_gram[new]
        follows = np.concatenate([~starts[1:], [False]])
        several = ~starts | follows | (divided[new] == 1)
        if single is not None:
            if not starts[0]:
                yield _batch([[x] for x in single], 1)
            single = None
        k = new[-1]
        if starts[-1] and not divided[k]:
            single = (gram[k], context[k], doc[k], at[k], to[k])
        keep = new[several]
        yield _batch([c[keep] for c in (gram, context, doc, at, to)], 1)


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(bytes, indices of suffixes) of the maximal repeats of at least ``length`` bytes among suffixes.

    A suffix runs from starts to ends; left is the byte before it, or negative where it
    begins its text. The suffix array is first cut by the hash of the first ``length`` bytes,
    as suffixes of other prefixes share no interval; within, it is in the order of bytes.
    """
    if not len(starts):
        return []
    prefix = between(prefix_sums(data), starts, starts + length)
    by = np.argsort(prefix, kind="stable")
    edge = np.concatenate([[True], prefix[by][1:] != prefix[by][:-1]])
    sizes = np.diff(np.concatenate([np.flatnonzero(edge), [len(by)]]))
    own = np.repeat(sizes, sizes) > 1
    by, group = by[own], np.repeat(np.arange(len(sizes)), sizes)[own]
    if not len(by):
        return []
    size = ends[by] - starts[by]
    width = -(-int(size.max()) // 8) * 8
    out: list[tuple[int, np.ndarray]] = []
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)
    # Rows of the matrix of suffixes are sorted in parts of bounded memory that end between groups.
    for part in _parts(group, max(1, (6 << 20) // width)):
        b, g, n = by[part], group[part], size[part]
        text = rows[starts[b]]
        text[np.arange(width, dtype=np.int32) >= n[:, None].astype(np.int32)] = 0
        words = text.view(">u8")
        order = np.lexsort((n, *(words[:, j] for j in reversed(range(width // 8))), g))
        text, n, g, b = text[order], n[order], g[order], b[order]
        differ = text[1:] != text[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common = np.minimum(np.minimum(common, n[1:]), n[:-1])
        common[g[1:] != g[:-1]] = 0
        out += [(depth, b[lo : hi + 1]) for depth, lo, hi in intervals(common, left[b], length)]
    return out


def _parts(group: np.ndarray, rows: int) -> Iterator[slice]:
    lo, n = 0, len(group)
    while lo < n:
        hi = min(n, lo + rows)
        if hi < n:
            hi = int(np.searchsorted(group, group[hi - 1], "right"))
        yield slice(lo, hi)
        lo = hi


_MANY = -2


def intervals(common: np.ndarray, left: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of depth ``length`` or more that differ to the left.

    common: the common prefixes of neighbours in the suffix array. One scan with a stack of
    open intervals, each with its one left byte, or _MANY.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # depth, first, left byte
    sides = [x if x >= 0 else _MANY for x in left.tolist()]
    for i, depth in enumerate([*common.tolist(), 0]):
        # The suffix at i lies below the open interval, or below the one that opens here.
        first, side = i, sides[i]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            if top[2] != side:
                top[2] = _MANY
            if top[2] == _MANY:
                found.append((top[0], top[1], i))
            first, side = top[1], top[2]
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != side:
                stack[-1][2] = _MANY
        elif depth >= length:
            stack.append([depth, first, side])
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches joined so that none ends inside a block; a block holds some BLOCK contexts."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        key = np.asarray(table["block"])
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut > 0 or np.asarray(held[0]["block"])[0] != key[-1]):
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held = []
        elif cut:
            yield table.slice(0, cut)
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held)


def _arrays(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered ranges by the suffix arrays of the contexts (kind 0: doc, start, end), and of divided anchors each different window's first place (kind 1: doc, start, and 128 bits that name the window)."""
    held: list[pa.Table] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        held.clear()
        doc, at, count, divided = (np.asarray(table[c]) for c in ("doc", "at", "count", "divided"))
        data, offsets = text_bytes(table["bytes"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        context = np.repeat(np.arange(len(doc)), count)
        window = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
        starts, ends = offsets[context] + window, offsets[context + 1]
        left = np.where(window > 0, data[np.maximum(starts - 1, 0)].astype(_I), -1)
        place = at[context] + window
        out = [[], [], []]
        for depth, members in maximal_repeats(data, starts, ends, left, length):
            d, p = doc[context[members]], place[members]
            least = np.lexsort((p, d))[0]
            later = (d != d[least]) | (p != p[least])
            for column, x in zip(out, (d[later], p[later], p[later] + depth), strict=True):
                column.append(x)
        runs = _runs(*(np.concatenate([np.zeros(0, _I), *c]) for c in out))
        yield _places(0, *runs, np.zeros(len(runs[0]), _I))
        again = np.flatnonzero(divided[context])
        if len(again):
            sums, half, start = prefix_sums(data), length // 2, starts[again]
            one = between(sums, start, start + length)
            two = mix(between(sums, start, start + half) * _U(0xC2B2AE3D27D4EB4F) + between(sums, start + half, start + length))
            d, p = doc[context[again]], place[again]
            order = np.lexsort((p, d, two, one))
            first = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            keep = order[first]
            yield _places(1, d[keep], p[keep], one[keep].astype(_I), two[keep].astype(_I))

    for table in _blocks(batches):
        held.append(table)
        size += table["bytes"].nbytes
        if size > ARRAY_BYTES:
            yield from flush()
            size = 0
    if held:
        yield from flush()


_PLACES = "doc long, start long, a long, b long, kind byte"


def _places(kind: int, doc, start, a, b) -> pa.RecordBatch:
    columns = [np.asarray(c, _I) for c in (doc, start, a, b)]
    return pa.record_batch([*map(pa.array, columns), pa.array(np.full(len(columns[0]), kind, np.int8))], names=["doc", "start", "a", "b", "kind"])


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The contexts (doc, text, wanted) as bytes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        wanted = batch.column(2)
        many = np.diff(np.asarray(wanted.offsets))
        row = np.repeat(np.arange(len(batch)), many)
        flat = wanted.flatten()
        block, divided, at, to = (np.asarray(flat.field(i)) for i in range(4))
        doc = np.asarray(batch.column(0))[row]
        for part in np.array_split(np.arange(len(row)), max(1, len(row) >> 15)):
            lo = offsets[row[part]] + at[part]
            n = to[part] // 128 + length - 1
            ends = np.cumsum(n)
            place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - lo, n)
            bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(_I)), pa.py_buffer(np.ascontiguousarray(data[place]))])
            yield pa.record_batch([pa.array(block[part]), pa.array(divided[part]), pa.array(doc[part]), pa.array(at[part]), pa.array(to[part] // 128), bytes_.cast(pa.binary())], names=["block", "divided", "doc", "at", "count", "bytes"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        covers = batch.column(2)
        to = np.asarray(covers.offsets, _I) if len(batch) else np.zeros(1, _I)
        flat = covers.flatten()
        start, end = (np.asarray(flat.field(i), _I) for i in range(2))
        to = to - to[0]
        removed, spans, sha, text = [], [], [], []
        for i in range(len(batch)):
            own = data[offsets[i] : offsets[i + 1]]
            _, s, e = _runs(np.zeros(to[i + 1] - to[i], _I), start[to[i] : to[i + 1]], end[to[i] : to[i + 1]])
            cuts = np.concatenate([[0], np.stack([s, e], 1).ravel(), [len(own)]]) if len(s) else np.array([0, len(own)])
            rest = b"".join(own[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            removed.append(len(own) - len(rest))
            spans.append(len(s))
            sha.append(hashlib.sha256(rest).hexdigest())
            text.append(rest)
        yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dealt(texts: DataFrame, length: int, block: int) -> DataFrame:
    """Anchors with their contexts, in order, dealt by the anchor; those of an anchor that occurs more than ``block`` times also by the context.

    Anchors are counted over all texts first, which reads the texts twice: a count is smaller
    than the rows that it keeps out of one task. Equal contexts stay together in any case.
    """
    anchored = _anchored(texts, length)
    hot = written(anchored.filter("kind = 1").groupBy("gram").count().filter(F.col("count") > block).select("gram", F.ceil(F.col("count") / block).alias("parts")), "frequent-anchors")
    part = F.pmod(F.xxhash64("context"), F.coalesce("parts", F.lit(1)))
    placed = anchored.join(hot, "gram", "left").select(*_ROWS, F.col("parts").isNotNull().alias("divided"), part.alias("part"))
    return placed.repartition("gram", "part").drop("part").sortWithinPartitions("gram", "context", "doc", "at")


def blocked(contexts: DataFrame, block: int) -> DataFrame:
    """(doc, block, divided, at, to): an anchor's contexts are one block; those of an anchor with more than ``block`` are divided by their hash."""
    # A table of its own: the join then has no aggregate on either side, is a broadcast where the table is small, and can be split where it is not.
    hot = written(contexts.groupBy("gram").count().filter(F.col("count") > block).select("gram", F.ceil(F.col("count") / block).alias("parts")), "hot-anchors")
    part = F.pmod(F.xxhash64("context"), F.coalesce("parts", F.lit(1)))
    return contexts.join(hot, "gram", "left").select("doc", F.xxhash64("gram", part).alias("block"), F.col("parts").isNotNull().alias("divided"), "at", "to")


def dedup(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """One row per document: its bytes, the removed bytes and runs, the digest of the rest, and the rest.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier.
    """
    if not GRAM <= length <= 2 * GRAM + 62:
        raise ValueError(f"length must be {GRAM} to {2 * GRAM + 62}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").head() is not None
    if ordered:
        order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
        docs = written(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "ordered")
    else:
        docs = docs.withColumn("doc", F.col("doc_id"))
    texts = docs.select("doc", "text")
    settled = written(dealt(texts, length, block).mapInArrow(lambda b: _settled(b, length), "gram long, context long, doc long, at long, to long, kind byte"), "settled")
    wanted = blocked(settled.filter("kind = 1"), block).groupBy("doc").agg(F.collect_list(F.struct("block", "divided", "at", "to")).alias("wanted"))
    fetched = texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(lambda b: _fetched(b, length), "block long, divided boolean, doc long, at long, count long, bytes binary")
    places = fetched.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _arrays(b, length), _PLACES)
    places = written(places, "repeats")
    # Windows that stand first in several blocks of one anchor: all but the very first are covered.
    each = places.filter("kind = 1").select("a", "b", "doc", "start")
    least = each.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("least"))
    later = each.join(least, ["a", "b"]).filter(F.struct("doc", "start") != F.col("least")).select("doc", "start", (F.col("start") + length).alias("end"))
    covered = places.filter("kind = 0").select("doc", "start", F.col("a").alias("end")).unionByName(later)
    ranges = settled.filter("kind = 0").select("doc", F.col("at").alias("start"), F.col("to").alias("end")).unionByName(covered)
    by_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("covers"))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    final = texts.join(by_doc, "doc", "left").select("doc", "text", F.coalesce("covers", empty).alias("covers")).mapInArrow(_kept, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if ordered:
        return docs.select("doc", "doc_id").join(final, "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return final.withColumnRenamed("doc", "doc_id")
