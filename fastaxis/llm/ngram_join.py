"""Operator 8, n-gram Jaccard self-join by vertical partitioning, and its components.

The global order of n-grams is that of their 64-bit hashes, cut into fragments. Two sets
that link differ in at most D n-grams, D following from their sizes; with more than D
fragments of which none is empty, at least one fragment is the same in both. So every
document is represented by the hashes of its fragments, at fragment counts that fit its
size class and the class below, and only documents that share a fragment are compared.
Their n-grams are then cut into a few vertical parts; the overlap of each part is counted
as a row of its own, and the counts are summed per pair.

What keeps groups small without losing links:

* equal sets are one set (rows are kept apart only to hand out the component);
* n-grams that a fixed share of all documents has are left out of the fragments, as
  leaving n-grams out never adds a difference; there are at most 2 * mean set size / share of
  them, which bounds what is broadcast. A document for which too few fragments remain is
  also represented by the fragments of its whole set, and if these are too few as well,
  by the prefix of its sorted hashes that any linked set must touch;
* documents that share a fragment are first compared with one of them each, the one that
  shares most fragments with others. After the components of those links, only documents
  that share a fragment across components are left. Among these the n-grams are ordered by
  their exact frequency, rarest first; n-grams of one document only count as places, never
  as rows; and pairs across components that share an n-gram of both prefixes, at places from
  which their sizes still allow a link, are compared.

Every step is a DataFrame; components are found by written rounds (see graph.components).

Defined results: a null, empty or wordless text has an empty set, links with nothing and
is its own component; repeated rows are repeated in the result; rows without a doc_id come
back with a null component and link with nothing; an empty table gives none; further
columns are not read. If several rows share a doc_id, their links are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import gram_hashes, may_hold, mix, remove, sketch, slices, span_hashes, text_bytes, white_table, word_spans, written
from fastaxis.llm.graph import components

#: Share of all documents from which on an n-gram is left out of the fragments.
HOT_SHARE = 1 / 500
#: Vertical parts in which overlaps are counted; bits of the sketch of documents to compare.
PARTS, SKETCH = 4, 1 << 22
#: Bits of the sketch of keys that several documents have.
KEYS = 1 << 26
_WHITE = white_table(lower=True)
_SIGNED = np.int64


class Sizes:
    """Size classes for a threshold of percent / 100, and what may differ between two linked sets."""

    def __init__(self, percent: int):
        self.percent, self.upper = percent, [0]

    def class_of(self, n: int | np.ndarray) -> np.ndarray:
        most = np.max(n, initial=0)
        while self.upper[-1] < most:
            low = self.upper[-1] + 1
            self.upper.append(max(low, low * 100 // self.percent))
        return np.searchsorted(self.upper, n)

    def differences(self, k: int | np.ndarray) -> np.ndarray:
        """The most n-grams in one set only, for linked sets of class k, or of k and k + 1."""
        u = np.asarray(self.upper)[k]
        return (100 - self.percent) * (u + u * 100 // self.percent) // (100 + self.percent)


def places(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, the end included."""
    return np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])


def document_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, grams, to) of each slice of a batch (text in column 1): the sorted distinct n-gram hashes of the documents from that row on, and their offsets."""
    data, offsets = text_bytes(batch.column(1))
    for lo, hi in slices(offsets):
        part = _WHITE[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        grams, to = gram_hashes(span_hashes(part, starts, ends), first, n)
        for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
            grams[a:b].sort()
        fresh = np.ones(len(grams), bool)
        fresh[1:] = grams[1:] != grams[:-1]
        fresh[to[:-1][to[:-1] < to[1:]]] = True
        yield lo, grams[fresh], places(fresh)[to]


def set_keys(grams: np.ndarray, to: np.ndarray) -> list[tuple[int, int]]:
    """128 bits that name each set."""
    halves = []
    for values in (mix(grams ^ np.uint64(0x5851F42D4C957F2D)), mix(grams + np.uint64(0x14057B7EF767814F))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        halves.append((sums[to[1:]] - sums[to[:-1]]).astype(_SIGNED).tolist())
    return list(zip(*halves, strict=True))


def gathered(grams: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the grams one after another, and their offsets."""
    to = places(lengths)
    return grams[np.arange(to[-1]) + np.repeat(starts - to[:-1], lengths)], to


def fragments(grams: np.ndarray, to: np.ndarray, count: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the non-empty of so many fragments of each sorted set, and their offsets."""
    owner = np.repeat(np.arange(len(count)), np.diff(to))
    at = ((grams >> np.uint64(32)) * count.astype(np.uint64)[owner]) >> np.uint64(32)
    new = np.ones(len(grams), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(mix(grams ^ np.uint64(0xA0761D6478BD642F)), starts) if len(starts) else np.zeros(0, np.uint64)
    salted = (salt.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))[owner[starts]]
    return mix(sums + at[starts] * np.uint64(0xE7037ED1A0B428DB) + salted), np.searchsorted(starts, to)


def lookups(grams: np.ndarray, to: np.ndarray, hot: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, set, lot): the hashes under which sets are looked up; two linked sets that aren't equal share, in one lot, as many as it needs.

    A lot is numbered by its size class and kind, times 2^20, plus that need: the fragments
    that can't all differ.
    """
    n = np.diff(to)
    rare, rare_to = grams, to
    if len(hot):
        keep = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] != grams
        rare, rare_to = grams[keep], places(keep)[to]
    k, out = sizes.class_of(n), []

    def divided(own: np.ndarray, own_to: np.ndarray, sets: np.ndarray, c: np.ndarray, d: np.ndarray, kind: int) -> np.ndarray:
        """Adds the fragments of some sets; says for which of them they are too few."""
        part, part_to = gathered(own, own_to[sets], np.diff(own_to)[sets])
        found, found_to = fragments(part, part_to, d + 3 + d // 8, 3 * c + kind)
        size = np.diff(found_to)
        out.append((found, np.repeat(sets, size), np.repeat((3 * c + kind << 20) + np.maximum(1, size - d), size)))
        return size <= d

    for c in (k, k - 1):
        d = sizes.differences(c)
        sets = np.flatnonzero(d > 0)
        few = sets[divided(rare, rare_to, sets, c[sets], d[sets], 0)]
        whole = np.diff(rare_to)[few] == n[few]
        again = few[~whole]
        left = np.concatenate([few[whole], again[divided(grams, to, again, c[again], d[again], 1)]])
        prefix = n[left] - -(-sizes.percent * n[left] // 100) + 1
        found, _ = gathered(grams, to[left], prefix)
        out.append((mix(found + np.uint64(0x589965CC75374CC3)), np.repeat(left, prefix), np.repeat((3 * c[left] + 2 << 20) + 1, prefix)))
    hashes, owners, lots = (np.concatenate(x) for x in zip(*out, strict=True))
    return hashes, owners, lots


def representatives(grams: np.ndarray, hot: np.ndarray, sizes: Sizes) -> list[tuple[np.ndarray, int]]:
    """The hashes under which one set is looked up, in lots."""
    hashes, _, lots = lookups(grams, np.array([0, len(grams)]), hot, sizes)
    return [(hashes[lots == lot], int(lot)) for lot in np.unique(lots)]


def _surveyed(docs: DataFrame, n: int, share: float) -> DataFrame:
    """kind 0: a document, its set's size and key; kind 1: an n-gram frequent in a batch, and its count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, seen, own = [], set(), []
            for row, grams, to in document_sets(batch, n):
                keys, size = set_keys(grams, to), np.diff(to)
                rows += [(0, ids[row + i], m, a, b) for i, (m, (a, b)) in enumerate(zip(size.tolist(), keys, strict=True))]
                fresh = np.array([key not in seen and not seen.add(key) for key in keys], bool)
                own.append(np.sort(grams[np.repeat(fresh, size)]))
            least = max(4, int(len(seen) * share / 2))
            # In ranges of the hash, so that the counts take bounded memory.
            shares = max(1, sum(map(len, own)) // (1 << 20))
            edges = [np.uint64(min(2**64 - 1, (2**64 * j) // shares)) for j in range(shares + 1)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                values, counts = np.unique(np.concatenate([g[np.searchsorted(g, lo) : np.searchsorted(g, hi)] for g in own] or [np.zeros(0, np.uint64)]), return_counts=True)
                rows += [(1, int(v), int(c), 0, 0) for v, c in zip(values[counts >= least].astype(_SIGNED), counts[counts >= least], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["kind", "x", "n", "a", "b"])

    return docs.mapInArrow(run, "kind int, x long, n long, a long, b long")


def _represented(docs: DataFrame, n: int, percent: int, hot, screen=None) -> DataFrame:
    """(key, doc, lot) of a batch's distinct sets; of the keys only those that the screen can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, frequent = Sizes(percent), hot.value
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            valid = np.asarray(batch.column(0).is_valid())
            seen = set()
            for row, grams, to in document_sets(batch, n):
                size = np.diff(to)
                usable = (valid[row : row + len(size)] & (size > 1)).tolist()
                fresh = np.flatnonzero([ok and key not in seen and not seen.add(key) for ok, key in zip(usable, set_keys(grams, to), strict=True)])
                hashes, owners, lots = lookups(*gathered(grams, to[fresh], size[fresh]), frequent, sizes)
                if screen is not None:
                    held = may_hold(screen.value, hashes)
                    hashes, owners, lots = hashes[held], owners[held], lots[held]
                if len(hashes):
                    yield pa.record_batch([pa.array(hashes.astype(_SIGNED)), pa.array(ids[row + fresh[owners]]), pa.array(lots)], names=["key", "doc", "lot"])

    return docs.mapInArrow(run, "key long, doc long, lot long")


def _parts(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(doc, part, n, grams): the vertical parts of the sets of the needed documents.

    The documents are first screened by a sketch of fixed size; the joins that follow are exact.
    """
    screen = needed.sparkSession.sparkContext.broadcast(sketch(needed, F.xxhash64("doc"), SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(screen.value, np.asarray(batch.column(2), np.int64))))
            ids = np.asarray(batch.column(0), np.int64)
            for row, grams, to in document_sets(batch, n):
                size = np.diff(to)
                owner, part = np.repeat(np.arange(len(size)), size), (grams >> np.uint64(62)).astype(np.int32)
                new = np.ones(len(grams), bool)
                new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                if len(at):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(grams)), pa.int32()), pa.array(grams.astype(_SIGNED)))
                    yield pa.record_batch([pa.array(ids[row + owner[at]]), pa.array(part[at]), pa.array(size[owner[at]]), lists], names=["doc", "part", "n", "grams"])

    screened = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("bit"))
    return screened.mapInArrow(run, "doc long, part int, n long, grams array<long>")


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link: overlaps counted part by part and summed."""
    one = parts.select(F.col("doc").alias("a"), "part", F.col("n").alias("na"), F.col("grams").alias("ga"))
    two = parts.select(F.col("doc").alias("b"), "part", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    counted = pairs.join(one, "a").join(two, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("shared"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return written(summed.filter(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).select("a", "b").distinct(), "linked")


def across(parts: DataFrame, placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the placed documents (doc, c) in different components that may link: prefixes in the order of frequency, a written table of which is the second result."""
    grams = parts.join(placed, "doc").select("doc", "n", "c", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    lists = grams.join(often, "gram").groupBy("doc", "n", "c").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    # The n-grams of this document alone stand first.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("grams"))
    prefixes = lists.filter(prefix > 0).withColumn("alone", F.col("n") - F.size("grams")).select("doc", "n", "c", "alone", F.posexplode(F.slice("grams", F.lit(1), prefix.cast("int"))).alias("rank", "x")).select("doc", "n", "c", "alone", "rank", F.col("x.gram").alias("gram"))
    prefixes = written(prefixes, "prefixes")
    x, y = (prefixes.select("gram", *[F.col(k).alias(f"{k}{i}") for k in ("doc", "n", "c", "alone", "rank")]) for i in (1, 2))
    left = lambda i: F.col(f"n{i}") - F.col(f"alone{i}") - F.col(f"rank{i}")
    # A pair that links passes this at its first common n-gram, before which it has none in common.
    most = F.least(left(1), left(2))
    may = (F.col("c1") != F.col("c2")) & (F.col("doc1") < F.col("doc2")) & (most * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)
    return x.join(y, (x["gram"] == y["gram"]) & may).select(F.col("doc1").alias("a"), F.col("doc2").alias("b")).distinct(), prefixes


def _mixed(rows: DataFrame, value: str) -> DataFrame:
    """(key) of the keys whose rows hold more than one value."""
    return rows.groupBy("key").agg(F.min(value).alias("low"), F.max(value).alias("high")).filter("low < high").select("key")


def _enough(rows: DataFrame) -> DataFrame:
    """(doc, lot) of the lots of which a document still has as many keys as a link needs."""
    return rows.groupBy("doc", "lot").count().filter(F.col("count") >= F.col("lot") % (1 << 20)).select("doc", "lot")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per document: the size of its n-gram set and the smallest doc_id reachable by links.

    What concerns a key is aggregated, with partial results, and joined to the key's rows: a
    key that many documents have is then a skewed join, which adaptive execution splits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = written(_surveyed(docs, n, hot_share), "survey")
    sets = survey.filter("kind = 0").select(F.col("x").alias("doc_id"), F.col("n").alias("n_shingles"), "a", "b")
    many = survey.filter("kind = 1").groupBy("x").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(max(4.0, sets.count() * hot_share / 2)))
    hot = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in many.select("x").toLocalIterator()), _SIGNED).astype(np.uint64)))

    # A table of its own, so that the join has plain shuffles on both sides and the rows of a hot set can be split.
    first = written(sets.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("first")), "firsts")
    sets = written(sets.join(first, ["n_shingles", "a", "b"], "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first")), "sets")
    remove(survey, first)

    # Most keys belong to one document: they are counted first, and only the others' rows are made again and kept.
    shared = written(_mixed(_represented(docs, n, percent, hot), "doc"), "shared-keys")
    screen = spark.sparkContext.broadcast(sketch(shared, F.col("key"), KEYS))
    looked_up = written(_represented(docs, n, percent, hot, screen).join(shared, "key"), "looked-up")
    left = looked_up.join(_enough(looked_up), ["doc", "lot"])
    again = written(_mixed(left, "doc"), "shared-keys")
    buckets = written(left.join(again, "key"), "buckets")
    remove(shared, looked_up, again)
    sizes = written(buckets.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    sharing = written(buckets.join(sizes, "key").groupBy("doc").agg(F.sum("size").alias("keys")), "sharing")
    parts = written(_parts(docs, sharing.select("doc"), n).join(sharing.select("doc"), "doc"), "parts")
    # The hub of a bucket is the document whose buckets hold the most documents, as those of an original do; each document meets its most frequent hub.
    rank = F.struct(F.col("keys"), (-F.col("doc")).alias("minus"))
    hubs = written(buckets.join(sharing, "doc").groupBy("key").agg((-F.max(rank)["minus"]).alias("hub")), "hubs")
    met = buckets.join(hubs, "key").filter("doc <> hub").groupBy("doc", "hub").count()
    stars = written(met.groupBy("doc").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")).select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct(), "stars")
    remove(sizes, sharing, hubs)
    links = linked(stars, parts, percent)

    found = components(links)
    joined = written(buckets.join(found, F.col("doc") == F.col("node"), "left").select("key", "doc", "lot", F.coalesce("component", "doc").alias("c")), "joined")
    apart = written(_mixed(joined, "c"), "shared-keys")
    mixed = written(joined.join(apart, "key").select("doc", "lot", "c"), "mixed")
    open_ = written(mixed.join(_enough(mixed), ["doc", "lot"]).select("doc", "c").distinct(), "open")
    remove(stars, buckets, found, joined, apart, mixed)
    candidates, prefixes = across(parts, open_, percent)
    candidates = written(candidates, "across")
    more = linked(candidates, parts, percent)
    remove(open_, prefixes, candidates, parts)

    owner = sets.select("doc_id", "first").groupBy("doc_id").agg(F.min("first").alias("first"))
    named = lambda df, c: df.join(owner.withColumnsRenamed({"doc_id": c, "first": f"{c}0"}), c).drop(c).withColumnRenamed(f"{c}0", c)
    whole = components(named(named(links.unionByName(more), "a"), "b"))
    remove(links, more)
    return sets.join(whole, sets["first"] == whole["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one of each group of linked documents stays: that of the smallest doc_id.

    Rows without a doc_id stay, as nothing can refer to them. Where a doc_id repeats, its rows are documents of their
    own: they go if their texts link with a row before them (in the order of doc_id, then of their place), and stay if not.
    """
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").head() is not None
    if not again:
        found = written(jaccard_components(docs, n, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")), "groups")
        return docs.join(found, docs["doc_id"].cast("long") == found["gone"], "left_anti")
    numbered = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("id", F.monotonically_increasing_id()), "numbered")
    named = numbered.filter(F.col("row")["doc_id"].isNotNull())
    found = written(jaccard_components(named.select(F.col("id").alias("doc_id"), F.col("row")["text"].alias("text")), n, percent), "groups")
    place = F.struct(F.col("row")["doc_id"].alias("doc_id"), F.col("id"))
    stays = named.join(found, named["id"] == found["doc_id"]).groupBy("component_id").agg(F.min(place)["id"].alias("id")).select("id")
    left = named.join(stays, "id").select("row").unionByName(numbered.filter(F.col("row")["doc_id"].isNull()).select("row"))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
