"""Operator 5, toxicity by class-conditional Kneser-Ney models of expressions.

Expressions are the words and the runs of two words of a text (up to ORDER). Each class,
ordinary and toxic, has a Kneser-Ney model of each order: a count less an absolute discount,
and the mass set free goes to a smoother model. That of the ordinary class is one which both
classes share: its counts are continuation counts, the number of labelled documents of either
class that an expression turns up in, discounted in turn towards all expressions alike. That
of the toxic class, which has fewer texts, is the ordinary model. So a rare expression is
smoothed to what both classes say about it, whichever happens to hold it. Every discount is
estimated from the counts of counts, n1 / (n1 + 2 n2) with one added to n1 and two to the
divisor, so it lies between 0 and 1 and an expression seen once keeps evidence of its own.

A toxic text is mostly ordinary words. Its likelihood is therefore that of an ordinary text
of which a share SHARE of expressions comes from the toxic model. A document's evidence of each
order is the difference of its log-likelihoods as a toxic and as an ordinary text, with its
sign, normalised by its length (by the root of the words, as sums of chance differences grow).
A logistic curve over the orders' evidence on a scale logarithmic at both ends and the length,
fitted on labelled documents outside the models' training, gives the score.

Labels are used only of rows with crc32(doc_id as text) mod 5 other than 0: those of
remainder CALIBRATION calibrate (a bounded sample of them, CALIBRATION_ROWS), the others
and what the sample leaves are counted for the models, all of them. An expression that no toxic
text has is, by the formula, as much evidence as an unseen one; it counts in all sums and
needs no row of its own. All others stand in a written table. The
frequent ones, BROADCAST at most, are sent to the tasks (5 MB) and summed in the pass over the texts;
each row's distinct others, screened by a sketch of fixed size, are joined with the table.

Defined results: null is an empty text; a text without words gets the score of no evidence;
labels of null, or of documents that are not there, are left out, of several labels of a
doc_id the largest holds; without labels of both classes every score is the share of toxic
labels (0 without any); repeated rows are repeated; a null doc_id is not held out; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import frequency_cut, hash_sample, is_small, may_hold, mix, remove, sketch, slices, span_hashes, text_bytes, word_spans, written

#: Words of the longest expressions; share of toxic expressions in a toxic text.
ORDER, SHARE = 2, 0.003
#: Evidence about which the curve's scale turns from linear to logarithmic.
SCALE = 0.01
_GAINS = [f"gain_{k}" for k in range(1, ORDER + 1)]
#: COMMON, BROADCAST and SKETCH only say which expressions are broadcast (those seen COMMON times or more, so that rarer ones
#: are joined at every size, and at most so many), and how well the others are screened before their join.
COMMON, BROADCAST, SKETCH = 3, 400_000, 1 << 26
CALIBRATION_ROWS, CALIBRATION = 50_000, 1
#: Labels up to so many are broadcast to the documents; more are joined by a shuffle.
SMALL_LABELS = 2_000_000
_WORD = np.array([b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256)], np.uint8)
_I, _U = np.int64, np.uint64


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def expressions(texts: pa.Array) -> Iterator[tuple]:
    """Of slices of a column of texts: first and end row, each row's number of words, and for each order the distinct keys, and each expression's number among them and its row in the slice."""
    data, offsets = text_bytes(texts)
    for lo, hi in slices(offsets):
        part = _WORD[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        words, row = span_hashes(part, starts, ends), np.repeat(np.arange(hi - lo), np.diff(first))
        found, key = [], np.zeros(len(words), _U)
        for k in range(ORDER):
            # The first words of the expressions of k + 1 words, their following words, their rows.
            n = max(0, len(words) - k)
            key = mix(key[:n] * _U(0xC2B2AE3D27D4EB4F) + words[k:] + _U(k))
            whole = row[:n] == row[k:]
            distinct, number = np.unique(key[whole], return_inverse=True)
            found.append((distinct, number, row[:n][whole]))
        yield lo, hi, np.diff(first), found


def counts(labelled: DataFrame) -> DataFrame:
    """(length, key, c0, c1, docs): how often each expression occurs in ordinary and in toxic documents, and in how many of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1), _I)
            for lo, hi, _, found in expressions(batch.column(0)):
                for k, (keys, number, row) in enumerate(found, 1):
                    n, c1 = len(keys), np.bincount(number, toxic[lo:hi][row], len(keys)).astype(_I)
                    in_rows = np.bincount(np.unique(number * (hi - lo) + row) // max(1, hi - lo), minlength=n)
                    columns = (np.full(n, k, np.int32), keys.astype(_I), np.bincount(number, minlength=n) - c1, c1, in_rows)
                    yield pa.record_batch([pa.array(c) for c in columns], names=["length", "key", "c0", "c1", "docs"])

    local = labelled.select("text", "toxic").mapInArrow(run, "length int, key long, c0 long, c1 long, docs long")
    return local.groupBy("length", "key").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "docs")])


#: Counts of a kind of expression, and how many of them there are: at all, once, twice.
_COUNTED = ("c0", "c1", "docs")
_SUMS = [*_COUNTED, *[f"{n}_{c}" for c in _COUNTED for n in ("some", "once", "twice")]]


def gathered(seen: DataFrame) -> DataFrame:
    """The counts of expressions that toxic texts have, one by one, and the sums of all others under a null key."""
    has = lambda test: F.when(test, F.lit(1)).otherwise(F.lit(0))
    of_counts = [x for c in _COUNTED for x in (has(F.col(c) > 0).alias(f"some_{c}"), has(F.col(c) == 1).alias(f"once_{c}"), has(F.col(c) == 2).alias(f"twice_{c}"))]
    rows = seen.select("length", F.when(F.col("c1") > 0, F.col("key")).alias("key"), *_COUNTED, *of_counts)
    return rows.groupBy("length", "key").agg(*[F.sum(c).alias(c) for c in _SUMS])


def discount(once: float, twice: float) -> float:
    return (once + 1) / (once + 2 * twice + 2)


class Model:
    """What expressions say: the evidence of an unseen one of each length, and what each one in the table adds to that.

    ``keys`` and ``value`` are the most frequent of the table, to be broadcast; ``rest``, None or
    a written table, holds all the others, and ``screen`` a sketch of their keys.
    """

    def __init__(self, labelled: DataFrame):
        table = written(gathered(counts(labelled)), "expressions")
        totals = {r["length"]: r.asDict() for r in table.groupBy("length").agg(*[F.sum(c).cast("double").alias(c) for c in _SUMS]).collect()}
        self.unseen, value = np.zeros(ORDER), F.lit(None).cast("double")
        for k, t in totals.items():
            if not (t["c0"] and t["c1"]):
                continue
            less = {c: discount(t[f"once_{c}"], t[f"twice_{c}"]) for c in _COUNTED}
            left = {c: less[c] * t[f"some_{c}"] / t[c] for c in _COUNTED}
            kept = lambda c: F.greatest(F.col(c) - F.lit(less[c]), F.lit(0.0)) / t[c]  # noqa: B023, E731
            self.unseen[k - 1] = np.log(1 - SHARE + SHARE * left["c1"])
            shared = kept("docs") + left["docs"] / (t["some_docs"] + 1)
            ordinary = kept("c0") + left["c0"] * shared
            ratio = kept("c1") / ordinary + left["c1"]
            value = F.when(F.col("length") == k, F.log(1 - SHARE + SHARE * ratio) - float(self.unseen[k - 1])).otherwise(value)
        every = table.filter("key is not null").select("key", "length", (F.col("c0") + F.col("c1")).alias("n"), value.alias("value")).filter("value is not null")
        cut = (F.col("n") >= COMMON) & frequency_cut(every, "n", BROADCAST)
        common = every.filter(cut).select("key", "value").toArrow()
        keys = np.asarray(common["key"].combine_chunks(), _I).astype(_U)
        order = np.argsort(keys)
        self.keys, self.value = keys[order], np.asarray(common["value"].combine_chunks(), np.float64)[order].astype(np.float32)
        rest = every.filter(~cut).select("key", "length", F.col("value").cast("float").cast("double").alias("value"))
        self.rest = None if rest.isEmpty() else written(rest, "rare-expressions")
        self.screen = None if self.rest is None else sketch(self.rest, F.col("key"), SKETCH)
        remove(table)


def summed(keys: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values of keys, and which of them the broadcast part has."""
    known, value = own
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[at] == keys
    return np.where(found, value[at], 0).astype(np.float64), found


def compared(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """n_words of each row's text and of each order ``gain_k``, the difference of its log-likelihoods beyond that of unseen expressions; ``extra`` columns are carried along."""
    sent = docs.sparkSession.sparkContext.broadcast(((model.keys, model.value), model.screen))
    others = model.rest is not None
    names = ["n_words", *_GAINS, *(["keys", "times"] if others else []), *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, screen = sent.value
        for batch in batches:
            n, gains = np.zeros(len(batch), _I), np.zeros((ORDER, len(batch)))
            lengths, hashes, times = [np.zeros(0, _I)], [np.zeros(0, _I)], [np.zeros(0, _I)]
            for lo, hi, words, found in expressions(batch.column(0)):
                n[lo:hi] = words
                rows, keys, many = [], [], []
                for k, (distinct, number, row) in enumerate(found):
                    value, known = summed(distinct, own)
                    gains[k, lo:hi] = np.bincount(row, value[number], hi - lo)
                    if others:
                        left = (~known & may_hold(screen, distinct))[number]
                        pair, count = np.unique(row[left] * len(distinct) + number[left], return_counts=True)
                        rows.append(pair // max(1, len(distinct)))
                        keys.append(distinct[pair % max(1, len(distinct))].astype(_I))
                        many.append(count)
                if others:
                    rows = np.concatenate(rows)
                    order = np.argsort(rows, kind="stable")
                    lengths.append(np.bincount(rows, minlength=hi - lo))
                    hashes.append(np.concatenate(keys)[order])
                    times.append(np.concatenate(many)[order])
            lists = []
            if others:
                to = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), pa.int32())
                lists = [pa.ListArray.from_arrays(to, pa.array(np.concatenate(x), pa.int64())) for x in (hashes, times)]
            yield pa.record_batch([pa.array(n), *map(pa.array, gains), *lists, *batch.columns[1:]], names=names)

    kinds = dict(docs.dtypes)
    schema = "n_words long, " + "".join(f"{g} double, " for g in _GAINS) + ("keys array<long>, times array<long>, " if others else "") + ", ".join(f"{c} {kinds[c]}" for c in extra)
    made = docs.select("text", *extra).mapInArrow(run, schema)
    if not others:
        return made
    # Rows are told apart by a number of their own; the table fixes it.
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    each = made.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    more = [F.sum(F.when(F.col("length") == k, F.col("value") * F.col("times")).otherwise(F.lit(0.0))).alias(f"more_{k}") for k in range(1, ORDER + 1)]
    sums = each.join(model.rest, "key").groupBy("row").agg(*more)
    whole = [(F.col(g) + F.coalesce(f"more_{k}", F.lit(0.0))).alias(g) for k, g in enumerate(_GAINS, 1)]
    return made.drop("keys", "times").join(sums, "row", "left").select("n_words", *whole, *extra)


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small penalty; x holds the constant."""
    weights = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    x = x / scale
    penalty = np.array([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights / scale


def evidence(model: Model) -> list[Column]:
    """Of compared() rows each order's whole difference of log-likelihoods by the root of the words, scaled."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.asinh(difference(model, k) / F.sqrt(n) / SCALE) for k in range(ORDER)]


def difference(model: Model, k: int) -> Column:
    return F.col(_GAINS[k]) + F.greatest(F.col("n_words") - k, F.lit(0)) * float(model.unseen[k])


def calibrated(found: DataFrame, model: Model) -> np.ndarray:
    """The logistic curve over compared() rows with their labels, of which a bounded number is read."""
    found = found.select("doc_id", "toxic", "n_words", *[x.alias(g) for x, g in zip(evidence(model), _GAINS, strict=True)])
    rows = hash_sample(found, "doc_id", 2 * CALIBRATION_ROWS, 0).toArrow()
    n, y, *gains = (np.asarray(rows[c].combine_chunks(), np.float64) for c in ("n_words", "toxic", *_GAINS))
    if 0 < y.sum() < len(y):
        n = np.maximum(n, 1)
        return curve(np.stack([np.ones(len(n)), *gains, np.log(n)], 1), y)
    share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
    return np.array([np.log(share / (1 - share)), *[0.0] * (ORDER + 1)])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score, predicted, and what the score comes from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", remainder(F.col("doc_id"))).filter("part > 0")
    labelled = docs.join(F.broadcast(marks) if is_small(marks, SMALL_LABELS) else marks, "doc_id")
    total = marks.filter(F.col("part") == CALIBRATION).count()
    # A bounded part of the fold calibrates; the models count the rest of it.
    apart = F.col("part") == CALIBRATION
    if total > CALIBRATION_ROWS:
        apart &= F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (1 << 40) * CALIBRATION_ROWS // total
    model = Model(labelled.filter(~apart))
    weights = calibrated(compared(labelled.filter(apart), model, ["doc_id", "toxic"]), model)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    z = F.lit(float(weights[0])) + sum((x * float(w) for x, w in zip([*evidence(model), F.log(n)], weights[1:], strict=True)), F.lit(0.0))
    out = compared(docs, model, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z)))))
    gap = sum((difference(model, k) for k in range(ORDER)), F.lit(0.0))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", gap.alias("gap"))
