"""Operator 6, line deduplication by a log-template tree of fixed depth.

A line is its tokens between white space; tokens with a digit are variable fields from the
start. The tree's levels are the number of tokens and the first ``depth`` tokens. Within a
leaf, a token whose support at its place (documents with a line of this leaf that has the token there)
is below ``min_docs`` is a variable field too, if at least ``min_constant`` of the line's
tokens stay; else the line is its own template. A template in ``min_docs`` documents or more
recurs: its first line (by document, then line) stays, all others are dropped.

Lines are 64-bit hashes of their tokens, and tokens of their leaf, place and bytes. Only leaves
with several different lines are looked at token by token; a sketch of fixed size screens the
texts for these, and another one the lines for those that may keep enough tokens, before the
exact join (what the sketches let through without need changes no result). Counts are combined before their shuffles, so a line that many documents
share is no large group; joins on lines can be split where they are skewed. Texts are
shuffled once, for the removal.

Defined results: null has no lines and stays null; lines of fewer than ``min_tokens`` tokens are never dropped, unless ``short`` is set;
rows without a doc_id are neither counted nor changed; rows of equal doc_id count as one
document; an empty table gives none; all other columns are handed on unchanged, whatever their
names (drop_recurring() alone replaces columns called n_lines and n_dropped).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import may_hold, mix, remove, sketch, slices, span_hashes, text_bytes, white_table, word_spans, written

SKETCH = 1 << 22
_I, _U = np.int64, np.uint64
_TABLE = white_table(lower=False)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_FIELD = _U(0x632BE59BD9B4E019)


def tokens(data: np.ndarray, offsets: np.ndarray, min_tokens: int, depth: int, short: bool = False) -> tuple[np.ndarray, ...]:
    """Of each line with enough tokens, or with any if ``short``: its document, number in it, leaf, hash and first token (n + 1), and all tokens' hashes."""
    place = np.flatnonzero(data == 10)
    # A line begins at a text's start and after each line feed.
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], place[place + 1 < len(data)] + 1]))
    doc = np.searchsorted(offsets, begin, "right") - 1
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    number = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else doc
    flat = _TABLE[data]
    starts, ends, first = word_spans(flat, np.concatenate([begin, [len(data)]]))
    hashes = span_hashes(flat, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[flat])])
    count = np.diff(first)
    few = count < min_tokens
    # A short line stands for itself, digits and all.
    hashes = np.where((digits[ends] > digits[starts]) & ~np.repeat(few, count), _FIELD, hashes)
    keep = count >= (1 if short else max(1, min_tokens))
    at = np.arange(len(hashes)) - np.repeat(first[:-1], count)
    spread = mix(hashes + at.astype(_U) * _U(0xA24BAED4963EE407))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(spread, dtype=_U)])
    line = mix(sums[first[1:]] - sums[first[:-1]] + count.astype(_U))
    leaf = mix(sums[np.minimum(first[1:], first[:-1] + depth)] - sums[first[:-1]] + count.astype(_U) * _U(0x9E3779B97F4A7C15))
    leaf = np.where(few, line, leaf)
    order = np.flatnonzero(keep)
    return doc[order], number[order], leaf[order].astype(_I), line[order].astype(_I), first[:-1][order], count[order], hashes


def _lines(docs: DataFrame, min_tokens: int, depth: int, short: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), _I)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                doc, number, leaf, line, *_ = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_tokens, depth, short)
                yield pa.record_batch([pa.array(ids[lo:hi][doc]), pa.array(number), pa.array(leaf), pa.array(line)], names=["doc", "at", "leaf", "line"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc long, at long, leaf long, line long")


def _keys_of(docs: DataFrame, leaves: DataFrame, min_tokens: int, depth: int) -> DataFrame:
    """(leaf, line, keys) of a batch's distinct lines that lie in the leaves, or that the sketch can't tell from them.

    A key names a token at its place in its leaf; a variable field's is 0.
    """
    screen = leaves.sparkSession.sparkContext.broadcast(sketch(leaves, F.col("leaf"), SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in slices(offsets):
                _, _, leaf, line, first, count, hashes = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_tokens, depth)
                keep = np.flatnonzero(may_hold(screen.value, leaf))
                keep = keep[np.unique(line[keep], return_index=True)[1]]
                n = count[keep]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                token = hashes[np.repeat(first[keep], n) + inside]
                key = mix(token + mix(np.repeat(leaf[keep], n).astype(_U) + inside.astype(_U) * _U(0xA24BAED4963EE407))).astype(_I)
                key[token == _FIELD] = 0
                to = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.record_batch([pa.array(leaf[keep]), pa.array(line[keep]), pa.ListArray.from_arrays(to, pa.array(key))], names=["leaf", "line", "keys"])

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "leaf long, line long, keys array<long>")


def templates(docs: DataFrame, lines: DataFrame, min_docs: int, min_constant: float, min_tokens: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(line, template) of the lines that are generalised, any other line being its own template; and the written tables that it reads."""
    per_line = written(lines.select("leaf", "line", "doc").distinct().groupBy("leaf", "line").agg(F.count("*").alias("docs")), "line-counts")
    leaves = written(per_line.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).filter((F.col("lines") > 1) & (F.col("docs") >= min_docs)).select("leaf"), "leaves")
    found = _keys_of(docs, leaves, min_tokens, depth).groupBy("leaf", "line").agg(F.first("keys").alias("keys"))
    placed = written(found.join(per_line, ["leaf", "line"]), "line-keys")
    remove(per_line, leaves)
    each = placed.select("docs", F.explode("keys").alias("key")).filter("key <> 0")
    constant = written(each.groupBy("key").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("key"), "constants")
    screen = docs.sparkSession.sparkContext.broadcast(sketch(constant, F.col("key"), SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            to = np.asarray(keys.offsets, _I)
            flat = np.asarray(keys.flatten(), _I)
            sums = np.concatenate([[0], np.cumsum(may_hold(screen.value, flat) & (flat != 0))])
            to = to - to[0]
            yield batch.filter(pa.array(sums[to[1:]] - sums[to[:-1]] >= min_constant * np.diff(to) - 1e-9))

    may = placed.select("leaf", "line", "keys").mapInArrow(run, "leaf long, line long, keys array<long>")
    kept = may.select("leaf", "line", F.size("keys").alias("n"), F.explode("keys").alias("key")).join(constant, "key")
    made = kept.groupBy("leaf", "line", "n").agg(F.count("*").alias("constants"), F.bit_xor("key").alias("template"))
    return made.filter(F.col("constants") >= F.col("n") * min_constant - 1e-9).select("line", F.xxhash64("leaf", "template").alias("template")), [placed, constant]


def recurring(docs: DataFrame, min_docs: int, min_constant: float, min_tokens: int, depth: int, support: int, short: bool) -> DataFrame:
    """(doc, dropped): the numbers of the lines that each document loses, with their hashes; a written table."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lines = written(_lines(texts, min_tokens, depth, short), "lines")
    named, read = templates(texts, lines, support, min_constant, min_tokens, depth)
    placed = written(lines.join(named, "line", "left").select("doc", "at", "line", F.coalesce("template", "line").alias("template")), "placed")
    remove(lines, *read)
    # A table of its own, so that the join below has plain shuffles on both sides and a hot template's rows can be split.
    first = written(placed.groupBy("template", "doc").agg(F.min("at").alias("at")).groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "at")).alias("first")).filter(F.col("docs") >= min_docs).select("template", "first"), "recurring")
    gone = placed.join(first, "template").filter(F.struct("doc", "at") != F.col("first"))
    out = written(gone.groupBy("doc").agg(F.collect_list(F.struct("at", "line")).alias("dropped")), "dropped-lines")
    remove(placed, first)
    return out


def cleaned(docs: DataFrame, min_docs: int = 3, min_constant: float = 0.6, min_tokens: int = 3, depth: int = 2, support: int | None = None, short: bool = False) -> DataFrame:
    """Each document as ``row`` (a struct of its columns, the text without recurring lines), with n_lines and n_dropped (long).

    ``support`` is what a token needs to stay constant, if not ``min_docs``; with ``short``, lines of fewer
    than ``min_tokens`` tokens are templates of their own.
    """
    dropped = recurring(docs, min_docs, min_constant, min_tokens, depth, support or min_docs, short)
    whole = docs.withColumn("text", F.col("text").cast("string"))
    # The columns stay in a struct of their own: no name of theirs clashes with one that is used here.
    row = F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("row")
    joined = whole.select(row).select("row", F.col("row")["doc_id"].cast("long").alias("doc")).join(dropped.hint("merge"), "doc", "left").select("row", "dropped")
    at = whole.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            _, bounds = text_bytes(whole_batch.column(0).field(at))
            for lo, hi in slices(bounds):
                yield removed(whole_batch.slice(lo, hi - lo))

    def removed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, given = batch.column(0), batch.column(1)
        columns = rows.flatten()
        text = columns[at]
        data, offsets = text_bytes(text)
        new: dict[int, str] = {}
        gone = np.zeros(len(batch), _I)
        for i in np.flatnonzero(np.asarray(given.is_valid())).tolist():
            own = data[offsets[i] : offsets[i + 1]]
            _, number, _, line, *_ = tokens(own, np.array([0, len(own)]), min_tokens, depth, short)
            out = {(x["at"], x["line"]) for x in given[i].as_py()}
            out = {a for a, b in zip(number.tolist(), line.tolist(), strict=True) if (a, b) in out}
            new[i] = b"\n".join(x for k, x in enumerate(own.tobytes().split(b"\n")) if k not in out).decode()
            gone[i] = len(out)
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        valid = np.asarray(text.is_valid())
        many = np.where(valid, feeds[offsets[1:]] - feeds[offsets[:-1]] + 1, 0)
        if new:
            columns[at] = pa.array([new[i] if i in new else text[i].as_py() if valid[i] else None for i in range(len(batch))], text.type)
        return pa.record_batch([pa.StructArray.from_arrays(columns, fields=list(rows.type)), pa.array(many), pa.array(gone)], names=["row", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, joined.select("row").schema.add("n_lines", "long").add("n_dropped", "long"))


def drop_recurring(docs: DataFrame, **options) -> DataFrame:
    """The documents with their text without recurring lines, and n_lines, n_dropped (long); the options are those of cleaned().

    Columns of the input that have these two names are replaced; cleaned() keeps them.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cleaned(docs, **options).select(*[F.col("row")[c].alias(c) for c in keep], "n_lines", "n_dropped")
