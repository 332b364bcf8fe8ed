"""Operator 1, token counts that follow edits.

trees() cuts each text at places that no pre-token spans (between a character and white space
after it) into leaves of about ``leaf_chars`` characters, counts the tokens of each leaf, and
keeps a segment tree per document: an array in heap order whose nodes hold the sums of
their subtrees, for characters and for tokens. edited() applies a document's edits: it
descends the tree to the leaves that an edit touches, with the characters at either side of
it, encodes only these again and adds the differences along their paths. A leaf
that has grown beyond four times its size is cut anew, which rebuilds the sums, but encodes
nothing else.

Edits are (start, end, replacement) in characters of the text before all edits. They are applied
in order of start; start and end are brought within the text; an edit that begins before the
end of the one ahead of it is left out; an insertion has start = end.

Defined results: a null or empty text has one empty leaf and no tokens, and can be inserted
into; no edits leave a tree as it is; null replacements are empty; edits of null bounds are left
out; repeated rows are edited separately; an empty table gives none; other columns are handed
on unchanged.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 1024
#: The pre-token pattern of the rank files (a fixed value that belongs to them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"\S(?=[ \n\t])")
TREE = "struct<size:int,chars:array<long>,tokens:array<long>>"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer of a rank file, loaded once a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def cut(text: str, size: int) -> list[str]:
    """The text in leaves of at least ``size`` characters, each but the last ending before white space."""
    out, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size - 1)
        if found is None:
            break
        out.append(text[start : found.end()])
        start = found.end()
    return [*out, text[start:]]


class Tree:
    """Segment tree over leaves: node k has children 2k and 2k + 1, the leaves begin at ``size``."""

    def __init__(self, size: int, chars: list[int], tokens: list[int]):
        self.size, self.chars, self.tokens = size, chars, tokens

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        size = 1 << max(0, len(chars) - 1).bit_length()
        made = cls(size, *([0] * size + part + [0] * (size - len(part)) for part in (chars, tokens)))
        for k in range(size - 1, 0, -1):
            made.chars[k] = made.chars[2 * k] + made.chars[2 * k + 1]
            made.tokens[k] = made.tokens[2 * k] + made.tokens[2 * k + 1]
        return made

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last non-empty one for places beyond), and its first character."""
        place, k, start = max(0, min(place, self.chars[1] - 1)), 1, 0
        while k < self.size:
            k *= 2
            if place >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        more_chars, more_tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2


def sorted_edits(edits: list | None, n: int) -> list[tuple[int, int, str]]:
    """The edits that count, brought within a text of n characters."""
    out: list[tuple[int, int, str]] = []
    for e in sorted((e for e in edits or [] if e["start"] is not None and e["end"] is not None), key=lambda e: (e["start"], e["end"], e["replacement"] or "")):
        start = min(max(e["start"], 0), n)
        end = min(max(e["end"], start), n)
        if not out or start >= out[-1][1]:
            out.append((start, end, e["replacement"] or ""))
    return out


def apply(text: str, tree: Tree, edits: list[tuple[int, int, str]], encode, size: int) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many leaves were encoded again."""
    again = 0
    # From the last to the first, so that the places of those to come stay right.
    for start, end, new in reversed(edits):
        first, begin = tree.leaf_at(start - 1)
        last, at = tree.leaf_at(end)
        stop = at + tree.chars[last + tree.size]
        text, region = text[:start] + new + text[end:], text[begin:start] + new + text[end:stop]
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
        if len(region) <= 4 * size:
            tree.put(first, len(region), len(encode(region)))
            again += 1
        else:
            leaves = cut(region, size)
            parts = [x[tree.size :] for x in (tree.chars, tree.tokens)]
            for part, values in zip(parts, ([len(x) for x in leaves], [len(encode(x)) for x in leaves]), strict=True):
                part[first : last + 1] = values
            kept = [i for i, n in enumerate(parts[0]) if n] or [0]
            tree = Tree.of(*([part[i] for i in kept] for part in parts))
            again += len(leaves)
    return text, tree, again


def trees(docs: DataFrame, ranks: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with its segment trees in the column ``token_tree``."""
    names = [c for c in docs.columns if c != "token_tree"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        kind = pa.struct([("size", pa.int32()), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
        for batch in batches:
            made = []
            for text in batch.column(at):
                leaves = cut(text.as_py() or "", leaf_chars)
                tree = Tree.of([len(x) for x in leaves], [len(encode(x)) for x in leaves])
                made.append({"size": tree.size, "chars": tree.chars, "tokens": tree.tokens})
            yield pa.record_batch([*batch.columns, pa.array(made, kind)], names=[*names, "token_tree"])

    given = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    return given.mapInArrow(run, given.withColumn("token_tree", F.lit(None).cast(TREE)).schema)


def edited(docs: DataFrame, edits: Column, ranks: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Rows of trees() after their edits (an array of start, end, replacement): text and tree are the new ones.

    Adds n_chars_before, n_tokens_before, n_chars_after, n_tokens_after and n_encoded, the leaves encoded again.
    """
    added = ["n_chars_before", "n_tokens_before", "n_chars_after", "n_tokens_after", "n_encoded"]
    names = [c for c in docs.columns if c not in added]
    at, tree_at = names.index("text"), names.index("token_tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            texts, made, figures = [], [], []
            for text, tree, wanted in zip(batch.column(at), batch.column(tree_at), batch.column(len(names)), strict=True):
                old, tree = text.as_py(), Tree(**tree.as_py())
                before = tree.chars[1], tree.tokens[1]
                edits_here = sorted_edits(wanted.as_py(), before[0])
                new, tree, again = apply(old or "", tree, edits_here, encode, leaf_chars)
                texts.append(new if edits_here else old)
                made.append({"size": tree.size, "chars": tree.chars, "tokens": tree.tokens})
                figures.append((*before, tree.chars[1], tree.tokens[1], again))
            columns = list(batch.columns[: len(names)])
            columns[at], columns[tree_at] = pa.array(texts, pa.string()), pa.array(made, batch.column(tree_at).type)
            yield pa.record_batch([*columns, *(pa.array(c, pa.int64()) for c in zip(*figures, strict=True))] if figures else [*columns, *(pa.array([], pa.int64()) for _ in added)], names=[*names, *added])

    given = docs.select(*names)
    schema = given.schema
    for c in added:
        schema = schema.add(c, "long")
    return given.withColumn("_edits", edits.cast("array<struct<start:long,end:long,replacement:string>>")).mapInArrow(run, schema)


def joined_edits(docs: DataFrame, edits: DataFrame, on: str = "doc_id") -> DataFrame:
    """``docs`` with the rows of an edits table (on, start, end, replacement) as the array column ``edits``."""
    lists = edits.groupBy(on).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    return docs.join(lists, on, "left")


def standard_edits(text: Column) -> Column:
    """A redaction, an insertion and a new ending for every text, at places that follow from its length."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    edit = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("replacement"))
    return F.array(edit(F.floor(n / 4), F.floor(n / 4) + 9, "[redacted]"), edit(F.floor(n / 2), F.floor(n / 2), " see the note below "), edit(F.greatest(n - 5, F.lit(0)), n, "\nEnd."))
