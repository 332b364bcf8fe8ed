"""Texts longer than the slices that operators work in, and columns that are called like theirs."""

import random
import zlib
from collections import Counter, defaultdict

import docs as D
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_removal, shingles
from test_row_operators import brute_hits, measures

from fastaxis.llm import decontaminate, licences, line_dedup, ngram_join, packing, pii, quality, suffix_dedup, token_counts, toxicity
from fastaxis.llm.common import SLICE_BYTES
from fastaxis.llm.registry import tokenizer_file


@pytest.fixture(scope="module")
def texts():
    """Three texts of more than a slice each: one, the same with an edit near its end, and another; and short ones."""
    rnd = random.Random(40)
    lines = [D.prose(rnd, 40, "abcdefghijklmnopqrst") for _ in range(7500)]
    one = "\n".join(lines)
    edited = "\n".join([*lines[:-3], "an edit with é in it", *lines[-3:]])
    other = "\n".join(D.prose(rnd, 40, "uvwxyzklmnop") for _ in range(7500)) + "\nReleased under the MIT License.\nwrite to last@word.org"
    assert min(map(len, (one, other))) > SLICE_BYTES
    return {1: one, 2: edited, 3: other, 4: "short\n" + lines[0], 5: ""}


CLASH = ["row", "doc", "key", "block", "text_", "score", "n_words", "kept", "spans", "sequence_id", "start", "edits", "token_tree", "families", "component_id"]


@pytest.fixture(scope="module")
def frame(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def test_quality(frame, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(frame).collect()}
    assert got == {i: measures(t) for i, t in texts.items()}


def test_suffix_dedup(frame, texts):
    want = dict(zip(sorted(texts), brute_removal([texts[i] for i in sorted(texts)]), strict=True))
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(frame).collect()} == want


def test_lines(frame, texts):
    out = {r.doc_id: r for r in line_dedup.drop_recurring(frame, min_docs=2, support=3).collect()}
    assert out[1].text == texts[1] and out[3].text == texts[3] and out[4].text == "short" and out[2].text == "an edit with é in it"
    assert (out[2].n_lines, out[2].n_dropped, out[2].row) == (7501, 7500, "mine")


def test_join(frame, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame).collect()}
    assert got == {i: (len(shingles(t)), 1 if i == 2 else i) for i, t in texts.items()}
    left = ngram_join.one_of_each(frame, 5, 80)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == [1, 3, 4, 5]


def test_decontamination(spark, frame, texts):
    end = " ".join(texts[1].split()[-14:])
    items = [(7, end), (8, "not in any of these texts at all so that nothing is found")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(frame, benchmark).collect()} == {i: brute_hits(t, items) for i, t in texts.items()}
    clean = decontaminate.uncontaminated(frame, benchmark)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == [3, 4, 5]


def test_licences_and_identifiers(frame, texts):
    found = licences.findings(frame).filter("doc_id = 3").collect()
    assert [(texts[3].encode()[r.start : r.end], r.family) for r in found] == [(b"Released under the MIT License", "mit")]
    at = len(texts[3]) - len("last@word.org")
    assert {r.doc_id: r.spans for r in pii.find(frame).collect()} == {i: f"email:{at}:{at + 13}" if i == 3 else "" for i in texts}


def test_tokens_and_packing(frame, texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    whole = token_counts.encoder(path).encode_ordinary
    made = token_counts.edited(token_counts.trees(frame.select("doc_id", "text"), path), token_counts.standard_edits(F.col("text")), path)
    assert {r.doc_id: r.n_tokens_before for r in made.select("doc_id", "n_tokens_before").collect()} == {i: len(whole(t)) for i, t in texts.items()}
    plain, pieces = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), defaultdict(list)
    for p in packing.pack(frame, tokenizer_file("word_bpe_49k.json")).collect():
        pieces[p.doc_id].append(p)
    for i, t in texts.items():
        ids, done = [*plain.encode(t, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == done and p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[done : done + p.length]))
            done += p.length
        assert done == len(ids)


def test_toxicity(spark, frame, texts):
    marks = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int").withColumns({c: F.lit(1) for c in CLASH})
    rows = toxicity.toxicity(frame, marks).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts)) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.n_words for r in rows} == {i: len(t.replace("é", "e").replace("@", " ").replace(".", " ").split()) for i, t in texts.items()}
