"""Operators that compare documents, against plain Python over all of them."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import docs as D
import numpy as np
import pytest
from pyspark.sql import functions as F

from fastaxis.llm import line_dedup, ngram_join, suffix_dedup, toxicity
from fastaxis.llm.graph import components

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removal(texts, length=100):
    """texts in the order that counts; (removed, runs, digest) of each."""
    seen, out = set(), []
    for text in texts:
        data, gone = text.encode(), bytearray(len(text.encode()))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    rnd = random.Random(5)
    blocks = ["".join(rnd.choice("ab ") for _ in range(400)) for _ in range(5)]
    more = []
    for j in range(60):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(300)
            text += rnd.choice(blocks)[i : i + rnd.choice([80, 99, 100, 101, 150, 200])] + "".join(rnd.choice("xyzé") for _ in range(rnd.choice([0, 1, 3, 60])))
        more.append((5000 + rnd.randrange(10**6) * 100 + j, text, *[None] * 8))
    df = D.frame(spark, more)
    order = sorted((r.doc_id, r.text or "") for r in df.collect())
    want = {i: x for (i, _), x in zip(order, brute_removal([t for _, t in order]), strict=True)}
    for block in (1024, 2):  # whole anchors, and anchors divided into many blocks
        got = suffix_dedup.dedup(df, block=block).collect()
        assert len(got) == len(order) == len(want)
        assert [(r.doc_id, tuple(r)[1:5]) for r in got if want[r.doc_id] != tuple(r)[1:5]] == []
        assert sum(r.n_removed for r in got) > 1000
    assert suffix_dedup.dedup(D.empty(spark)).count() == 0


def test_suffix_dedup_of_rows_without_own_ids(spark):
    texts = [(1, "abcdefgh " * 30), (1, "abcdefgh " * 30), (None, "abcdefgh " * 30), (None, None), (2, "q" * 120)]
    got = Counter((r.doc_id, *tuple(r)[1:5]) for r in suffix_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert got == Counter((i, *x) for (i, _), x in zip(order, brute_removal([t or "" for _, t in order]), strict=True))


def test_settled_rows_in_batches_of_any_size():
    """Where a batch ends makes no difference."""
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    rows = sorted((int(g), int(c), d, int(rnd.integers(50)), 128 * int(rnd.integers(1, 5)), 1) for d, (g, c) in enumerate(zip(rnd.integers(0, 60, 400), rnd.integers(0, 3, 400), strict=True)))
    columns = [np.array(c) for c in zip(*rows, strict=True)]

    def settled(size, hot=()):
        divided = pa.array([int(g) in hot for g in columns[0]])
        whole = pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.int8()), divided], names=[*suffix_dedup._ROWS, "divided"])
        parts = [whole.slice(i, size) for i in range(0, len(whole), size)]
        return sorted(tuple(r.values()) for b in suffix_dedup._settled(iter(parts), 100) for r in b.to_pylist())

    firsts = {(g, c): (d, at, to) for g, c, d, at, to, _ in reversed(rows)}
    several = {g for g, _ in firsts if sum(x == g for x, _ in firsts) > 1}
    want = [(g, c, d, at, at + to // 128 + 99, 0) for g, c, d, at, to, _ in rows if firsts[g, c][0] != d] + [(g, c, *firsts[g, c], 1) for g, c in firsts if g in several]
    assert all(settled(size) == sorted(want) for size in (1, 2, 7, 400))
    # Of a divided anchor each context counts as one of several.
    alone = {g for g, _ in firsts} - several
    assert alone
    more = [(g, c, *firsts[g, c], 1) for g, c in firsts if g in alone]
    assert all(settled(size, alone) == sorted(want + more) for size in (1, 2, 7, 400))


def test_a_frequent_anchor_with_different_contexts_is_divided(spark):
    """A separator between texts that differ is the anchor of thousands of contexts; no partition holds them all."""
    rnd = random.Random(8)
    # Of some separators the one of the least hash, so that it is the anchor of most windows that hold it.
    tried = ["=" * 5 + "".join(rnd.choice("xyz") for _ in range(22)) + "=" * 5 for _ in range(500)]
    rank = lambda t: int(suffix_dedup.mix(suffix_dedup.between(suffix_dedup.prefix_sums(np.frombuffer(t.encode(), np.uint8)), np.array([0]), np.array([32])))[0])
    separator = min(tried, key=rank)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    texts = spark.createDataFrame([(i, noise(70) + separator + noise(70)) for i in range(3000)], "doc long, text string")
    # Partitions of small tables would be joined.
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        rows = suffix_dedup.dealt(texts, 100, 64).selectExpr("gram", "spark_partition_id() as p").groupBy("gram", "p").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total = Counter()
    for r in rows:
        total[r.gram] += r["count"]
    gram, n = total.most_common(1)[0]
    assert n > 500 and max(r["count"] for r in rows if r.gram == gram) < n / 4


def test_maximal_repeats_have_all_occurrences():
    text = b"xxABCDEFGHyyABCDEFGHzzBCDEFGHwwABCDEF" + b"-" * 8
    data = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text) - 6)
    left = np.where(starts > 0, data[np.maximum(starts - 1, 0)].astype(int), -1)
    found = {text[starts[m[0]] : starts[m[0]] + n]: sorted(starts[m].tolist()) for n, m in suffix_dedup.maximal_repeats(data, starts, np.full(len(starts), len(text)), left, 6)}
    assert found[b"ABCDEFGH"] == [2, 12]
    assert found[b"BCDEFGH"] == [3, 13, 22]
    assert found[b"ABCDEF"] == [2, 12, 31]
    assert b"BCDEF" not in found and b"CDEFGH" not in found  # always after B: no maximal repeat


def shingles(text):
    w = SPACES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def test_jaccard_components(spark):
    rnd, more = random.Random(3), []
    for k in range(25):
        base = D.prose(rnd, rnd.choice([6, 10, 20, 40, 80, 300])).split(" ")
        for j in range(10):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                words[rnd.randrange(len(words))] = rnd.choice("abcdefghij")
            more.append((200000 + k * 100 + j, " ".join(words), *[None] * 8))
    df = D.frame(spark, more)
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted, links = defaultdict(list), 0
    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in inverted[s]).items():
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    for share in (1 / 500, 0.05):  # with few and with many n-grams left out of the fragments
        got = ngram_join.jaccard_components(df, hot_share=share).collect()
        assert [r for r in got if (r.n_shingles, r.component_id) != (len(sets[r.doc_id]), root(r.doc_id))] == []
        assert len(got) == len(sets) and links > 100
    repeated = ngram_join.jaccard_components(D.frame(spark, D.REPEATED)).collect()
    assert len(repeated) == len(D.rows()) + len(D.REPEATED)
    assert all(r.component_id is None for r in repeated if r.doc_id is None)
    assert ngram_join.jaccard_components(D.empty(spark)).count() == 0


def test_representatives_meet():
    """Linked sets share as many hashes as their lot needs, whatever is left out of the fragments."""
    rnd, sizes = np.random.default_rng(1), ngram_join.Sizes(85)
    for _ in range(400):
        n = int(rnd.integers(2, 400))
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.06], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n // 14)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) == both == len(b) or not len(b) or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        hot = np.sort(np.concatenate([a[rnd.random(len(a)) < rnd.choice([0, 0.5, 0.95])], rnd.integers(0, 2**63, 5, dtype=np.uint64)]))
        one, two = ({lot >> 20: (set(h.tolist()), lot % (1 << 20)) for h, lot in ngram_join.representatives(x, hot, sizes)} for x in (a, b))
        assert any(len(one[k][0] & two[k][0]) >= max(one[k][1], two[k][1]) for k in one.keys() & two.keys()), (len(a), len(b), both)


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, min_docs=3, min_constant=0.6, min_tokens=3, depth=2):
    tokens = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in SPACES.findall(line))
    lines = [(i, k, tokens(x)) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_tokens]
    docs, leaves = defaultdict(set), defaultdict(list)
    for i, _, w in lines:
        docs[w].add(i)
    for w in docs:
        leaves[len(w), w[:depth]].append(w)
    named = {}
    for leaf, members in leaves.items():
        if len(members) < 2 or sum(len(docs[w]) for w in members) < min_docs:
            continue
        support = Counter()
        for w in members:
            for place in enumerate(w):
                support[place] += len(docs[w])
        for w in members:
            constant = [x != "<*>" and support[j, x] >= min_docs for j, x in enumerate(w)]
            if sum(constant) >= min_constant * len(w):
                named[w] = ("T", leaf, tuple(x if c else "<*>" for x, c in zip(w, constant, strict=True)))
    where, first = defaultdict(set), {}
    for i, k, w in lines:
        t = named.get(w, w)
        where[t].add(i)
        first[t] = min(first.get(t, (i, k)), (i, k))
    gone = {(i, k) for i, k, w in lines if len(where[named.get(w, w)]) >= min_docs and first[named.get(w, w)] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows if i is not None}


def test_line_templates(spark):
    more = [(9000 + i, f"Hello user {w} welcome to the site today\nunique {w} zz{w} q{w}\nPage {i} of 20 here\nok\n", *[None] * 8) for i, w in enumerate("alpha beta gamma delta eps".split())]
    df = D.frame(spark, [*more, (None, "Page 3 of 20 here", *[None] * 8)])
    out = line_dedup.drop_recurring(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute_lines([(r.doc_id, r.text) for r in df.collect()])
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert got[None] == "Page 3 of 20 here"
    assert got[9004] == "unique eps zzeps qeps\nok\n" and got[9000].startswith("Hello user alpha")
    assert line_dedup.drop_recurring(D.empty(spark)).count() == 0
    assert line_dedup.drop_recurring(D.frame(spark, D.REPEATED)).count() == len(D.rows()) + len(D.REPEATED)


def test_sketch(spark):
    from fastaxis.llm.common import may_hold, sketch

    rnd = np.random.default_rng(1)
    held = rnd.integers(-(2**63), 2**63 - 1, 500)
    table = sketch(spark.createDataFrame([(int(x),) for x in held], "h long"), F.col("h"), 1 << 14)
    assert may_hold(table, held).all() and 0.01 < may_hold(table, rnd.integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.06
    assert not may_hold(sketch(spark.createDataFrame([], "h long"), F.col("h"), 1 << 14), held).any()


def test_line_templates_of_clashing_columns(spark):
    """Columns of the input keep their values, whatever they are called."""
    texts = [(i, f"a line that all have\n{w} {w}x {w}y") for i, w in enumerate("one two three four".split())]
    clash = ["row", "doc", "dropped", "_dropped", "_n_lines", "_line_doc", "at", "line", "n_lines", "n_dropped", "a b.c"]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(7) for c in clash})
    out = line_dedup.cleaned(df).select("row.*", F.col("n_lines").alias("many"), F.col("n_dropped").alias("gone")).collect()
    assert all(r[c] == 7 for r in out for c in clash) and sorted((r.doc_id, r.many, r.gone) for r in out) == [(0, 2, 0), (1, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert {(r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring(df).collect()} == {(2, 0), (2, 1)}


def test_toxicity_learns(spark):
    rnd, texts, labels = random.Random(6), [], []
    for i in range(1500):
        words, bad = D.prose(rnd, rnd.randint(10, 80)).split(" "), rnd.random() < 0.25
        if bad:
            for _ in range(max(1, len(words) // 12)):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "grubby", "lout", "dolt"])
        texts.append((i, " ".join(words)))
        labels.append((i, None, int(bad)))
    labels += [(1, None, None), (None, None, 1), (77777, None, 1)]
    texts += [(80000, None), (80001, ""), (None, "vile lout"), (3, texts[3][1])]
    schema = "doc_id long, text string"
    rows = toxicity.toxicity(spark.createDataFrame(texts, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    import zlib

    truth = {i: y for i, _, y in labels if i is not None and i < 1500 and y is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in rows if r.held_out} == {i for i, _ in texts if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


@pytest.mark.parametrize("labels", [[], [(1, None, 1), (2, None, 1)]])
def test_toxicity_of_few_labels(spark, labels):
    rows = toxicity.toxicity(D.frame(spark, D.REPEATED), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(D.rows()) + len(D.REPEATED) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(D.empty(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def stage_input(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never in the documents at all since these words are not there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = stage_input(spark, tmp_path, [r[:5] for r in D.rows()], D.SCHEMA.split(", key")[0])
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(left) < before
    # No two that are left link, and none is short.
    sets = {i: shingles(t) for i, t in left.items()}
    assert not any(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (1, ""), (None, "x")]])
def test_pipeline_of_little(spark, tmp_path, rows):
    import corpus_pipeline

    stage_input(spark, tmp_path, rows, "doc_id long, text string")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # nothing passes the rules


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Ids that are missing or repeat, columns named like the operators' own: each stage keeps what it should, and every column as it was."""
    import corpus_pipeline

    rnd = random.Random(15)
    clean = lambda: "\n".join(". ".join(D.prose(rnd, 12).capitalize() for _ in range(4)) + "." for _ in range(4))
    one, two, three = clean(), clean(), clean()
    texts = [(1, one), (1, one), (1, two), (2, one + " more"), (None, three), (None, three), (3, three), (4, clean())]
    clash = ["row", "doc", "key", "lot", "node", "component", "n_words", "n_lines", "n_dropped", "_gone", "a.b", "id"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in clash)
    docs = stage_input(spark, tmp_path, [(*t, *range(len(clash))) for t in texts], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(tuple(r)[2:] == tuple(range(len(clash))) for r in out.collect())
    joined = corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id or 0), r.text) for r in joined.collect()) == sorted([(1, one), (1, two), (0, three), (0, three), (3, three), (4, texts[-1][1])])


def test_pipeline_joins_five_word_shingles(spark, tmp_path):
    import corpus_pipeline

    rnd, texts = random.Random(8), []
    for k in range(60):
        words = D.prose(rnd, rnd.choice([30, 50, 90, 180, 300])).split(" ")
        for j in range(5):
            copy = list(words)
            for _ in range(rnd.randint(0, 2 + len(words) // 60)):
                copy[rnd.randrange(len(copy))] = rnd.choice("abcdefghij")
            texts.append((k * 10 + j, " ".join(copy)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split(" ")) for i, t in texts)}
    parent, only_here = {i: i for i in sets}, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
                four = [shingles(t) for i, t in texts if i in (a, b)]
                only_here += 100 * len(four[0] & four[1]) < 85 * len(four[0] | four[1])
    assert only_here > 5
    got = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in sets if root(i) == i)


def brute_gaps(rows, texts, order=2, share=toxicity.SHARE):
    """Each text's log-likelihood as a toxic less that as an ordinary text, by the definition of the models."""
    grams = lambda t, k: [tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)]

    def discount(counts):
        once, twice = (sum(v == m for v in counts.values()) for m in (1, 2))
        return (once + 1) / (once + 2 * twice + 2)

    out = [0.0] * len(texts)
    for k in range(1, order + 1):
        count = [Counter(g for t, y in rows if y == c for g in grams(t, k)) for c in (0, 1)]
        docs = Counter(g for t, _ in rows for g in set(grams(t, k)))
        n, d, ds = [sum(c.values()) for c in count], [discount(c) for c in count], discount(docs)
        assert all(0 < x < 1 for x in (*d, ds))

        def ordinary(g):
            shared = (docs[g] - ds + ds * len(docs) / (len(docs) + 1)) / sum(docs.values())
            return (max(0, count[0][g] - d[0]) + d[0] * len(count[0]) * shared) / n[0]

        def toxic(g):
            return (max(0, count[1][g] - d[1]) + d[1] * len(count[1]) * ordinary(g)) / n[1]

        for i, t in enumerate(texts):
            out[i] += sum(np.log(1 - share + share * (toxic(g) / ordinary(g) if g in docs else d[1] * len(count[1]) / n[1])) for g in grams(t, k))
    return out


def test_toxicity_by_brute_force(spark, monkeypatch):
    """Word by word and pair by pair, whether expressions are broadcast or joined."""
    rnd = random.Random(9)
    texts = [(i, D.prose(rnd, rnd.choice([1, 5, 30, 60]), "abc"), int(i % 3 == 0)) for i in range(150)]
    part = lambda i: __import__("zlib").crc32(str(i).encode()) % 5
    want = brute_gaps([(t, y) for i, t, y in texts if part(i) > 1], [t for _, t, _ in texts])
    docs, labels = spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    for most in (400_000, 10):
        monkeypatch.setattr(toxicity, "BROADCAST", most)
        got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
        assert len(got) == len(texts)
        for (i, t, _), gap in zip(texts, want, strict=True):
            assert (got[i].n_words, got[i].gap) == (len(t.split()), pytest.approx(gap, abs=1e-4))


def test_expressions_of_one_toxic_text_have_their_rows(spark):
    """No count is cut: every expression that a toxic text of the models' folds holds stands in the table with a value of its own."""
    rnd = random.Random(11)
    rows = [(D.prose(rnd, 40), int(i % 4 == 0)) for i in range(60)]
    model = toxicity.Model(spark.createDataFrame(rows, "text string, toxic int"))
    held = {tuple(t.split()[i : i + k]) for t, y in rows if y for k in (1, 2) for i in range(41 - k)}
    values = [*model.value, *(r.value for r in model.rest.collect())]
    assert len(values) == len(held) and np.mean(np.array(values) > 0) > 0.9


def test_toxicity_hears_phrases(spark):
    """Toxic texts of ordinary words only: what tells them apart is which stand together."""
    rnd, texts = random.Random(5), []
    for i in range(2500):
        words, bad = D.prose(rnd, rnd.randint(20, 60), "ab").split(" "), int(rnd.random() < 0.3)
        for _ in range(4):
            at = rnd.randrange(len(words) - 1)
            words[at : at + 2] = rnd.choice([["sour", "goat"], ["wet", "dog"]] if bad else [["sour", "dog"], ["wet", "goat"]])
        texts.append((i, " ".join(words), bad))
    rows = toxicity.toxicity(spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")).collect()
    assert np.mean([r.predicted == texts[r.doc_id][2] for r in rows if r.held_out]) > 0.95


def test_pipeline_drops_lines_of_two_documents(spark, tmp_path):
    import corpus_pipeline

    passage = D.prose(random.Random(10), 60)
    texts = [(1, f"first alone here\n{passage}\nOK bye\nitem 1"), (2, f"second of all\n{passage}\nOK bye\nitem 2"), (3, "OK bye\nthird line stays here"), (4, "of two alone now"), (5, "of two alone now")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path)).collect()}
    assert got == {1: texts[0][1], 2: "second of all\nitem 2", 3: "third line stays here", 4: "of two alone now"}
