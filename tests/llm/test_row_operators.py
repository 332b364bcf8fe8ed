"""Operators that look at one document at a time, against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import docs as D
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fastaxis.llm import decontaminate, licences, packing, pii, quality, token_counts
from fastaxis.llm.registry import tokenizer_file

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(value):
    d = [int(c) for c in value if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0


VALID = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": luhn, "phone": lambda v: 8 <= sum(c.isdigit() for c in v) <= 15}


def test_personal_data_seeds(spark):
    odd = [
        (-1, "a@b.com_x@d.ef y.z@@q.w a@b. 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 aéb\x01c x@y-z.co.uk."),
        (-2, "4111 1111-1111 1111 +1 (222) 333-4444. +49-30-1234567890123456 12 4111--1111 999.1.1.1 é 10.0.0.1"),
        (-3, "x" * 20000 + "@" + "1" * 3000),
        (-4, "1." * 5000 + " a@" + "b." * 5000),
        (-4, "repeated id 10.1.1.1"),
        (None, "me@here.org 10.2.2.2"),
        (-5, None),
    ]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    got = Counter(tuple(r)[:6] for r in pii.find(df).collect())
    want = Counter()
    for i, text in odd:
        spans = {k: [(m.start(), m.end()) for m in re.finditer(PATTERNS[k], text or "") if VALID[k](m[0])] for k in KINDS}
        want[(i, *(len(spans[k]) for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]).encode()).hexdigest())] += 1
    assert got == want


def test_personal_data_from_context(spark):
    texts = [(i, f"please call me on +1 (555) 010-{1000 + i} today. and mail to user{i}@x.org") for i in range(20)]
    texts += [(100, "please call me on 555 010 7777 today"), (101, "the sum is 555 010 8888 today")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[100] == "phone:18:30"
    assert found[101] == ""
    assert found[3].startswith("email:") and ",phone:" in found[3]


def test_personal_data_in_generations(spark):
    """A phrase that only identifiers found by context stand behind marks others."""
    texts = [(i, f"please call me on +1 (555) 010-{1000 + i} today.") for i in range(30)]
    texts += [(100 + i, f"please call me on 555 020 {1000 + i} today, at night my number 555 020 {1000 + i} works") for i in range(8)]
    texts += [(200, "at noon my number 555 030 9999 works"), (201, "a total amount 555 030 9999 works")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[200] == "phone:18:30"
    assert found[201] == ""


def test_personal_data_that_no_seed_matches(spark):
    """Planted identifiers in forms of their own, behind or before phrases that seeds stand in too; most are found, and what isn't one is left."""
    import random

    rnd, texts, planted = random.Random(21), [], {}
    digits = lambda n: "".join(rnd.choice("123456789") for _ in range(n))
    seeds = {"phone": lambda: f"+44 20 {digits(4)} {digits(4)}", "email": lambda: f"{D.prose(rnd, 1)}{digits(3)}@mail.example.org", "ip": lambda: ".".join(str(rnd.randint(11, 250)) for _ in range(4))}
    others = {"phone": lambda: f"0{digits(2)}-{digits(4)}-{digits(4)}", "email": lambda: f"{D.prose(rnd, 1)}{digits(3)}[at]mail.example", "ip": lambda: f"{rnd.randint(11, 250)}[.]{rnd.randint(11, 250)}[.]{rnd.randint(111, 250)}[.]{rnd.randint(11, 250)}"}
    phrases = {"phone": ["ring the office {} before noon", "her new {} mobile number"], "email": ["please write to {} about it", "all mail {} gets read"], "ip": ["requests that came from {} were dropped", "some host {} went silent"]}
    for i in range(600):
        kind = rnd.choice(list(seeds))
        unseen = i % 3 == 0
        value = (others if unseen else seeds)[kind]()
        text = f"{D.prose(rnd, 12)} {rnd.choice(phrases[kind]).format(value)} {D.prose(rnd, 12)}"
        texts.append((i, text))
        if unseen:
            planted[i] = f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"
    texts += [(1000 + i, f"{D.prose(rnd, 10)} the total came to {digits(9)} {D.prose(rnd, 10)}") for i in range(100)]
    found = {r.doc_id: set(r.spans.split(",")) for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(span in found[i] for i, span in planted.items()) >= 0.9 * len(planted)
    assert all(found[i] == {""} for i in range(1000, 1100))


def test_personal_data_of_few_digits(spark):
    """Addresses of four short parts are found as others are; a short number of another shape or in another place is none."""
    import random

    rnd = random.Random(22)
    line = lambda value, tail="were dropped": f"{D.prose(rnd, 9)} requests that came from {value} {tail} {D.prose(rnd, 9)}"
    texts = [(i, line(".".join(str(rnd.randint(1, 250)) for _ in range(4)))) for i in range(60)]
    unseen = [f"{rnd.randint(1, 9)}[.]{rnd.choice([0, 7, 31])}[.]0[.]{rnd.randint(1, 40)}" for _ in range(20)] + ["10[.]0[.]0[.]1", "1 - 2 - 3 - 4"]
    texts += [(100 + i, line(v)) for i, v in enumerate(unseen)]
    others = ["2024", "12 34", "1[.]2[.]3", "1[.]2[.]3[.]4[.]5", "1234[.]1[.]1[.]1"]
    texts += [(200 + i, line(v)) for i, v in enumerate(others)] + [(300, f"{D.prose(rnd, 9)} version 10[.]0[.]0[.]1 is out {D.prose(rnd, 9)}")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    of = dict(texts)
    assert sum(found[100 + i] == f"ip:{of[100 + i].index(v)}:{of[100 + i].index(v) + len(v)}" for i, v in enumerate(unseen)) >= 0.9 * len(unseen)
    assert all(found[200 + i] == "" for i in range(len(others))) and found[300] == ""


def test_personal_data_of_long_texts(spark):
    """Time grows with the matches, not with their square; offsets hold across the blocks in which they are located."""
    import time

    many = [(1, " ".join(f"é user{k}@x.org 10.0.{k % 256}.{k % 250} k {k:09d} z" for k in range(25_000))), (2, "x " * 700_000 + "end@of.text")]
    began = time.time()
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert (got[1].n_email, got[1].n_ip) == (25_000, 25_000) and got[2].spans == "email:1400000:1400011"
    for i, text in many:
        base = ",".join(f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PATTERNS[k], text) if VALID[k](m[0]))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_personal_data_of_nothing(spark):
    assert pii.find(D.empty(spark)).count() == 0
    assert pii.find(D.frame(spark, D.REPEATED)).count() == len(D.rows()) + len(D.REPEATED)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_measures(spark):
    loop = "one two three four five six seven eight nine. " * 5
    more = [(-1, loop, *[None] * 8), (-2, "a b c\na b c\n\n\n a b c\n", *[None] * 8), (-3, "1 2 3 4 5 6 7 8 9 " * 2, *[None] * 8), *D.REPEATED]
    df = D.frame(spark, more)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(df).collect())
    want = Counter()
    for r in df.collect():
        m = measures(r.text)
        want[(r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    assert got == want
    assert quality.quality(D.empty(spark)).count() == 0
    kept = quality.good_rows(df)
    assert kept.columns == df.columns


def brute_votes(text):
    """The rules by their definitions, on a text."""
    w = WORD.findall(text or "")
    n_words, chars, symbols, dup, repeat = measures(text)
    if not n_words:
        return (0,) * 10
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    caps, cries = sum("A" <= c <= "Z" for c in text), sum(c in "!?" for c in text)
    stops = len(re.findall(r"[.!?;:](?=[ \t\n\x0B\f\r]|\Z)", text))
    single, short, distinct = (sum(len(x) == 1 for x in w) / n_words, sum(len(x) <= 3 for x in w) / n_words, len(set(w)) / n_words)
    of = lambda good, bad: -1 if bad else int(good)
    return (
        of(symbols / n_words < 0.05, symbols / n_words > 0.1),
        of(caps / chars < 0.15, caps / chars > 0.3),
        of(cries / n_words < 0.1, cries / n_words > 0.25),
        of(repeat == 0, repeat / n_words >= 0.2),
        of(dup == 0 and len(lines) >= 3, dup / max(1, len(lines)) >= 0.1),
        of(3 <= chars / n_words <= 6.5, not 2.5 <= chars / n_words <= 7),
        of(0.02 <= stops / n_words <= 0.4, not 0.01 <= stops / n_words <= 0.5),
        of(0.15 <= short <= 0.55, not 0.08 <= short <= 0.65),
        of(single < 0.1, single > 0.2),
        of(n_words <= 2000 and distinct > 0.5, n_words <= 2000 and distinct < 0.35),
    )


def brute_posteriors(votes, rounds=500, prior=0.8, on_good=0.99, on_bad=0.3, weight=10.0):
    """Expectation-maximisation document by document, in arrays."""
    import numpy as np

    v = np.array(votes)
    up, down = (v > 0).astype(float), (v < 0).astype(float)
    pi, g, b = prior, np.full(v.shape[1], on_good), np.full(v.shape[1], on_bad)
    odds = lambda: np.log(pi / (1 - pi)) + up @ np.maximum(0, np.log(g / (1 - b))) + down @ np.minimum(0, np.log((1 - g) / b))
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-odds()))
        old = np.concatenate([[pi], g, b])
        pi = (post.sum() + weight * prior) / (len(v) + weight)
        g = (post @ up + weight * on_good) / (post @ (up + down) + weight)
        b = ((1 - post) @ down + weight * on_bad) / ((1 - post) @ (up + down) + weight)
        if np.abs(np.concatenate([[pi], g, b]) - old).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-odds()))


def quality_corpus(spark):
    import random

    rnd, rows = random.Random(12), []
    clean = lambda n: ". ".join(D.prose(rnd, rnd.randint(6, 14)).capitalize() for _ in range(n)) + "."
    for i in range(300):
        text = "\n".join(clean(3) for _ in range(4))
        if i % 9 == 0:
            line = D.prose(rnd, 7).capitalize() + "."
            text += f"\n{line}\n{clean(4)}\n{line}"  # one line twice in an otherwise clean text
        if i % 10 == 1:
            text = " ".join(x + "###" for x in text.split(" "))
        if i % 10 == 3:
            text = " ".join(x.upper() + "!!" for x in text.split(" "))
        rows.append((i, text))
    return rows, spark.createDataFrame([*rows, (900, None), (901, ""), (902, "few words")], "doc_id long, text string")


def test_posteriors_by_brute_force(spark):
    rows, df = quality_corpus(spark)
    texts = dict(rows) | {900: None, 901: "", 902: "few words"}
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    votes = {i: brute_votes(t) for i, t in texts.items()}
    want = dict(zip(votes, brute_posteriors(list(votes.values())), strict=True))
    for i, r in got.items():
        assert r.p_good == pytest.approx(want[i], abs=1e-6), i
        assert r.n_bad_votes == sum(v < 0 for v in votes[i])
        assert r.kept == (not r.base_failed and want[i] >= 0.5)
    # A bad vote is overruled where the others speak for the text, and isn't where they don't.
    overruled = [i for i in range(0, 300, 9) if i % 10 not in (1, 3)]
    assert all(votes[i][4] < 0 and got[i].kept for i in overruled) and len(overruled) > 20
    assert not any(got[i].kept for i in range(300) if i % 10 in (1, 3))
    kept = quality.good_rows(df.withColumns({"n_words": F.lit("mine"), "row": F.lit(1), "t": F.lit(2), "w": F.lit(None).cast("string")}))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept) and {r.n_words for r in kept.collect()} == {"mine"}


def test_a_rule_that_misjudges_a_hot_source_is_outvoted():
    """A third of all documents trips one rule, and is clean by all others."""
    clean, hot, junk = (1,) * 6, (-1, 1, 1, 1, 1, 1), (1, -1, -1, -1, 1, 1)
    found = quality.fit([(clean, 600), (hot, 330), (junk, 70)], 6)
    assert found.score(clean) >= found.score(hot) > 0 > found.score(junk)
    assert found.prior == pytest.approx(0.93, abs=0.01) and abs(found.for_bad[0]) < 1 < abs(found.for_bad[1])
    assert quality.fit([], 6).score((0,) * 6) > 0


def brute_hits(text, items, window=10):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[j : j + window])].add(i)
    w, hit, found = words_of(text), set(), set()
    for n in {len(k) for k in windows}:
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in windows:
                hit.update(range(j, j + n))
                found |= windows[tuple(w[j : j + n])]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("group", [1, 4000, 1 << 20])
def test_several_automata_scan_several_batches(spark, group):
    """However texts are grouped, all shards see all of them, each built once a group."""
    docs, texts = D.frame(spark, D.REPEATED), [t for _, t, *_ in D.rows() if t]
    items = spark.createDataFrame([(k, " ".join(t.split()[3:16])) for k, t in enumerate(texts) if len(t.split()) > 16], "item_id long, text string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, decontaminate.decontaminate(docs, items).collect()), key=repr)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = sorted(map(tuple, decontaminate.decontaminate(docs, items, shard_bytes=300, group_bytes=group).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == want and any(r[5] for r in want) and not all(r[5] for r in want)


def test_batches_are_grouped_by_their_bytes():
    batches = [pa.record_batch([pa.array(["x" * n])], names=["t"]) for n in (10, 10, 100, 10, 500, 1)]
    groups = [[len(b.column(0)[0].as_py()) for b in g] for g in decontaminate.grouped(batches, 120)]
    assert groups == [[10, 10, 100], [10, 500], [1]] and list(decontaminate.grouped([], 5)) == []


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_decontamination(spark, shard):
    items = [(10, "The quick brown fox jumps over the lazy dog and runs away."), (2, "Short one"), (3, None), (4, "..."), (5, "élan VITAL of été"), (2, "Short one")]
    texts = [(1, "so THE quick-brown fox; jumps over the lazy dog, and ran"), (2, "a short ONE here short one"), (3, None), (4, ""), (5, "of élan vital of été now"), (6, "shorts one élan vital of étés"), (1, "short one"), (None, "short one")]
    got = Counter(tuple(r) for r in decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in texts)
    spans = decontaminate.hit_spans(spark.createDataFrame(texts[:1], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [texts[0][1][r.start : r.end] for r in spans] == ["THE quick-brown fox; jumps over the lazy dog, and"]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(D.frame(spark), nothing).collect())
    left = decontaminate.uncontaminated(D.frame(spark), nothing)
    assert left.columns == D.frame(spark).columns and left.count() == len(D.rows())


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = {i: t for i, t, *_ in D.rows()} | {-1: "It's he'll 123 ¼ Σίσυφος ΣΑΣ İstanbul ẞ é <|endoftext|>  x y \x1c z ''s", -2: "don't!'s ..x 'TIS É" * 900}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for capacity in (64, 2048):
        pieces, at = packing.pack(df, path, capacity=capacity, batch_tokens=3000, padding=0.0).collect(), defaultdict(list)
        sequences = defaultdict(list)
        for p in pieces:
            at[p.doc_id].append(p)
            sequences[p.sequence_id].append((p.offset, p.length))
        for i, text in texts.items():
            ids, done = [*plain.encode(text or "", add_special_tokens=False).ids, 1], 0
            for p in sorted(at[i], key=lambda p: p.start):
                assert p.start == done and p.length > 0 and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[done : done + p.length]))
                done += p.length
            assert done == len(ids), i
        for places in sequences.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity and end & (end - 1) == 0  # full, or a power of two: never padded
    assert packing.pack(D.empty(spark), path).count() == 0
    assert packing.pack(spark.createDataFrame(D.REPEATED, D.SCHEMA), path).groupBy("doc_id").count().count() == 3


def test_packing_with_little_padding():
    """Documents that fit a sequence stay whole, and hardly anything is padded; where that can't be, nothing is padded."""
    import numpy as np

    rnd = np.random.default_rng(3)
    for n, capacity in ((900, 2048), (3000, 2048), (700, 256)):
        lengths = np.concatenate([rnd.lognormal(6, 1, n).astype(int) + 1, rnd.integers(1, 40, n // 5)])
        pieces = packing.assign(lengths, capacity, 1.0, 1 / 1024, 0.02)
        taken, used = defaultdict(list), Counter()
        for doc, start, length, sequence, offset in pieces:
            taken[doc].append((start, length))
            assert length > 0 and offset == used[sequence]
            used[sequence] += length
        for doc, parts in taken.items():
            assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([x for _, x in sorted(parts)])[:-1]] and sum(x for _, x in parts) == lengths[doc]
            assert len(parts) == -(-lengths[doc] // capacity)  # no more cuts than its length asks for
        assert len(taken) == len(lengths) and max(used.values()) <= capacity
        assert 1 - lengths.sum() / (capacity * len(used)) < 0.02
    few = packing.assign(np.array([300, 200, 100]), 2048, 1.0, 1 / 1024, 0.02)
    filled = Counter()
    for _, _, length, sequence, _ in few:
        filled[sequence] += length
    assert all(x & (x - 1) == 0 for x in filled.values()) and sum(filled.values()) == 600


def test_packing_by_brute_force_choice():
    """Each remainder lies in the sequence of the lowest cost that had room, as the rule says, one document after the other."""
    import numpy as np

    rnd = np.random.default_rng(8)
    lengths = rnd.integers(1, 1900, 300)
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 1024, 0.05)
    count = 1 + max(p[3] for p in pieces)
    room, cost = [2048] * count, [0.0] * count
    opened = -(-int(lengths.sum()) // 2048)
    for doc, start, length, sequence, _ in pieces:
        if start == 0 and length == lengths[doc]:
            fits = [k for k in range(opened) if room[k] >= length]
            if fits:
                assert sequence == min(fits, key=lambda k: (cost[k], k))
            else:
                assert sequence == opened
                opened += 1
        room[sequence] -= length
        cost[sequence] += length + length * length / 1024
    assert [p[0] for p in pieces] == sorted(range(300), key=lambda d: -lengths[d])


def test_packing_balances_cost():
    import numpy as np

    pieces = packing.assign(np.array([1500, 1400, 300, 300, 300, 296]), 2048, 1.0, 1 / 1024)
    assert sum(p[2] for p in pieces) == 4096
    assert {p[3] for p in pieces if p[0] in (0, 1) and p[1] == 0} == {0, 1}


def test_token_counts_follow_edits(spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    whole = token_counts.encoder(path).encode_ordinary
    df = D.frame(spark, D.REPEATED).select("doc_id", "text")
    edits = spark.createDataFrame([(8, 5, 9, "new"), (8, 9000, 9100, " \n "), (8, 7, 30, "overlaps"), (8, None, 3, "x"), (7, 0, 0, "start"), (2, 0, 5, "into nothing"), (1, 3, 3, "into null"), (6, 100, 700, None), (5, 299, 400, "é b c " * 2000)], "doc_id long, start long, end long, replacement string")
    made = token_counts.edited(token_counts.joined_edits(token_counts.trees(df, path, leaf_chars=64), edits), token_counts.F.col("edits"), path, leaf_chars=64).collect()
    given = defaultdict(list)
    for e in edits.collect():
        given[e.doc_id].append(e.asDict())
    source = {i: t for i, t, *_ in D.rows()}
    assert len(made) == df.count()
    for r in made:
        if r.doc_id is None or r.doc_id == 1000:
            continue
        text = source[r.doc_id] or ""
        for start, end, new in reversed(token_counts.sorted_edits(given[r.doc_id], len(text))):
            text = text[:start] + new + text[end:]
        assert (r.text or "") == text
        assert (r.n_chars_after, r.n_tokens_after) == (len(text), len(whole(text)))
        assert r.token_tree.tokens[1] == r.n_tokens_after
    by = {r.doc_id: r for r in made}
    assert by[8].n_encoded <= 6 < by[8].token_tree.size  # of some two hundred leaves
    assert by[4].n_encoded == 0


def test_edits_against_whole_encoding():
    import random

    whole, rnd = token_counts.encoder(tokenizer_file("byte_bpe_50k.tiktoken")).encode_ordinary, random.Random(2)
    for _ in range(150):
        text = "".join(rnd.choice(["a", "b ", " ", "\n", "'s", "1", "é", "!", " the"]) for _ in range(rnd.randint(0, 300)))
        leaves = token_counts.cut(text, 16)
        tree = token_counts.Tree.of([len(x) for x in leaves], [len(whole(x)) for x in leaves])
        for _ in range(4):
            edits = token_counts.sorted_edits([{"start": rnd.randint(0, len(text)), "end": rnd.randint(0, len(text)), "replacement": rnd.choice(["", " ", "x", " y z ", "q" * 90 + " w" * 40])} for _ in range(rnd.randint(0, 4))], len(text))
            want = text
            for start, end, new in reversed(edits):
                want = want[:start] + new + want[end:]
            text, tree, _ = token_counts.apply(text, tree, edits, whole, 16)
            assert (text, tree.chars[1], tree.tokens[1]) == (want, len(want), len(whole(want)))


def test_licences(spark):
    texts = [(1, "some prose here\nReleased under the MIT License.\nmore prose"), (2, "Licensed under the Apache License, Version 2.0."), (3, "words " * 300 + "This work is licensed under the GNU General Public License, version 3. " + "words " * 300), (4, "We like MIT and the apache people"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (None, "All rights reserved."), (1, "no licence")]
    df = D.frame(spark).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    model = licences.train(D.frame(spark))
    assert model.held_accuracy > 0.95
    assert len(model.predict(licences.normal("the of and"))) == 3
    got = Counter((r.doc_id, r.families) for r in licences.scan(df, model).collect() if r.doc_id is None or r.doc_id < 8)
    own = Counter((i, "") for i, *_ in D.rows() if i < 8)
    assert got == own + Counter({(1, "mit"): 1, (2, "apache"): 1, (3, "gpl"): 1, (4, ""): 1, (5, ""): 1, (6, ""): 1, (7, "cc-by-nc"): 1, (None, "proprietary"): 1, (1, ""): 1})
    place = licences.findings(spark.createDataFrame(texts[:1], "doc_id long, text string"), model).first()
    assert b"mit license" in texts[0][1].lower().encode()[place.start : place.end] and place.confirmed
    assert licences.scan(D.empty(spark), model).count() == 0


def test_licences_unknown_and_wrapped(spark):
    wrapped = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    texts = [(1, "some prose here\n\nDistributed under the Boost Software License, Version 1.0."), (2, "abc def\n\n" + wrapped + "\n\nghi"), (3, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    model = licences.train(D.frame(spark))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert (got[1].families, got[1].n_unknown, got[1].n_confirmed) == ("unknown", 1, 0)
    assert (got[2].families, got[2].n_findings, got[2].n_confirmed) == ("gpl", 1, 1)
    assert (got[3].families, got[3].n_findings) == ("cc-by-nc,mit", 2)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
MIT = """Copyright (c) 2021 The Authors. All rights reserved.
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
ZLIB = """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


def test_licence_headers_as_they_are_wrapped(spark):
    """Standard headers over several lines; a licence of which nothing was shown in training; prose."""
    model = licences.train(D.frame(spark))
    texts = [(1, f"some prose\n\n{BSD}\n\nmore"), (2, f"a first line\n\n{MIT}\n\nand on"), (3, f"abc\n\n{ZLIB}\n"), (4, "Made available under the terms of the Mulan Permissive Software License, Version 2."), (5, "thus " * 400 + "copyright " * 30), (6, MIT.replace("\n", " "))]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert (got[1].families, got[1].n_confirmed >= 1) == ("bsd", True)
    assert (got[2].families, got[2].n_confirmed) == ("mit", 1) and got[6].families == "mit"
    assert got[3].n_findings == got[3].n_unknown == 1 and got[4].families == "unknown"
    assert got[5].n_findings == 0


def brute_findings(text, model, certain=0.6, confirm=0.6):
    """The statements of a text, window by window, with plain lists."""
    import numpy as np

    def soft(words, before):
        one, total = [w for k, w in enumerate(words) if w != ([before, *words])[k]], np.array(model.bias, float)
        z = sum((model.weights[licences.single(licences.word_hashes([w]))[0]].astype(float) for w in one), np.zeros(len(licences.FAMILIES)))
        z += sum((model.weights[licences.paired(licences.word_hashes([a, b]))[0]].astype(float) for a, b in zip(words, words[1:], strict=False) if a != b), np.zeros(len(z)))
        z = (z / np.sqrt(len(words)) + total) / model.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    lines = [licences.normal(x) for x in text.split("\n")]
    flat = [w for x in lines for w in x]
    at = np.cumsum([0, *map(len, lines)])
    prob = lambda a, b: soft(flat[a:b], flat[a - 1] if a else None)
    found, runs, current, paragraph, number = [], [], None, [], 0
    for k, words in enumerate(lines):
        number += not words
        paragraph.append(number)
        if words:
            family, q = licences._judged(prob(at[k], at[k + 1]), certain)
            if family != "unknown" and model.share(family, words) >= confirm:
                found.append((at[k], at[k + 1], family, q, True, number))
                current = None
                continue
            if current is None:
                runs.append(current := [int(at[k]), 0, number])
            current[1] = int(at[k + 1])
        else:
            current = None
    for a, b, number in runs:
        groups = []
        for lo, hi in licences.windows(b - a):
            if (p := prob(a + lo, a + hi))[0] < 0.5:
                if not groups or a + lo > groups[-1][-1][1]:
                    groups.append([])
                groups[-1].append((a + lo, a + hi, p))
        for g in groups:
            sure = [x for x in g if x[2][2:].max() >= certain]
            best = max(sure, key=lambda x: x[2][2:].max()) if sure else min(g, key=lambda x: x[2][0])
            family, q = licences._judged(best[2], certain)
            found.append((g[0][0], g[-1][1], family, q, family != "unknown" and model.share(family, flat[g[0][0] : g[-1][1]]) >= confirm, number))
    licensed = {x[5] for x in found if x[2] != "proprietary"}
    return [(x[2], x[3], x[4]) for x in sorted(found) if x[2] != "proprietary" or x[5] not in licensed]


def test_licences_by_brute_force(spark):
    import random

    rnd, model = random.Random(31), licences.train(D.frame(spark))
    pool = [*BSD.split("\n"), *MIT.split("\n"), *ZLIB.split("\n"), "All rights reserved.", "Licensed under CC BY 4.0.", "", "", "the the the", *[t for texts in licences.TEMPLATES.values() for t in texts]]
    texts = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else D.prose(rnd, rnd.choice([1, 9, 40])) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    texts += [(i, t) for i, t in enumerate([BSD, MIT, ZLIB, " ".join([BSD, D.prose(rnd, 60), MIT])], 100)]
    got = defaultdict(list)
    for r in licences.findings(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), model).orderBy("doc_id", "start").collect():
        got[r.doc_id].append((r.family, pytest.approx(r.probability, abs=1e-5), r.confirmed))
    assert sum(map(len, got.values())) > 60
    for i, text in texts:
        assert brute_findings(text, model) == got[i], i
