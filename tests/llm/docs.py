"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, doc string, row long, n_words long, low long"


def prose(rnd, n, letters="abcdefghij"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(n))


def rows(seed=1):
    rnd = random.Random(seed)
    out = []
    for k in range(12):
        base = prose(rnd, rnd.choice([3, 8, 20, 60, 200])).split(" ")
        for j in range(6):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 30))):
                words[rnd.randrange(len(words))] = prose(rnd, 1)
            out.append((1000 + 10 * k + j, " ".join(words)))
    passage = prose(rnd, 60)
    out += [(2000 + j, prose(rnd, 15) + "\n" + passage + "\n" + prose(rnd, 15)) for j in range(8)]
    out += [(3000 + j, f"Posted {j} times by user {j * 7}\n{prose(rnd, 12)}\nAll rights reserved here.") for j in range(6)]
    out += [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a" * 300), (6, "ab" * 400), (7, "Ünïcödé ßtraße 日本語 " * 30), (8, "word " * 3000), (9, "A b\x0bC\x0cd e F\r\nG")]
    # Ids that follow in another order than the rows.
    rnd.shuffle(out)
    return [(i, t, "en", None, None if t is None else len(t), "k", None, 7, -1, 0) for i, t in out]


def frame(spark, more=()):
    return spark.createDataFrame([*rows(), *more], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


REPEATED = [(1000, None, None, None, None, None, None, None, None, None), (4, "x", None, None, None, None, None, None, None, None), (None, "no id at all " * 12, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
