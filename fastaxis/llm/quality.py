"""Operator 7, quality rules under weak supervision.

Each rule looks at one trait of a document and votes good or bad on it, or abstains.
Expectation-maximisation over the counts of vote patterns estimates each rule's accuracy on
good and on bad documents; a document's verdict is its posterior probability of being good.
Nothing has to pass every rule: votes outweigh each other as the estimates say.

Main path: DataFrame functions only. One pass over the texts writes a narrow table of
measurements to the shared folder; the vote patterns (3 to the number of rules at most)
are counted from it over all documents; the fitted model is a sum of literals in the last
projection. No text is shuffled, and none is written but in the result.

Defined results: a null or empty text has no words and fails the base rules; repeated rows
give repeated results; an empty table gives none and the model keeps its prior; further
columns of the documents are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import remove, written

#: White space between words: space and the five controls from tab to carriage return.
_SPACE = " \t\n\x0b\f\r"
_SPACES = r"[ \t\n\x0B\f\r]+"
#: Where the estimation begins: the share of good documents, a rule's accuracy on good and on bad ones; how strongly that counts, in documents.
PRIOR_GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD, PRIOR_WEIGHT, ROUNDS = 0.8, 0.99, 0.3, 10.0, 500


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of characters other than white space."""
    inner = F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACES))


def window_hashes(hashes: Column, n: int) -> Column:
    """The hashes of all n-word windows of an array of word hashes; n is a power of two.

    Windows are doubled: the hash of 2k words is that of the two hashes of k words.
    """

    def longer(h: Column, k: int) -> Column:
        if k == n:
            return F.slice(h, F.lit(1), F.size(h) - (n - 1))
        # At the end there is no second half; those entries are cut off when all windows are made.
        return bind(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k))), lambda y: longer(y, 2 * k))

    return longer(hashes, 1)


def repeated_words(hashes: Column, n: int) -> Column:
    """How many words lie in n-word windows that the array of word hashes holds twice or more."""

    def covered(places: Column) -> Column:
        step = lambda a, p: F.struct((p + n).cast("int").alias("end"), (a["n"] + n - F.greatest(a["end"] - p, F.lit(0))).cast("long").alias("n"))
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])

    def among(ranked: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(ranked, j - 1)["h"]) | (x["h"] == F.get(ranked, j + 1)["h"])
        return covered(F.sort_array(F.transform(F.filter(ranked, lambda x, j: F.coalesce(same(x, j), (F.get(ranked, j + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"])))

    def of(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bind(ranked, among))

    return F.when(F.size(hashes) <= n, F.lit(0).cast("long")).otherwise(bind(window_hashes(hashes, n), of))


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """What the rules look at: doc_id and one row of numbers per document; with ``whole``, the document's row as ``row`` too.

    The numbers come out of a generator, so that a filter on them doesn't compute them again.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    docs = docs.select(row.alias("row")) if whole else docs.select(F.struct("doc_id", "text").alias("row"))
    text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\f\r", "    ")) != "")
    base = docs.select("row", text.alias("t"), words_of(text).alias("w")).select("row", "t", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), lines.alias("l"))
    found = lambda pattern: F.regexp_count("t", F.lit(pattern))
    numbers = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": found(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": repeated_words(F.col("h"), 8),
        "n_lines": F.size("l"),
        "n_distinct": F.size(F.array_distinct("h")),
        "n_capitals": found(r"[A-Z]"),
        "n_cries": found(r"[!?]"),
        "n_single": F.size(F.filter("w", lambda x: F.length(x) == 1)),
        "n_short": F.size(F.filter("w", lambda x: F.length(x) <= 3)),
        "n_stops": found(r"[.!?;:](?=[ \t\n\x0B\f\r]|\z)"),
    }
    made = base.select("row", F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in numbers.items()]))))
    doc_id = F.col("row")["doc_id"].cast("long").alias("doc_id")
    return made.select(*["row"] * whole, doc_id, *numbers)


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule: when it votes good, and when bad; it abstains otherwise. All are over the columns of measured().

    A rule looks at one trait of a text, whatever the others see.
    """
    some = F.col("n_words") > 0
    share = lambda c, of="n_words": F.col(c) / F.greatest(F.col(of), F.lit(1))
    vote = lambda good, bad: (some & good, some & bad)
    length = share("word_chars")
    # The longer a text, the fewer of its words are new: beyond this length the share says little.
    short = F.col("n_words") <= 2000
    return {
        "symbols": vote(share("n_symbols") < 0.05, share("n_symbols") > 0.1),
        "capitals": vote(share("n_capitals", "word_chars") < 0.15, share("n_capitals", "word_chars") > 0.3),
        "cries": vote(share("n_cries") < 0.1, share("n_cries") > 0.25),
        "repeats": vote(F.col("n_repeat_words") == 0, share("n_repeat_words") >= 0.2),
        "dup_lines": vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3), share("n_dup_lines", "n_lines") >= 0.1),
        "word_length": vote(length.between(3, 6.5), (length < 2.5) | (length > 7)),
        "stops": vote(share("n_stops").between(0.02, 0.4), (share("n_stops") < 0.01) | (share("n_stops") > 0.5)),
        "short_words": vote(share("n_short").between(0.15, 0.55), (share("n_short") < 0.08) | (share("n_short") > 0.65)),
        "single_signs": vote(share("n_single") < 0.1, share("n_single") > 0.2),
        "variety": vote(short & (share("n_distinct") > 0.5), short & (share("n_distinct") < 0.35)),
    }


class Fit:
    """What the estimation found: the prior's log odds, and what a good and a bad vote of each rule add to them.

    A vote never counts against its own meaning: that of a rule no better than chance adds nothing.
    """

    def __init__(self, prior: float, good: list[float], bad: list[float]):
        self.prior, self.good, self.bad = prior, good, bad
        self.odds = math.log(prior / (1 - prior))
        self.for_good = [max(0.0, math.log(g / (1 - b))) for g, b in zip(good, bad, strict=True)]
        self.for_bad = [min(0.0, math.log((1 - g) / b)) for g, b in zip(good, bad, strict=True)]

    def score(self, votes: tuple[int, ...]) -> float:
        """The log odds of being good after these votes (1, -1, or 0 for none)."""
        return self.odds + sum(self.for_good[j] if v > 0 else self.for_bad[j] for j, v in enumerate(votes) if v)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> Fit:
    """Expectation-maximisation over (the rules' votes, documents).

    Of each rule that voted, two accuracies: how often it votes good on good documents, and bad
    on bad ones. The votes count as independent within a class, abstaining as no evidence. The
    estimates are held by nothing but a start that counts as PRIOR_WEIGHT documents: a rule
    seldom trips on a good document and misses most bad ones, as texts are bad in one way or another.
    """
    prior, good, bad = PRIOR_GOOD, [RIGHT_ON_GOOD] * n_rules, [RIGHT_ON_BAD] * n_rules
    for _ in range(ROUNDS):
        now = Fit(prior, good, bad)
        every = all_good = 0.0
        seen, hit = [[0.0, 0.0] for _ in range(n_rules)], [[0.0, 0.0] for _ in range(n_rules)]
        for votes, count in patterns:
            p = count / (1 + math.exp(-max(-500.0, min(500.0, now.score(votes)))))
            every, all_good = every + count, all_good + p
            for j, v in enumerate(votes):
                if v:
                    seen[j][0] += p
                    seen[j][1] += count - p
                    hit[j][v < 0] += p if v > 0 else count - p
        before = [prior, *good, *bad]
        mean = lambda a, n, start: (a + PRIOR_WEIGHT * start) / (n + PRIOR_WEIGHT)
        prior = mean(all_good, every, PRIOR_GOOD)
        good = [mean(h[0], n[0], RIGHT_ON_GOOD) for h, n in zip(hit, seen, strict=True)]
        bad = [mean(h[1], n[1], RIGHT_ON_BAD) for h, n in zip(hit, seen, strict=True)]
        if max(abs(a - b) for a, b in zip(before, [prior, *good, *bad], strict=True)) < 1e-9:
            break
    return Fit(prior, good, bad)


def voted() -> list[Column]:
    """Each rule's vote: 1, -1 or 0."""
    return [F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).alias(k) for k, (good, bad) in rules().items()]


def estimated(found: DataFrame) -> Fit:
    """The model fitted to measured documents, all of them; at most 3 to the number of rules patterns of votes are counted."""
    names = list(rules())
    patterns = found.select(*voted()).groupBy(*names).count().collect()
    return fit(sorted((tuple(r[:-1]), r[-1]) for r in patterns), len(names))


def judged(model: Fit) -> tuple[Column, Column, Column]:
    """Over the columns of measured(): the base rules' failure, the posterior of being good, and the verdict."""
    score = F.lit(model.odds)
    for (good, bad), up, down in zip(rules().values(), model.for_good, model.for_bad, strict=True):
        score = score + F.when(bad, F.lit(down)).when(good, F.lit(up)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), score))))
    return failed, posterior, ~failed & (posterior >= 0.5)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: measurements, the base verdict, the posterior of being good, how many rules voted bad, and kept."""
    found = written(measured(docs), "quality")
    failed, posterior, kept = judged(estimated(found))
    against = sum((F.when(bad, 1).otherwise(0) for _, bad in rules().values()), F.lit(0))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), posterior.alias("p_good"), against.cast("long").alias("n_bad_votes"))


def good_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that quality() keeps.

    Only numbers are written for the estimation. The texts are measured again as they are
    filtered: that takes the time of a second pass, and no copy of the corpus.
    """
    found = written(measured(docs), "quality")
    model = estimated(found)
    remove(found)
    _, _, kept = judged(model)
    return measured(docs, whole=True).filter(kept).select(*[F.col("row")[c].alias(c) for c in docs.columns])
