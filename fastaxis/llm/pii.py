"""Operator 3, personal data: seed patterns, and identifiers that context gives away.

Seeds are the matches of four fixed patterns. The words around an identifier are its lexical
patterns: the two words before it, the two words after it, and the word on either side. Over
all documents, patterns and identifiers form a graph, scored in turns: a pattern's confidence
for a kind is the share of its identifiers that are of that kind, weighed by their scores; an
identifier's score for a kind is the mean confidence of its patterns, and 1 for a seed.
Patterns of high confidence and support then mark identifiers that no seed pattern matched
(numbers written in other ways, addresses with other signs). These are seeds to the next
generation, whose patterns may be new ones, until no pattern is added. Spans of seeds are
never taken away, and what overlaps one is never marked.

Main path: DataFrame functions only. Every text is read once; what is written to the shared
folder and shuffled later is only the matches. A text takes time in proportion to its length
and its matches (times the logarithm of these, where they are compared). The graph's tables
hold one row per pattern and identifier, combined before each shuffle, so a frequent pattern
or identifier is no large group.

Defined results: a null or empty text has no spans; repeated rows are found separately
(rows are told apart by a number of their own, not by doc_id); U+0001 in a text counts as
one character that matches nothing; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import is_small, remove, written

KINDS = ("email", "ip", "card", "phone")
#: The seeds, anchored so that a run that can't begin a match is tried once only; possessive, as none of them gains by going back.
_SEEDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may turn out as an identifier: a number of 8 to 19 digits however grouped, or one of four parts as addresses have
#: (these may have four digits only); a name and a domain around an at sign or its paraphrase.
_NUMBER = r"(?<![0-9])[0-9](?:[\x20()\[\]./_-]{0,3}[0-9]){3,}+"
_FOUR_PARTS = r"^[0-9]{1,3}(?:[^0-9]+[0-9]{1,3}){3}\z"
_ADDRESS = r"(?<![^\s@\[(])[^\s@\[(]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@]++"
_MARK = "\x01"
_FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Turns of scoring; what a pattern needs before it marks anything. After six turns a confidence of 0.9 is that of a
#: pattern of which a third of the identifiers are seeds, and the others stand in no pattern that says otherwise.
TURNS, MIN_CONFIDENCE, MIN_SEEDS = 6, 0.9, 5
#: Characters of context on either side; pieces of a text that are located together.
CONTEXT, BLOCK = 60, 256


def bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def located(pieces: Column) -> Column:
    """The odd ones of a text's pieces, with their code point offsets and the characters around them.

    Growing an array one by one takes quadratic time. So pieces are located in blocks: first
    the blocks' own places, then the pieces of each.
    """
    hit = lambda x, i, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("value"), F.right(F.get(pieces, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after"))
    size = lambda block: F.aggregate(F.slice(pieces, block * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + F.length(x))

    def ends(sizes: Column) -> Column:
        begin = F.array(F.lit(0))
        return F.aggregate(sizes, begin, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def inside(block: Column, at: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            end = a["at"] + F.length(p["x"])
            return F.struct(end.alias("at"), F.when(p["i"] % 2 == 1, F.concat(a["out"], F.array(hit(p["x"], p["i"], a["at"])))).otherwise(a["out"]).alias("out"))

        numbered = F.transform(F.slice(pieces, block * BLOCK + 1, F.lit(BLOCK)), lambda x, i: F.struct(x.alias("x"), (block * BLOCK + i).alias("i")))
        return F.aggregate(numbered, F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out")), step, lambda a: a["out"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    return bind(blocks, lambda b: bind(ends(F.transform(b, size)), lambda at: F.flatten(F.transform(b, lambda k: inside(k, F.get(at, k))))))


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """All leftmost matches with code point offsets, and the characters before and after each."""
    none = F.array().cast(_FOUND)
    cut = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = bind(cut, lambda p: F.when(F.size(p) > 1, located(p)).otherwise(none))
    return found if hint is None else F.when(hint, found).otherwise(none)


def overlaps(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of some disjoint spans in order: the last that begins before its end, by bisection."""
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")

    def step(a: Column, _: Column) -> Column:
        below = F.coalesce(F.get(spans, middle(a))["start"] < x["end"], F.lit(False))
        return F.struct(F.when(below, middle(a) + 1).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(middle(a)).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    count = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step, lambda a: a["lo"])
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, count - 1)["end"] > x["start"], F.lit(False))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def passes_luhn(value: Column) -> Column:
    """The checksum of payment card numbers, over the value's digits."""

    def check(d: Column) -> Column:
        digit = lambda i: F.ascii(F.substring(d, F.length(d) - i, F.lit(1))) - 48
        doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
        return F.length(d).between(16, 19) & (total % 10 == 0)

    return bind(digits(value), check)


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
_VALID = {
    "email": None,
    "ip": lambda x: x["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}\z"),
    "card": lambda x: F.when(F.length(x["value"]) >= 16, passes_luhn(x["value"])).otherwise(F.lit(False)),
    "phone": lambda x: F.length(digits(x["value"])).between(8, 15),
}


def scanned(docs: DataFrame) -> DataFrame:
    """Each row's seeds by kind and its other candidates, without the text."""
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_MARK), F.lit("\x02"))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    numeric = F.col("t").rlike("[0-9]")
    hints = {"email": F.contains("t", F.lit("@")), "ip": numeric, "card": numeric, "phone": F.contains("t", F.lit("+"))}
    seeds = []
    for kind, pattern in _SEEDS.items():
        found = matches(F.col("t"), pattern, hints[kind])
        seeds.append((found if _VALID[kind] is None else F.filter(found, _VALID[kind])).alias(kind))
    df = df.select("doc_id", *seeds, matches(F.col("t"), _NUMBER, numeric).alias("number"), matches(F.col("t"), _ADDRESS, F.contains("t", F.lit("@")) | F.contains("t", F.lit("at]")) | F.contains("t", F.lit("at)"))).alias("address"))
    apart = lambda c, *kinds: F.filter(c, lambda x: ~functools.reduce(lambda a, b: a | b, [overlaps(F.col(k), x) for k in kinds]))
    able = F.filter(F.col("number"), lambda x: F.length(digits(x["value"])).between(8, 19) | x["value"].rlike(_FOUR_PARTS))
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, apart(able, *KINDS).alias("number"), apart(F.col("address"), *KINDS, "number").alias("address"))


def patterns_of(x: Column) -> Column:
    """The lexical patterns around a match, lower-cased: two words before it, two after it, one on either side; those of them that there are."""
    gap = r"[^\p{L}\p{N}]"
    word = lambda text, pattern, k: F.lower(F.regexp_extract(text, pattern, k))
    two_before, two_after = rf"(\p{{L}}+){gap}+(\p{{L}}+){gap}*\z", rf"^{gap}*(\p{{L}}+){gap}+(\p{{L}}+)(?!\p{{L}})"
    one_before, one_after = rf"(\p{{L}}+){gap}*\z", rf"^{gap}*(\p{{L}}+)(?!\p{{L}})"
    sides = [
        (F.lit("{0} {1} _"), word(x["before"], two_before, 1), word(x["before"], two_before, 2)),
        (F.lit("_ {0} {1}"), word(x["after"], two_after, 1), word(x["after"], two_after, 2)),
        (F.lit("{0} _ {1}"), word(x["before"], one_before, 1), word(x["after"], one_after, 1)),
    ]
    made = [F.when((a != "") & (b != ""), F.replace(F.replace(form, F.lit("{0}"), a), F.lit("{1}"), b)) for form, a, b in sides]
    return F.array_compact(F.array(*made))


def accepted_patterns(found: DataFrame, turns: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """Scores the graph of patterns and identifiers; the patterns that may mark, with their kind."""
    named = lambda kind, column: found.select(F.explode(column).alias("x")).select(F.lit(kind).alias("kind"), F.explode(patterns_of(F.col("x"))).alias("pattern"), F.col("x.value").alias("identifier"))
    edges = None
    for kind, column in [*((k, k) for k in KINDS), ("", "number"), ("", "address")]:
        edges = named(kind, column) if edges is None else edges.unionByName(named(kind, column))
    edges = edges.groupBy("pattern", "identifier").agg(F.max("kind").alias("seed"), F.count("*").alias("n"))
    edges = written(edges, "pii-edges")
    seeds = edges.filter("seed <> ''").select("identifier", F.col("seed").alias("kind")).distinct()
    instances, good = written(seeds, "pii-instances"), None
    while True:
        # Only patterns that enough instances stand in can mark; the others say nothing.
        support = edges.join(instances, "identifier").groupBy("pattern", "kind").agg(F.count("*").alias("support")).filter(F.col("support") >= min_seeds)
        able = written(support, "pii-able")
        graph = written(edges.join(able.select("pattern").distinct(), "pattern").join(instances.withColumnRenamed("kind", "known"), "identifier", "left"), "pii-graph")
        found_good = able.join(_confidence(graph, turns), ["pattern", "kind"]).filter(F.col("confidence") >= min_confidence)
        before, good = good, written(found_good.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence")), "pii-good")
        remove(able, graph, instances)
        if good.count() <= (before.count() if before is not None else 0):
            remove(edges, *([before] if before is not None else []))
            return good
        if before is not None:
            remove(before)
        # What the patterns mark are seeds of the next generation.
        marked = edges.filter("seed = ''").join(good, "pattern").filter(fits("identifier")).select("identifier", "kind")
        instances = written(seeds.unionByName(marked).distinct(), "pii-instances")


def _confidence(graph: DataFrame, turns: int) -> DataFrame:
    """(pattern, kind, confidence) after so many turns over (pattern, identifier, n, known: the kind of an instance).

    A turn's scores of identifiers that are no instances come from the turn before.
    """
    size = graph.groupBy("pattern").agg(F.count_distinct("identifier").alias("size"))
    certain = graph.filter("known is not null").select("pattern", F.col("known").alias("kind"), F.lit(1.0).alias("score"))
    unknown = graph.filter("known is null").select("pattern", "identifier", "n")
    rated = certain
    for turn in range(turns):
        confidence = written(rated.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")).join(size, "pattern").select("pattern", "kind", (F.col("mass") / F.col("size")).alias("confidence")), "pii-confidence")
        if turn and turn == turns - 1 or unknown.isEmpty():
            break
        scores = unknown.join(confidence, "pattern").groupBy("identifier", "kind").agg((F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("score"))
        rated = certain.unionByName(unknown.join(scores, "identifier").select("pattern", "kind", "score"))
    return confidence


def fits(value: str) -> Column:
    """Only kinds that fit: an address can't be a number of any kind, nor the other way round; a number of fewer than 8 digits can only be an ip."""
    short = F.length(digits(F.col(value))) < 8
    return F.when(F.col(value).rlike(r"@|at[\])]"), F.col("kind") == "email").otherwise((F.col("kind") != "email") & ((F.col("kind") == "ip") | ~short))


def find(docs: DataFrame, turns: int = TURNS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS, small: int = 20_000) -> DataFrame:
    """One row per document row: counts, the seeds' digest, and all spans as kind:start:end."""
    found = written(scanned(docs), "pii")
    good = accepted_patterns(found, turns, min_confidence, min_seeds)
    others = found.filter((F.size("number") > 0) | (F.size("address") > 0)).select("row", F.explode(F.concat("number", "address")).alias("x")).withColumn("pattern", F.explode(patterns_of(F.col("x"))))
    each = others.join(F.broadcast(good) if is_small(good, small) else good, "pattern").filter(fits("x.value"))
    # Of several kinds that its patterns speak for, the surest.
    marked = each.groupBy("row", F.col("x.start").alias("start"), F.col("x.end").alias("end")).agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    extra = marked.groupBy("row").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("kind", "start", "end")))).alias("extra"))
    spans = lambda kind, column: F.transform(column, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("start"), x["end"].alias("end")))
    place = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(place, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.concat(*[spans(k, F.col(k)) for k in KINDS])
    more = F.coalesce(F.transform("extra", lambda x: F.struct((F.array_position(place, x["kind"]) - 1).cast("int").alias("k"), x["start"].alias("start"), x["end"].alias("end"))), F.array().cast("array<struct<k:int,start:int,end:int>>"))
    return found.join(extra, "row", "left").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat(base, more))).alias("spans"),
    )
