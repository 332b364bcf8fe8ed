"""URL filter: rules by host and path, and gradient-boosted trees over lexical features for the rest.

All of it is DataFrame and SQL functions: features are expressions over the URL's own text, suffix
statistics come from one aggregation over all URLs, and the trees are Spark's own. A suffix has
statistics of its own from COMMON of all URLs on, so that at most 1 / COMMON of each length exist
at any size of the input: that is the bound of what is broadcast. Rarer suffixes share one line.

The trees are fitted on at most SAMPLE labelled rows of each kind, those with the least hashes of
their URLs, weighted so that the kinds count as they do among all labelled rows. Suffix statistics
count all URLs and all labels.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule and
is judged as what is left of it; repeated rows get one verdict each; an empty table gives no rows;
with labels of one kind only, or none, nothing can be learnt and every URL that no rule fits is
allowed, with a score of 0. Further columns are handed on by judge(), whatever their names: its own
columns take the place of those of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import hash_sample, remove, written

#: Rules as (verdict, host, path): fixed values of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of a host that mark it as unwanted, the seeds of labelled_by_words().
WORDS = ("ads", "adult", "adserver", "bet", "bets", "bingo", "casino", "cialis", "escort", "gambling", "hentai", "jackpot", "lottery", "pharmacy", "phishing", "pills", "poker", "porn", "roulette", "sex", "slots", "spam", "viagra", "warez", "xxx")
#: Labelled rows of each kind that the trees are fitted on; the share of all URLs from which a suffix has its own statistics.
SAMPLE, COMMON = 20_000, 0.001
#: Rounds, depth and step of the boosting; the rows by which a suffix's rate leans to the rate of all.
ROUNDS, DEPTH, STEP, PRIOR = 20, 4, 0.2, 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_chars", "host_chars", "path_chars", "query_chars", "host_labels", "longest_label", "depth", "parameters", "digit_ratio", "host_digit_ratio", "host_hyphens", "vowel_ratio", "host_entropy", "path_entropy", "suffix1_share", "suffix1_rate", "suffix2_share", "suffix2_rate",
)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without a ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits: its host or a subdomain, and the beginning of the path; null if none does.

    The rules are a short list of the caller's: one branch each.
    """
    out = None
    for verdict, name, begin in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + begin).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def _count(text: Column, chars: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


#: Characters that the entropies tell apart; all others count as one.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_./%"


def _entropy(text: Column) -> Column:
    """Bits a character, over letters, digits, the usual marks and everything else."""
    n = F.length(text)
    bits = lambda k: F.when(k > 0, -_share(k, n) * F.log2(_share(k, n))).otherwise(0.0)
    known = F.aggregate(F.array(*[F.lit(c) for c in _ALPHABET]), F.lit(0.0), lambda acc, c: acc + bits(n - F.length(F.replace(text, c, F.lit("")))))
    return known + bits(n - _count(text, _ALPHABET))


def _suffix(labels: int) -> Column:
    return F.substring_index(F.col("_host"), ".", -labels)


def _parts(df: DataFrame, url: Column) -> DataFrame:
    """The rows with what the features are made of, beside a struct of all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(row, F.coalesce(url.cast("string"), F.lit("")).alias("_url")).withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))}).withColumns({"_suffix1": _suffix(1), "_suffix2": _suffix(2)})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(length, suffix, share, rate): suffixes that COMMON of all URLs have, and one line without a suffix for the others of each length.

    labelled: (_suffix1, _suffix2, _label), the label null where there is none. One aggregation by
    the longer suffix, combined before its shuffle; the shorter ones are summed from its result.
    """
    counts = lambda df, key: df.groupBy(key).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    one = labelled.select("_suffix1", "_suffix2", F.lit(1).cast("long").alias("n"), F.col("_label").isNotNull().cast("long").alias("known"), F.coalesce(F.col("_label"), F.lit(0)).cast("long").alias("bad"))
    two = written(one.groupBy("_suffix1", "_suffix2").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")]), "suffixes")
    total = two.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "known", "bad")]).first()
    prior = total[2] / total[1] if total[1] else 0.0
    levels = []
    for length in (1, 2):
        own = F.when(F.col("n") >= COMMON * total[0], F.col(f"_suffix{length}"))
        pooled = counts(counts(two, f"_suffix{length}").withColumn("suffix", own), "suffix")
        levels.append(pooled.select(F.lit(length).alias("length"), "suffix", (F.col("n") / F.lit(max(total[0], 1))).alias("share"), ((F.col("bad") + PRIOR * prior) / (F.col("known") + PRIOR)).alias("rate")))
    out = written(levels[0].unionByName(levels[1]), "suffixes")
    remove(two)
    return out


def _features(parts: DataFrame, statistics: DataFrame) -> DataFrame:
    """The parts with the columns of FEATURES; the statistics are a table of bounded size."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    simple = {
        "url_chars": F.length(url), "host_chars": F.length(host), "path_chars": F.length(path), "query_chars": F.length(query),
        "host_labels": _count(host, ".") + 1, "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "depth": _count(path, "/"), "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "digit_ratio": _share(_count(url, "0123456789"), F.length(url)), "host_digit_ratio": _share(_count(host, "0123456789"), F.length(host)), "host_hyphens": _count(host, "-"),
        "vowel_ratio": _share(_count(host, "aeiou"), F.length(host)), "host_entropy": _entropy(host), "path_entropy": _entropy(path),
    }
    out = parts.withColumns({k: v.cast("double") for k, v in simple.items()})
    for length in (1, 2):
        mine = statistics.filter(F.col("length") == length)
        table = F.broadcast(mine.filter("suffix is not null").select(F.col("suffix").alias(f"_suffix{length}"), F.struct("share", "rate").alias("_own")))
        rest = mine.filter("suffix is null").first()
        out = out.join(table, f"_suffix{length}", "left")
        out = out.withColumns({f"suffix{length}_{c}": F.coalesce(F.col(f"_own.{c}"), F.lit(rest[c] if rest else 0.0)) for c in ("share", "rate")}).drop("_own")
    return out


def labelled_by_words(df: DataFrame, url: Column, words: Sequence[str] = WORDS) -> DataFrame:
    """(url, label): all URLs of a table, 1 where a word of the host is in the list, else 0."""
    found = F.arrays_overlap(F.split(host_of(url), "[^a-z]+"), F.array(*[F.lit(w) for w in words]))
    return df.select(url.cast("string").alias("url"), F.coalesce(found, F.lit(False)).cast("int").alias("label"))


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 0) -> tuple[PipelineModel | None, DataFrame]:
    """The model (None where one kind of label is missing) and the suffix statistics of (url, label); label is 1, 0 or null."""
    parts = _parts(labelled, F.col("url")).withColumn("_label", F.col("_row.label"))
    statistics = suffix_statistics(parts)
    known = {r.label: r["count"] for r in labelled.filter("label is not null").groupBy("label").count().collect()}
    if not (known.get(0) and known.get(1)):
        return None, statistics
    chosen = [hash_sample(labelled.filter(F.col("label") == k).select(F.coalesce("url", F.lit("")).alias("url"), "label"), "url", sample, n).withColumn("weight", F.lit(float(n)) / min(n, sample)) for k, n in known.items() if k in (0, 1)]
    # At most 2 x SAMPLE narrow rows: one partition, so that sums of doubles have one order and the trees are the same each time.
    rows = written(chosen[0].unionByName(chosen[1]), "labelled")
    made = _features(_parts(rows, F.col("url")), statistics).select(*FEATURES, F.col("_row.label").cast("double").alias("_label"), F.col("_row.weight").alias("_weight"), "_url").repartition(1).sortWithinPartitions("_url", "_label").drop("_url")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_predicted", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=seed).setProbabilityCol("_probability").setRawPredictionCol("_raw")
    model = trees.fit(assembler.transform(made))
    remove(rows)
    return PipelineModel([assembler, model]), statistics


def judge(df: DataFrame, labelled: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows with host, path, rule, verdict and score: a rule's verdict where one fits, else block where the trees' probability is 0.5 or more.

    labelled: (url, label) with label 1 for URLs to block, 0 for others, null for unknown ones.
    """
    model, statistics = fit(labelled, sample)
    parts = _parts(df, F.col(f"`{url}`"))
    if model is None:
        scored = parts.withColumn("_score", F.lit(0.0))
    else:
        scored = model.transform(_features(parts, statistics)).withColumn("_score", vector_to_array("_probability")[1])
    scored = scored.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    own = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), F.when(F.col("_score") >= 0.5, "block").otherwise("allow")), "score": F.col("_score")}
    return scored.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() not in own], *[v.alias(k) for k, v in own.items()])
