"""The URL filter: parts and rules against plain Python, trees on held-out hosts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fastaxis.llm import url_filter as U

ODD = [
    None, "", "no scheme", "http://", "http://A.B.Com", "HTTP://ÄB.Example.COM/En/x", "http://example.com/en/", "http://x.example.com/en/1?q=/a#b", "http://www.example.com/en/p", "http://a.www.example.com/en/p", "http://www.a.example.com/en/p",
    "http://notexample.com/en/", "http://example.com/EN/", "http://example.com?x=://net/es/", "http://com/", "http://com", "ftp://a.net/es/", "http://a.net/fr", "http://net/fr/#x", "://net/es/y", "a://b://c.com/d", "http://example.com.net/fr/", "http://h#f/x", "http://h?/x", "http://a\nb.net/es/\n?",
    "http://" + "a" * 5000 + ".net/es/" + "b/" * 200_000, "http://a..net/es/", "http://user@x.com:80/en/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<html>", "mine", "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string, `a.b` string, suffix double")


def entropy(text):
    known = Counter(c if c in U._ALPHABET else "" for c in text)
    return -sum(n / len(text) * math.log2(n / len(text)) for n in known.values())


def test_parts_and_rules(spark):
    df = pages(spark, ODD * 2)
    got = {r.page_id: r for r in U.judge(df, U.labelled_by_words(df, F.col("url"))).collect()}
    assert len(got) == 2 * len(ODD)
    for i, url in enumerate(ODD * 2):
        host, path = parts(url)
        want, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want), url
        # Without a host to block there are labels of one kind only: what no rule fits is allowed.
        assert got[i].verdict == (verdict or "allow") and got[i].score == 0.0 and got[i]["a.b"] == "x"
    assert got[7].rule == "example.com/en/" and got[8].rule == "www.example.com/en/" and got[10].rule == "example.com/en/"


def test_no_rows_and_no_labels(spark):
    df = pages(spark, ODD)
    none = U.judge(df.limit(0), U.labelled_by_words(df.limit(0), F.col("url")))
    assert none.count() == 0 and {"page_id", "host", "path", "rule", "verdict", "score"} <= set(none.columns)
    unknown = U.judge(df, df.select("url", F.lit(None).cast("int").alias("label")))
    assert unknown.filter("rule is null and verdict <> 'allow'").count() == 0


def web(seed=5, n=3000):
    """Hosts of readable names, and others of digits and hyphens with long paths and many parameters: which of them are to be blocked, and the family."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    out = []
    for _ in range(n):
        if rnd.random() < 0.8:
            out.append((f"https://{rnd.choice(['www.', '', 'm.'])}{word()}.{rnd.choice(['org', 'info', 'net'])}/{word()}/{rnd.randint(1, 999)}" + ("?page=2" if rnd.random() < 0.3 else ""), 0, "good"))
        else:
            family = rnd.choice(["casino", "pills", "q7x"])
            out.append((f"http://{family}-{word()}-{rnd.randint(100, 99999)}.{rnd.choice(['org', 'info', 'xyz'])}/{'/'.join(word() for _ in range(4))}?a={rnd.randint(1, 9**9)}&b={rnd.randint(1, 9**9)}&sid={rnd.randint(1, 9**9)}", 1, family))
    return out


def test_trees_find_hosts_of_unseen_words(spark):
    rows = web()
    df = spark.createDataFrame(rows, "url string, bad int, family string")
    # One family is never shown, and neither is a third of the good URLs.
    shown = df.select("url", F.when(F.col("family") == "q7x", None).when((F.col("bad") == 0) & (F.crc32(F.encode("url", "utf-8")) % 3 == 0), None).otherwise(F.col("bad")).alias("label"))
    out = U.judge(df, shown, rules=()).cache()
    unseen = out.filter("family = 'q7x'")
    assert unseen.filter("verdict = 'block'").count() >= 0.95 * unseen.count()
    good = out.filter((F.col("bad") == 0) & (F.crc32(F.encode("url", "utf-8")) % 3 == 0))
    assert good.filter("verdict = 'allow'").count() >= 0.99 * good.count()
    assert out.filter("rule is not null or score < 0 or score > 1").count() == 0
    # The same scores again, from other partitions.
    again = U.judge(df.repartition(7), shown.repartition(3), rules=())
    assert sorted(map(tuple, again.select("url", "score").collect())) == sorted(map(tuple, out.select("url", "score").collect()))


def test_features_and_scores_by_hand(spark):
    rows = web(6, 400)
    urls = [u for u, _, _ in rows] + [u for u in ODD if u and len(u) < 1000]
    labels = spark.createDataFrame([(u, b) for u, b, _ in rows] + [(u, None) for u in urls[len(rows) :]], "url string, label int")
    model, statistics = U.fit(labels)
    made = U._features(U._parts(labels, F.col("url")), statistics)
    scored = model.transform(made).select("_row.url", *U.FEATURES, U.vector_to_array("_probability")[1].alias("p")).collect()
    total = len(urls)
    count = {n: Counter(".".join(parts(u)[0].split(".")[-n:]) for u in urls) for n in (1, 2)}
    bad = {n: Counter(".".join(parts(u)[0].split(".")[-n:]) for u, b, _ in rows if b) for n in (1, 2)}
    known = {n: Counter(".".join(parts(u)[0].split(".")[-n:]) for u, _, _ in rows) for n in (1, 2)}
    prior = sum(b for _, b, _ in rows) / len(rows)
    digits = lambda t: sum(c in "0123456789" for c in t) / len(t) if t else 0
    for r in scored:
        host, path = parts(r.url)
        query = r.url[r.url.index("?") + 1 :].split("#")[0] if "?" in r.url else ""
        want = [len(r.url), len(host), len(path), len(query), host.count(".") + 1, max(map(len, host.split("."))), path.count("/"), query.count("&") + 1 if query else 0, digits(r.url), digits(host), host.count("-"), sum(c in "aeiou" for c in host) / len(host) if host else 0, entropy(host) if host else 0, entropy(path) if path else 0]
        for n in (1, 2):
            s = ".".join(host.split(".")[-n:])
            group = [s] if count[n][s] >= U.COMMON * total else [x for x in count[n] if count[n][x] < U.COMMON * total]
            want += [sum(count[n][x] for x in group) / total, (sum(bad[n][x] for x in group) + U.PRIOR * prior) / (sum(known[n][x] for x in group) + U.PRIOR)]
        assert list(r[1 : 1 + len(U.FEATURES)]) == pytest.approx(want, abs=1e-9), r.url
    # The trees are Spark's own: the boosted sum of their leaves, through a logistic curve.
    gbt = model.stages[-1]
    r = scored[0]
    from pyspark.ml.linalg import Vectors

    x = Vectors.dense(list(r[1 : 1 + len(U.FEATURES)]))
    margin = sum(w * t.predict(x) for w, t in zip(gbt.treeWeights, gbt.trees, strict=True))
    assert r.p == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)


def test_rare_suffixes_share_one_line(spark):
    urls = [(f"http://a{i}.t{i}/", 0) for i in range(1500)] + [("http://big.org/", 1)] * 500
    labels = spark.createDataFrame(urls, "url string, label int")
    rows = U.suffix_statistics(U._parts(labels, F.col("url")).withColumn("_label", F.col("_row.label"))).collect()
    assert {(r.length, r.suffix) for r in rows} == {(1, None), (1, "org"), (2, None), (2, "big.org")}
    assert {r.suffix: r.share for r in rows if r.length == 1} == {None: 0.75, "org": 0.25}
