"""URL filter: allow and block rules, then gradient-boosted trees on lexical features.

Trees see only the URL's letters: lengths, depth, digit ratio, entropy, parameters,
hyphens, and suffix statistics: the share of blocked URLs among labelled ones with the same
last two labels of the host, and with a word of the host that has a suffix of the same first
four letters (the mean and the largest over all suffixes of its words).  Shares have a prior, so what was never seen gets
the mean, and are held in tables of ``BUCKETS`` hashed entries whatever the number of
labelled URLs; training rows take theirs from the other half of the labelled URLs.

Labelled URLs are a parameter.  The default ones are URLs of the table, labelled by whether
their host holds a word of ``BLOCK_WORDS`` (at most ``SAMPLE``), and ``MADE`` generated ones
that build good and bad hosts alike: one, two or three words, joined or with hyphens, with
digits or not.  What marks a bad one is a listed word anywhere in its host and, more often
than in a good one, digits, long opaque parameters and deep paths.  So no single mark, such
as a hyphen, decides.  Everything runs as SQL expressions and Spark ML.

Defined results: a URL that is null or holds no ``://`` has an empty host and path, fits
no rule and is judged by its letters; very long URLs are read whole; repeated rows each get
their verdict; an empty table gives an empty table; only ``page_id`` and ``url`` are read, so
other columns may have any name.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.llm.common import let
from depthline.llm.trees import margin

# The rules of the list, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Host words that mark labelled URLs to be blocked.
BLOCK_WORDS = ("ads", "adserver", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "loans", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "tracking", "viagra", "warez", "xxx")
# Words of ordinary hosts, for generated URLs.
PLAIN_WORDS = ("news", "city", "library", "garden", "school", "music", "travel", "weather", "recipes", "museum", "sport", "books", "health", "river", "market", "photo", "history", "science", "family", "winter", "street", "farm", "track", "cheap", "free", "win", "best", "online", "club", "world", "blog", "shop", "forum", "guide", "house", "studio")
SYLLABLES = ("tion", "thre", "hand", "lore", "mond", "ster", "ving", "bel", "ora", "kin", "th", "er", "an", "re", "on", "st", "ha", "ly", "ou", "en", "es", "ing", "ed", "he", "in", "at")
SAMPLE, MADE, BUCKETS = 4000, 4000, 1 << 15
#: Labelled URLs that a share counts as before any is seen.
PRIOR = 2.0
LEXICAL = ["f_url_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_entropy", "f_host_entropy", "f_params", "f_hyphens", "f_query_len"]
FEATURES = [*LEXICAL, "f_suffix", "f_heads", "f_heads_max"]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    safe = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(safe, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(safe, _PARTS, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    def of(chars: Column) -> Column:
        n = F.length(text)
        shares = F.transform(chars, lambda c: (n - F.length(F.replace(text, c))) / n)
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    distinct = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(F.length(text) > 0, let(distinct, of)).otherwise(F.lit(0.0))


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (with ``url``) plus ``host, path, suffix`` and all features but ``f_suffix``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    df = df.withColumns({"host": host, "path": path})
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda c, p: F.length(F.regexp_replace(c, f"[^{p}]+", "")).cast("double")
    return df.withColumns({
        "suffix": _suffix(F.col("host")),
        "f_url_len": F.log1p(F.length(url)),
        "f_host_len": F.length("host").cast("double"),
        "f_path_len": F.log1p(F.length("path")),
        "f_depth": count(F.col("path"), "/"),
        "f_labels": count(F.col("host"), "."),
        "f_digits": count(url, "0-9") / F.greatest(F.length(url), F.lit(1)),
        "f_host_digits": count(F.col("host"), "0-9"),
        "f_entropy": _entropy(url),
        "f_host_entropy": _entropy(F.col("host")),
        "f_params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(F.lit(0.0)),
        "f_hyphens": count(F.col("host"), "-"),
        "f_query_len": F.log1p(F.length(query)),
    })


def _keys(host: Column) -> tuple[Column, Column]:
    """Buckets of the host's last two labels and of the first four letters of every suffix of its words."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    words = F.filter(F.split(host, "[^a-z]+"), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w) - 3, F.lit(1)))
    heads = F.flatten(F.transform(words, lambda w: F.transform(starts(w), lambda i: bucket(F.substring(w, i, F.lit(4))))))
    return bucket(_suffix(host)), F.array_distinct(heads)


def _share_tables(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Block shares by bucket, of suffixes and of heads; at most ``BUCKETS`` entries each go through the driver."""
    mean = rows.agg(F.avg("label")).first()[0] or 0.0
    tables = []
    for key in (F.col("suffix_key"), F.explode("head_keys")):
        table = [mean] * BUCKETS
        for r in rows.select("label", key.alias("k")).groupBy("k").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")).collect():
            table[r["k"]] = (r["s"] + PRIOR * mean) / (r["n"] + PRIOR)
        tables.append(table)
    return tables[0], tables[1]


def _with_shares(rows: DataFrame, tables: tuple[list[float], list[float]]) -> DataFrame:
    # Four digits keep the literals, which stand in every plan, small.
    suffix, heads = (F.from_json(F.lit(json.dumps([round(x, 4) for x in t])), "array<double>") for t in tables)
    mean = F.lit(sum(tables[1]) / BUCKETS)
    shares = rows.withColumn("_shares", F.transform("head_keys", lambda k: F.get(heads, k)))
    of = lambda c: F.when(F.size("_shares") > 0, c).otherwise(mean)
    return shares.withColumns({"f_suffix": F.get(suffix, F.col("suffix_key")), "f_heads": of(F.aggregate("_shares", F.lit(0.0), lambda a, b: a + b) / F.size("_shares")), "f_heads_max": of(F.array_max("_shares"))}).drop("_shares")


def _holds_word(host: Column) -> Column:
    """Whether a host holds a listed word: short ones as a whole word, others anywhere."""
    short = "|".join(w for w in BLOCK_WORDS if len(w) < 4)
    long = "|".join(w for w in BLOCK_WORDS if len(w) >= 4)
    return host.rlike(f"(^|[^a-z])({short})([^a-z]|$)|{long}")


def generated_urls(spark: SparkSession, rows: int, seed: int = 11) -> DataFrame:
    """``url, label``: as many good as bad ones, their hosts made of the same shapes."""
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(n)).cast("int")
    pick = lambda salt, options: F.get(F.array(*[F.lit(o) for o in options]), h(salt, len(options)))
    bad = F.col("label") == 1
    chance = lambda salt, good, worse: h(salt, 100) < F.when(bad, worse).otherwise(good)
    syllables = F.concat(pick("y1", SYLLABLES), pick("y2", SYLLABLES), F.when(h("y3", 2) == 0, pick("y4", SYLLABLES)).otherwise(F.lit("")))
    plain = F.when(h("made", 2) == 0, syllables).otherwise(pick("p1", PLAIN_WORDS))
    first = F.when(bad, pick("b1", BLOCK_WORDS)).otherwise(plain)
    join = pick("j", ("-", "", "-", ""))
    digits = F.when(chance("dh", 5, 25), h("dn", 1000).cast("string")).otherwise(F.lit(""))
    other = pick("p2", PLAIN_WORDS)
    name = F.when(h("n", 3) == 0, first).when(h("n", 3) == 1, F.concat(first, join, other)).otherwise(F.concat(other, join, first))
    host = F.concat(pick("w", ("www.", "m.", "blog.", "", "")), name, digits, F.lit("."), pick("d", ("example.com", "example.net", "example.org", "com", "net", "org", "info", "edu")))
    path = F.concat(F.lit("/"), pick("l", ("en", "de", "fr", "es", "story", "item")), F.lit("/"), h("num", 50000).cast("string"), F.when(chance("deep", 10, 30), F.concat(F.lit("/"), pick("p3", PLAIN_WORDS), F.lit("/go"))).otherwise(F.lit("")))
    plainly = pick("e", ("", "", "/", "#top", ".html", "?page=2&ref=x", "?utm_source=feed"))
    opaque = F.concat(F.lit("?aff="), h("a", 10000).cast("string"), F.lit("&click="), F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(20)), F.lit("&sub=1"))
    made = spark.range(rows).withColumn("label", (F.col("id") % 2).cast("double"))
    return made.select(F.concat(pick("s", ("http://", "https://")), host, path, F.when(chance("q", 3, 30), opaque).otherwise(plainly)).alias("url"), "label")


def labelled_urls(pages: DataFrame, sample_rows: int = SAMPLE, made_rows: int = MADE, seed: int = 11) -> DataFrame:
    """``url, label`` (1: block): at most ``sample_rows`` of the table's and ``made_rows`` generated URLs."""
    host, _ = host_and_path(pages["url"].cast("string"))
    seen = pages.select(pages["url"].cast("string").alias("url"), _holds_word(host).cast("double").alias("label")).where("url IS NOT NULL")
    # Blocked hosts are rare: half the sample is kept for them.  Order by hash, so reruns agree.
    part = lambda y: seen.where(F.col("label") == y).orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(sample_rows // 2)
    return part(1.0).unionByName(part(0.0)).unionByName(generated_urls(pages.sparkSession, made_rows, seed))


def train(labelled: DataFrame, seed: int = 11):
    """The trees and the two share tables; without labelled URLs of both classes the model is None."""
    rows = lexical(labelled.select("url", "label").coalesce(2))
    suffix_key, head_keys = _keys(F.col("host"))
    rows = rows.withColumns({"suffix_key": suffix_key, "head_keys": head_keys, "_half": F.pmod(F.xxhash64("host", F.lit(seed)), F.lit(2))}).cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None, _share_tables(rows)
        halves = [_with_shares(rows.where(F.col("_half") == k), _share_tables(rows.where(F.col("_half") != k))) for k in (0, 1)]
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(halves[0].unionByName(halves[1])).select("features", "label")
        return GBTClassifier(maxIter=14, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=seed).fit(vectors), _share_tables(rows)
    finally:
        rows.unpersist()


def scored(urls: DataFrame, model, tables) -> DataFrame:
    """``urls`` (with ``url``) with host, path, features and ``blocked``, the trees' verdict."""
    rows = lexical(urls)
    suffix_key, head_keys = _keys(F.col("host"))
    rows = _with_shares(rows.withColumns({"suffix_key": suffix_key, "head_keys": head_keys}), tables)
    return rows.withColumn("blocked", margin(model, lambda i: F.col(FEATURES[i])) > 0 if model is not None else F.lit(False))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``."""
    model, tables = train(labelled if labelled is not None else labelled_urls(pages))
    rows = scored(pages.select("page_id", pages["url"].cast("string").alias("url")), model, tables)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
