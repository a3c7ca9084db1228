"""Personal data by candidate gradient boosting (native expressions and Spark ML only).

High-recall generators propose spans.  Four base kinds (email, ip, card, phone) are
decided by their format alone and always stay.  Further generators (secrets, local
phone numbers, national ids, bank accounts, spelled-out addresses) propose spans
that boosted trees score from format and context features; a threshold calibrated
for precision on held-out labelled spans selects which of them are redacted.  The
labelled spans are ``TRAIN_ROWS`` generated ones, so training costs the same at any
size of the corpus.

Generators are possessive patterns, linear in the text, and find the same leftmost
spans as the plain forms.  Everything happens in the row: the gaps before matches become
offsets by running sums, the fitted trees are one SQL expression over a candidate's
features, and overlaps are settled with running maxima, so no document is shuffled,
numbered or joined.  Running values are taken in blocks of about the square root of the
number of candidates, as arrays cannot be appended to cheaply.

Defined results: a null text counts as empty and has no spans (``redact`` leaves it null);
repeated rows each get their own result; an empty table gives an empty table; of the input
only ``doc_id`` and ``text`` are read (``redact`` passes all columns through, whatever
their names).  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.llm.common import let, text_of
from depthline.llm.trees import margin

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "phone_local", "national_id", "bank_account", "email_spelled")

#: kind -> (pattern, characters of which a text must hold one for the pattern to be tried)
GENERATORS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", "digit"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "secret": (r"(?i:password|passwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[\x22']?[A-Za-z0-9_+/-]{8,}+", "="),
    "phone_local": (r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "digit"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digit"),
    "bank_account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![a-z])", "digit"),
    "email_spelled": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9-]{2,64}+[\x20]?[\[(]dot[\])][\x20]?[A-Za-z]{2,10}+", "at"),
}

CUES = {
    "cue_phone": r"(?i)(tel|phone|call|fax|mobile|fon|llama|appel)",
    "cue_id": r"(?i)(ssn|social|passport|identity|ausweis|dni)",
    "cue_bank": r"(?i)(iban|account|konto|bank|compte|cuenta)",
    "cue_mail": r"(?i)(mail|contact|write|kontakt|escrib)",
    "cue_number": r"(?i)(order|part|item|version|page|isbn|serial|no\.|ref)",
}
FEATURES = ["f_len", "f_digits", "f_upper", "f_lower", "f_seps", "f_distinct", "f_left_word", "f_right_word", *[f"f_{c}" for c in CUES], *[f"f_{k}" for k in EXTRA]]
TRAIN_ROWS = 4000


def _has(text: Column, need: str) -> Column:
    return {"digit": text.rlike("[0-9]"), "at": F.lower(text).contains("at"), "=": text.contains("=") | text.contains(":")}.get(need, text.contains(need))


def running(values: Column, zero: Column, merge) -> Column:
    """For each place of an array the merge of all values before it (``zero`` for the first).

    In blocks of about the square root of the length: merges of whole blocks, merges of the
    blocks before each, and inside a block of the values before a place.
    """
    def blocks(v: Column, width: Column) -> Column:
        fold = lambda x: F.aggregate(x, zero, merge)
        count = F.ceil(F.size(v) / width).cast("int")
        whole = F.transform(F.sequence(F.lit(0), count - 1), lambda b: fold(F.slice(v, b * width + 1, width)))
        tops = let(whole, lambda w: F.transform(w, lambda x, b: F.when(b == 0, zero).otherwise(fold(F.slice(w, 1, F.greatest(b, F.lit(1)))))))

        def place(base: Column, b: Column) -> Column:
            part = F.slice(v, b * width + 1, width)
            return let(part, lambda p: F.transform(p, lambda x, i: F.when(i == 0, base).otherwise(F.aggregate(F.slice(p, 1, F.greatest(i, F.lit(1))), base, merge))))

        return F.flatten(let(tops, lambda t: F.transform(t, place)))

    return F.when(F.size(values) == 0, F.transform(values, lambda x: zero)).otherwise(let(values, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: blocks(v, w))))


def _found(text: Column) -> Column:
    """Array of (kind, start, end, left, span, right) of the matches of all generators."""
    plus = lambda a, b: a + b

    def matched(kind: str) -> Column:
        pattern, need = GENERATORS[kind]
        return F.when(_has(text, need), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, F.struct(F.lit(kind).alias("kind"), m.alias("matches"), F.split(text, pattern, -1).alias("pieces")))))

    def placed(g: Column) -> Column:
        at = lambda i: F.get(g["pieces"], i)
        steps = F.transform(g["matches"], lambda m, i: F.length(at(i)) + F.length(m))
        return let(running(steps, F.lit(0), plus), lambda before: F.transform(g["matches"], lambda m, i: let(F.get(before, i) + F.length(at(i)), lambda start: F.struct(g["kind"].alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.right(at(i), F.lit(24)).alias("left"), m.alias("span"), F.left(at(i + 1), F.lit(8)).alias("right")))))

    return F.flatten(F.transform(F.filter(F.array(*[matched(k) for k in GENERATORS]), lambda g: g.isNotNull()), placed))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, span: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]+", "")
    n = F.length(digits)
    octets = F.forall(F.split(span, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda s: (F.length(s) <= 3) & (F.when(F.length(s) <= 3, s).cast("int") <= 255)))
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(F.lit(True))
    )


def _features(c) -> list[Column]:
    """Format and context features of a candidate (a struct column or a row's columns), in the order of ``FEATURES``."""
    s, left, right = c["span"], c["left"], c["right"]
    count = lambda p: F.length(F.regexp_replace(s, f"[^{p}]+", "")).cast("double")
    length = F.greatest(F.length(s), F.lit(1))
    shape = [
        F.length(s).cast("double"),
        count("0-9") / length,
        count("A-Z") / length,
        count("a-z") / length,
        count(r"\x20().-"),
        F.size(F.array_distinct(F.split(s, ""))).cast("double"),
        left.rlike("[A-Za-z0-9]$").cast("double"),
        right.rlike("^[A-Za-z0-9]").cast("double"),
    ]
    return shape + [F.concat(left, F.lit(" "), s).rlike(p).cast("double") for p in CUES.values()] + [(c["kind"] == k).cast("double") for k in EXTRA]


def labelled_spans(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """Generated candidates with their label: real formats with fitting context, and look-alikes."""
    d = lambda k, salt: F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(10**k)).cast("string"), k, "0")
    pick = lambda salt, *options: F.get(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(options))).cast("int"))
    token = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24)
    words = pick("w", "changeme", "returns_nothing", "undefined", "required_field", "separator")
    good = {
        "secret": (pick("c", "", "the key ", "uses "), F.concat(pick("p", "password=", "token = \"", "api_key: ", "secret="), token)),
        "phone_local": (pick("c", "call me ", "tel. ", "phone: ", "fax "), F.concat(d(3, "a"), pick("s", "-", " ", "."), d(3, "b"), pick("s", "-", " ", "."), d(4, "e"))),
        "national_id": (pick("c", "ssn ", "social security ", "passport/ID ssn: "), F.concat(d(3, "a"), F.lit("-"), d(2, "b"), F.lit("-"), d(4, "e"))),
        "bank_account": (pick("c", "iban ", "account: ", "konto "), F.concat(pick("p", "DE", "FR", "ES", "GB"), d(2, "a"), d(9, "b"), d(9, "e"))),
        "email_spelled": (pick("c", "mail ", "contact ", "write to ", "", "by "), F.concat(F.substring(token, 1, 6), pick("s", " [at] ", "(at)"), F.lit("mail"), pick("s", " [dot] ", "(dot)"), F.lit("com"))),
    }
    bad = {
        "secret": (pick("c", "the ", "a ", "lost his "), F.concat(pick("p", "password: ", "token = ", "secret: "), words)),
        "phone_local": (pick("c", "order ", "part ", "the ", "of ", "serial no. "), good["phone_local"][1]),
        "national_id": (pick("c", "item ", "order ", "version ", "the ", "of "), good["national_id"][1]),
        "bank_account": (pick("c", "part ", "serial ", "ref ", "the ", "of "), F.concat(pick("p", "AB", "QX", "ZZ", "MM"), d(2, "a"), d(9, "b"), d(9, "e"))),
        "email_spelled": (pick("c", "section ", "page ", "item "), F.concat(F.lit("12"), F.lit(" (at) "), F.lit("34"), F.lit(" (dot) "), F.lit("x"))),
    }
    made = []
    for i, kind in enumerate(EXTRA):
        for label, (left, span) in ((1.0, good[kind]), (0.0, bad[kind])):
            ids = spark.range(rows // (2 * len(EXTRA))).select((F.col("id") * 100 + 10 * i + int(label)).alias("id"))
            made.append(ids.select("id", F.lit(kind).alias("kind"), left.alias("left"), span.alias("span"), pick("r", " ", ".", ", ", " and").alias("right"), F.lit(label).alias("label")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


@lru_cache(maxsize=4)
def _model(spark: SparkSession, precision: float, seed: int):
    """The boosted trees and their threshold: the lowest score whose held-out precision reaches ``precision``."""
    made = labelled_spans(spark)
    named = made.select("id", "label", *[f.alias(n) for f, n in zip(_features({c: F.col(c) for c in ("kind", "span", "left", "right")}), FEATURES)])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(named).select("id", "features", "label").coalesce(2)
    held = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) == 0
    model = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=seed).fit(rows.where(~held))
    scored = model.transform(rows.where(held)).select(vector_to_array("probability")[1].alias("p"), "label").collect()
    scored.sort(key=lambda r: -r["p"])
    threshold, hits = 1.0, 0
    for i, r in enumerate(scored):
        hits += r["label"] == 1.0
        last = i + 1 == len(scored) or scored[i + 1]["p"] < r["p"]
        if last and hits / (i + 1) >= precision:
            threshold = r["p"]
    return model, threshold


def spans_of(spark: SparkSession, text: Column, precision: float = 0.98, seed: int = 5) -> Column:
    """The selected spans of a text: structs ``start, end, kind`` by start, base spans first among equals."""
    model, threshold = _model(spark, precision, seed)
    # The model's probability is the logistic function of twice the trees' margin.
    least = 0.5 * math.log(threshold / (1 - threshold)) if threshold < 1 else math.inf
    valid = lambda all_: F.filter(all_, lambda c: F.coalesce(_valid(c["kind"], c["span"]), F.lit(False)))

    def rated(c: Column) -> Column:
        base = c["kind"].isin(*BASE)
        chosen = base | let(F.array(*_features(c)), lambda x: margin(model, lambda i: F.get(x, F.lit(i))) >= F.lit(least) - 1e-12)
        # Sorted by start, the longer first.
        return F.struct(c["start"].alias("start"), (-c["end"]).alias("stop"), c["kind"].alias("kind"), base.alias("base"), chosen.alias("chosen"))

    def settled(r: Column) -> Column:
        """A proposal gives way to base spans and to chosen ones that begin earlier."""
        ends = F.transform(r, lambda x: F.when(x["chosen"], -x["stop"]).otherwise(F.lit(0)))
        past = running(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        starts = F.transform(F.reverse(r), lambda x: F.when(x["base"], x["start"]).otherwise(F.lit(2**31 - 1)))
        ahead = F.reverse(running(starts, F.lit(2**31 - 1), lambda a, b: F.least(a, b)))
        kept = let(past, lambda p: let(ahead, lambda q: F.transform(r, lambda x, i: F.struct((x["base"] | (x["chosen"] & (F.get(p, i) <= x["start"]) & (F.get(q, i) >= -x["stop"]))).alias("use"), x["start"].alias("start"), (-x["stop"]).alias("end"), x["kind"].alias("kind")))))
        return F.transform(F.filter(kept, lambda x: x["use"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    return let(_found(text), lambda f: let(valid(f), lambda v: F.when(F.size(v) == 0, F.array().cast("array<struct<start:int,end:int,kind:string>>")).otherwise(let(F.array_sort(F.transform(v, rated)), settled))))


def pii_spans(docs: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, spans``: the array of its selected spans (``start, end, kind``)."""
    return docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("t")).select("doc_id", spans_of(docs.sparkSession, F.col("t"), **options).alias("spans"))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    of = lambda k: F.transform(F.array_sort(F.filter(spans, lambda x: x["kind"] == k)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return lambda kinds: F.array_join(F.flatten(F.array(*[of(k) for k in kinds])), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """Per document the numbers of base spans, the digest of the base spans and all spans."""
    s = F.col("spans")
    of = lambda k: F.filter(s, lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return pii_spans(docs, **options).select("doc_id", *counts, F.sha2(_joined(s)(BASE), 256).alias("base_sha256"), _joined(s)(BASE + EXTRA).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every selected span replaced by its kind in brackets; ``n_chars`` follows where there is one.

    Overlapping spans are replaced as one, named by the one that begins first, the longest
    one of those: a span counts as covered when it begins before the furthest end so far.
    """
    columns = docs.columns
    body = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), docs["text"].cast("string").alias("_t"))
    body = body.withColumn("_s", spans_of(docs.sparkSession, F.coalesce("_t", F.lit("")), **options))
    text = F.col("_t")

    def rebuilt(s: Column) -> Column:
        ordered = F.array_sort(F.transform(s, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("stop"), x["kind"].alias("kind"))))

        def joined(o: Column) -> Column:
            reach = running(F.transform(o, lambda x: -x["stop"]), F.lit(0), lambda a, b: F.greatest(a, b))
            parts = F.zip_with(o, reach, lambda x, e: F.when(x["start"] >= e, F.concat(F.substring(text, e + 1, x["start"] - e), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")))
            last = F.array_max(F.transform(o, lambda x: -x["stop"]))
            return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

        return let(ordered, joined)

    out = body.select("_row", F.when(F.size("_s") == 0, text).otherwise(rebuilt(F.col("_s"))).alias("_new"))
    return out.select(*[F.col("_new").alias(c) if c == "text" else F.coalesce(F.length("_new"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in columns])
