"""Quality rules as a short-circuit cascade (native expressions only).

Each rule is one SQL expression over the text that says "reject".  The order in
which the rules are tried comes from a sample: a rule's cost is the time it takes
there, its selectivity the share it rejects, and rules run by rejections per cost.
The order changes the work, never the verdict, as a document is rejected when any
rule rejects it.

A text is split into words once, and all rules stand in one condition in that order, so a
document's first rejection ends its evaluation, however long the text.

Defined results: a null text counts as empty, and an empty text has no words, so
``too_short`` rejects it; an empty table gives an empty table.  Repeated rows each get the
same verdict.  Of the input only ``doc_id`` and ``text`` are read, so other columns may
have any name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.llm.common import SPACE_PATTERN, Scratch, let, stored, text_of

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _shifted(x: Column, by: int) -> Column:
    return F.slice(x, by + 1, F.greatest(F.size(x), F.lit(1)))


def n_repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside ``width``-word windows that the text holds twice or more.

    Windows are hashed, sorted with their places, and equal neighbours give the
    covered places; the union of the windows is summed from the gaps between them.
    """
    def windows(h: Column) -> Column:
        out = h
        for k in range(1, width):
            out = F.zip_with(out, _shifted(h, k), lambda a, b: F.xxhash64(a, b))
        return F.slice(out, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))

    def places(s: Column) -> Column:
        nxt = _shifted(s, 1)
        first = F.zip_with(s, nxt, lambda a, b: F.when(a["h"] == b["h"], a["i"]))
        second = F.zip_with(s, nxt, lambda a, b: F.when(a["h"] == b["h"], b["i"]))
        both = F.array_union(F.filter(first, lambda x: x.isNotNull()), F.filter(second, lambda x: x.isNotNull()))
        return F.array_sort(both)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, _shifted(p, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    pairs = lambda t: F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda t: let(pairs(t), lambda s: let(places(s), covered))))


def upper_share(text: Column) -> Column:
    """Share of upper-case code points among those whose case can change."""
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return upper / F.greatest(F.length(F.regexp_replace(text, r"[^\p{Lu}\p{Ll}]+", "")), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """``reject(text, words)`` gives a boolean column: true rejects the document.

    ``measured`` may say the same with the statistics ``quality_verdicts`` reports.
    """

    name: str
    reject: object
    measured: object = None


def default_rules(min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 10, dup_line_pct: int = 50, min_len: float = 2.0, max_len: float = 12.0, upper: float = 0.45) -> list[Rule]:
    size = lambda w: F.size(w).cast("long")
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")
    return [
        Rule("too_short", lambda t, w: size(w) < min_words, lambda s: s["n_words"] < min_words),
        Rule("repeats", lambda t, w: n_repeat_words(w) * 100 > size(w) * repeat_pct, lambda s: s["n_repeat_words"] * 100 > s["n_words"] * repeat_pct),
        Rule("symbols", lambda t, w: n_symbols(t) * 100 > size(w) * symbol_pct, lambda s: s["n_symbols"] * 100 > s["n_words"] * symbol_pct),
        Rule("duplicate_lines", lambda t, w: n_dup_lines(t) * 100 > n_lines(t) * dup_line_pct, lambda s: s["n_dup_lines"] * 100 > n_lines(s["t"]) * dup_line_pct),
        Rule("word_length", lambda t, w: (chars(w) < size(w) * min_len) | (chars(w) > size(w) * max_len), lambda s: (s["word_chars"] < s["n_words"] * min_len) | (s["word_chars"] > s["n_words"] * max_len)),
        Rule("shouting", lambda t, w: upper_share(t) > upper),
    ]


def _rule_sample(docs: DataFrame, sample_rows: int) -> DataFrame | None:
    """Whole texts of ``sample_rows`` documents: those whose ``doc_id`` has the smallest hashes, wherever they lie.

    The bound on the hashes comes from a scan of ``doc_id`` alone.  None for an empty table.
    """
    place = F.xxhash64(docs["doc_id"].cast("string"))
    bound = docs.select(place.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if bound is None:
        return None
    return stored(docs.where(place <= bound).select(text_of(docs).alias("t")).limit(sample_rows), "rule-sample")


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 500) -> list[Rule]:
    """Rules by rejections per second on at most ``sample_rows`` documents.

    The sample is drawn by a hash of ``doc_id`` from the whole table and holds whole texts, so
    rules whose cost grows with length show it; it lies in a table, not on the driver.  A
    rule's time is the better of two runs over the sample, less that of a run that only
    splits.  The sample bounds the measuring only; verdicts come from every document.
    """
    with Scratch(docs.sparkSession):
        sample = _rule_sample(docs, sample_rows)
        return list(rules) if sample is None else _measured_order(sample, rules)


def _measured_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    def timed(reject) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            hits = sample.agg(F.sum(let(words_of(F.col("t")), lambda w: reject(F.col("t"), w)).cast("long"))).first()[0] or 0
            best = min(best, time.perf_counter() - began)
        return best, hits

    idle, _ = timed(lambda t, w: F.size(w) < 0)
    rate = {}
    for rule in rules:
        spent, hits = timed(rule.reject)
        rate[rule.name] = (hits + 1) / max(spent - idle, 1e-3)
    return sorted(rules, key=lambda r: -rate[r.name])


def _any(rules: list[Rule], text: Column, words: Column) -> Column:
    """Whether a rule rejects; a later rule is evaluated only where none before does."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(rule.reject(text, words), True).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    ordered = order_rules(docs, rules or default_rules(), sample_rows)
    text = text_of(docs)
    return docs.where(~let(words_of(text), lambda w: _any(ordered, text, w)))


def quality_verdicts(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500, min_words: int = 50, repeat_pct: int = 50) -> DataFrame:
    """Per document its statistics, ``base_failed`` and ``kept`` (one row per input row).

    The report states every statistic of every document, so rules that are said by them
    cost nothing more here; the others run in the cascade's order where none of those rejects.
    """
    ordered = order_rules(docs, rules or default_rules(min_words, repeat_pct), sample_rows)
    t, w = F.col("t"), F.col("w")
    split = docs.select("doc_id", text_of(docs).alias("t")).select("doc_id", "t", words_of(F.col("t")).alias("w"))
    stats = split.select(
        "doc_id",
        "t",
        "w",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_pct)
    held = {c: F.col(c) for c in stats.columns}
    rejected = _any([r for r in ordered if not r.measured], t, w)
    for rule in reversed([r for r in ordered if r.measured]):
        rejected = F.when(rule.measured(held), True).otherwise(rejected)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, False).otherwise(~rejected).alias("kept"))
