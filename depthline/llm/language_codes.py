"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1.  Each bit is a binary classifier over character
n-grams: the log ratio of an n-gram's share in the languages marked +1 against its share in
those marked -1, averaged over a text's n-grams.  The shares come from counts over all training
rows, added up in Spark by (language, n-gram); one pass serves all bits.  A logistic curve a
bit and its error are fitted on a sample of at most ``SAMPLE`` training rows.  Decoding takes
the codeword with the least sum of logistic losses, each bit weighted by how far its error lies
under one half; where the two nearest codewords are close, the row is marked ambiguous.

Up to ``EXHAUSTIVE`` languages all splits of them are bits, beyond that random codewords far
apart.  The model holds ``2 ** BITS`` whole numbers a bit (weights are in units of 1 / ``UNIT``, so
sums do not depend on how rows are dealt); what the driver gathers grows with the number of
languages alone.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text where no row has both a letter and a language to learn from; of equally near languages the
first by name wins; with one language it is the answer for every text with a letter, with score
1; letters are compared in lower case and everything else separates words; texts are read whole,
however long; repeated rows each get their result; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, mix

ORDERS = (1, 2, 3)
BITS = 16
UNIT = 4096
SAMPLE = 4096
EXHAUSTIVE = 6
#: Rows whose best two languages differ by less in probability are ambiguous.
AMBIGUOUS = 0.2
#: Code points and n-grams that are looked at together.
SLICE, PIECE = 1 << 21, 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For every code point its lower case, 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def letters(texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of some texts with one 0 behind each word, and which text each belongs to."""
    raw = [("" if t is None else t).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0" for t in texts]
    codes = _letters()[np.frombuffer(b"".join(raw), np.uint32)]
    doc = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
    word = codes > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    return codes[keep], doc[keep]


def grams(texts):
    """Pieces ``(doc, bucket)`` of all n-grams of some texts, ``doc`` ascending; a word's n-grams reach into the next word."""
    c, doc = letters(texts)
    for lo in range(0, len(c), PIECE):
        for n in ORDERS:
            hi = min(lo + PIECE, len(c) - n + 1)
            if hi <= lo:
                continue
            h = np.zeros(hi - lo, np.uint64)
            for k in range(n):
                h = h * _MULTIPLIER + c[lo + k : hi + k] + np.uint64(1)
            same = doc[lo:hi] == doc[lo + n - 1 : hi + n - 1]
            yield doc[lo:hi][same], (mix(h[same] ^ np.uint64(n << 56)) >> np.uint64(64 - BITS)).astype(np.int64)


def slices(batch: pd.DataFrame):
    """A batch's rows in runs of at most ``SLICE`` code points (or one row)."""
    sizes = batch["text"].str.len().fillna(0).to_numpy(np.int64)
    run = (np.cumsum(sizes) // SLICE).tolist()
    lo = 0
    for hi in range(1, len(batch) + 1):
        if hi == len(batch) or run[hi] != run[lo]:
            yield batch.iloc[lo:hi]
            lo = hi


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows ``text, lang``."""

    def flushed(held):
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})
        held.clear()

    def run(batches):
        held: dict = {}
        for batch in batches:
            for part in slices(batch):
                langs, of = np.unique(part["lang"].to_numpy(str), return_inverse=True)
                n = np.zeros(len(langs) << BITS, np.int64)
                for doc, bucket in grams(part["text"]):
                    n += np.bincount((of[doc] << BITS) + bucket, minlength=len(n))
                for lang, got in zip(langs.tolist(), n.reshape(len(langs), -1)):
                    held[lang] = held[lang] + got if lang in held else got
                if len(held) > 64:
                    yield from flushed(held)
        yield from flushed(held)

    return rows.select("text", "lang").mapInPandas(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int, seed: int = 1) -> np.ndarray:
    """``[language, bit]`` of +1 and -1: all splits of few languages, else random ones of ``10 log2 k`` bits, the most distant of 64 draws."""
    if k <= EXHAUSTIVE:
        return np.array([[1 if row == 0 or not (bit >> (row - 1)) & 1 else -1 for bit in range(1, 2 ** (k - 1))] for row in range(k)], np.int64).reshape(k, -1)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], (k, math.ceil(10 * math.log2(k))))
        mixed = np.abs(code.sum(0)) < k
        nearest = ((code.shape[1] - code @ code.T) // 2 + np.eye(k, dtype=int) * code.shape[1]).min()
        if mixed.all() and nearest > far:
            best, far = code, nearest
    return best


def gram_weights(shares: np.ndarray, code: np.ndarray) -> np.ndarray:
    """``[bucket, bit]``: log ratio of the mean shares of the two sides, in whole units."""
    out = np.empty((shares.shape[1], code.shape[1]), np.int64)
    for b in range(code.shape[1]):
        out[:, b] = np.rint(UNIT * (np.log(shares[code[:, b] > 0].mean(0)) - np.log(shares[code[:, b] < 0].mean(0))))
    return out


@dataclass
class Codes:
    """Languages by name, their codewords, n-gram weights, and each bit's logistic curve and weight."""

    langs: list[str]
    code: np.ndarray
    grams: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    weight: np.ndarray

    def margins(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """``[text, bit]`` mean weights, and how many n-grams each text has."""
        total, n = np.zeros((len(texts), self.code.shape[1]), np.int64), np.zeros(len(texts), np.int64)
        for doc, bucket in grams(texts):
            if len(doc):
                first = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
                total[doc[first]] += np.add.reduceat(self.grams[bucket], first, axis=0)
                n += np.bincount(doc, minlength=len(texts))
        return total / (UNIT * np.maximum(n, 1))[:, None], n

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """``[text, language]`` by weighted logistic losses against every codeword."""
        z = self.slope * margins + self.shift
        loss = (self.weight * np.logaddexp(0, -self.code[None, :, :] * z[:, None, :])).sum(2) if len(z) else np.zeros((0, len(self.langs)))
        near = np.exp(loss.min(1, keepdims=True) - loss)
        return near / near.sum(1, keepdims=True)


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float, float]:
    """Slope, shift and error of a ridged logistic fit of ``y`` (+1, -1), sides weighing the same."""
    side = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([1.0, 0.0])
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (side * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (side * (p - (y > 0))) + ridge @ w)
        w = w - np.clip(step, -5, 5)
    wrong = float((side * (np.sign(a @ w) != y)).sum() / len(y)) if len(y) else 0.5
    return float(w[0]), float(w[1]), wrong


def train(rows: DataFrame) -> Codes | None:
    """Fit on rows ``doc_id, text, lang``; None where there is nothing to learn from."""
    counts = gram_counts(rows).toPandas()
    if not len(counts):
        return None
    langs = sorted(counts["lang"].unique().tolist())
    place = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((len(langs), 1 << BITS))
    n[counts["lang"].map(place).to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy(np.float64)
    total = n.sum(1, keepdims=True)
    shares = (n + 1e-6 * total + 0.05) / ((1 + 1e-6 * (1 << BITS)) * total + 0.05 * (1 << BITS))
    code = codewords(len(langs))
    flat = np.ones(code.shape[1])
    codes = Codes(langs, code, gram_weights(shares, code), flat, 0 * flat, flat)
    if code.shape[1]:
        known = rows.count()
        share = min(1.0, SAMPLE / max(known, 1))
        picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE)

        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    margins, seen = codes.margins(part["text"].tolist())
                    yield pd.DataFrame({"lang": part["lang"].to_numpy()[seen > 0], "x": list(margins[seen > 0])})

        got = picked.select("text", "lang").mapInPandas(run, "lang string, x array<double>").toPandas()
        if len(got):
            x, of = np.stack(got["x"].to_numpy()), got["lang"].map(place).to_numpy()
            fits = np.array([_curve(x[:, b], code[of, b]) for b in range(code.shape[1])])
            codes.slope, codes.shift = fits[:, 0], fits[:, 1]
            codes.weight = np.maximum(1 - 2 * fits[:, 2], 0.05)
    return codes


def predict(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for rows ``doc_id, text``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part["text"].tolist()
                lang, score, unsure = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if codes is not None:
                    margins, n = codes.margins(texts)
                    p = np.round(codes.probabilities(margins), 9)
                    some, best = n > 0, p.argmax(1)
                    lang[some] = np.array(codes.langs, object)[best[some]]
                    score[some] = p[np.arange(len(p)), best][some]
                    if p.shape[1] > 1:
                        two = np.sort(p, axis=1)[:, -2:]
                        unsure = some & (two[:, 1] - two[:, 0] < AMBIGUOUS)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": lang, "score": score, "ambiguous": unsure})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_ids(documents: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score, ambiguous``; rows held out are not learned from."""
    with Scratch(documents.sparkSession) as scratch:
        docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"), documents["lang"].cast("string").alias("lang"))
        codes = train(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
        found = predict(docs, codes)
        return scratch.result(found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"), "languages")
