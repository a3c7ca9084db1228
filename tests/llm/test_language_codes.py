import random
import zlib

import numpy as np
import pytest

from depthline.llm import language_codes
from depthline.llm.common import mix
from depthline.llm.queries import op13_language_id

SCHEMA = "doc_id long, text string, lang string, source string, score double, bucket int, held_out string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["ßen", "öt", "ka", "ich"], "cc": ["что", "ка", "лом", "не"], "dd": ["lo", "eau", "ch", "que"], "ee": ["ña", "mi", "zo", "ru"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.5, 1, "x") for i, t, lang in rows], SCHEMA)


def plain_counts(text):
    """N-grams of one text by slicing strings."""
    kept, n = "", {}
    for c in (text or "") + " ":
        if c.isalpha():
            kept += c.lower()[0]
        elif kept and kept[-1] != "\0":
            kept += "\0"
    for order in language_codes.ORDERS:
        for i in range(len(kept) - order + 1):
            h = 0
            for c in kept[i : i + order]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
            bucket = int(mix(np.array([h ^ (order << 56)], np.uint64))[0]) >> (64 - language_codes.BITS)
            n[bucket] = n.get(bucket, 0) + 1
    return n


def test_counts_match_sliced_strings_for_any_slices(spark, monkeypatch):
    texts = ["Ab c", None, "", "  --  ", "İß ǅ x\nÉé", "a" * 50, "1a2b3", "日本 語"]
    for piece in (3, 7, 1 << 19):
        monkeypatch.setattr(language_codes, "PIECE", piece)
        got = [{} for _ in texts]
        for doc, bucket in language_codes.grams(texts):
            for d, b in zip(doc.tolist(), bucket.tolist()):
                got[d][b] = got[d].get(b, 0) + 1
        assert got == [plain_counts(t) for t in texts]
    rows = [(i, t, "x" if i % 2 else "y") for i, t in enumerate(texts)]
    want = {}
    for _, t, lang in rows:
        for b, k in plain_counts(t).items():
            want[lang, b] = want.get((lang, b), 0) + k
    assert {(r["lang"], r["bucket"]): r["n"] for r in language_codes.gram_counts(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("k", [1, 2, 3, 6, 7, 40, 200])
def test_codewords_are_apart(k):
    code = language_codes.codewords(k)
    assert set(np.unique(code)) <= {-1, 1} and len(code) == k
    if k > 1:
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        assert apart >= (2 ** (k - 2) if k <= language_codes.EXHAUSTIVE else 10)
        assert all(len(set(column)) == 2 for column in code.T.tolist())


def test_languages_with_nulls_short_long_and_unlearned_texts(spark):
    rng = random.Random(2)
    langs = sorted(SYLLABLES)
    rows = [(i, prose(langs[i % 5], rng.choice([2, 5, 40]), rng), langs[i % 5] if i % 11 else None) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? \n", "bb"), (1003, prose("cc", 60000, rng), "cc"), (None, prose("dd", 30, rng), None), (3, rows[3][1], rows[3][2])]
    got = language_codes.language_ids(frame(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score", "ambiguous"}
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "cc", "dd"] and by[1000]["score"] == 0.0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got if r["doc_id"] is not None)
    right = [by[i]["lang_pred"] == langs[i % 5] for i in range(400)]
    assert np.mean(right) > 0.97
    # Labels of rows held out, and other columns, change nothing.
    held = {i for i in range(400) if by[i]["held_out"]}
    again = language_codes.language_ids(frame(spark, [(i, t, "zz" if i in held else lang) for i, t, lang in rows]).repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in again) == sorted((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in got)


def test_a_text_between_two_languages_is_ambiguous_and_few_languages_work(spark):
    rng = random.Random(3)
    both = [(i, prose(lang, 30, rng), lang) for i, lang in enumerate(["aa", "cc"] * 60)]
    mixed = [(5000 + i, " ".join(prose(lang, 2, rng) for lang in ("aa", "cc") * 10), None) for i in range(5)]
    got = {r["doc_id"]: r for r in language_codes.language_ids(frame(spark, both + mixed)).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["ambiguous"] for i, _, lang in both)
    assert max(got[5000 + i]["score"] for i in range(5)) < min(got[i]["score"] for i, _, _ in both)
    one = {r["lang_pred"] for r in language_codes.language_ids(frame(spark, [(i, t, "aa") for i, t, _ in both[:20]])).collect()}
    assert one == {"aa"}
    assert [r["lang_pred"] for r in language_codes.language_ids(frame(spark, [(1, "some text", None)])).collect()] == ["und"]
    assert language_codes.language_ids(frame(spark, [])).collect() == []


def test_held_out_rows_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    got = [r for r in op13_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    right = np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in got])
    assert len(got) > 100 and right >= 0.97
