import random
import re

import corpus_pipeline
from depthline.llm import mixing, order_minhash, quality_rules

RNG = random.Random(3)
WORDS = [f"w{i}x" for i in range(500)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, _row int"


def made_texts():
    base = [" ".join(RNG.choices(WORDS, k=90)) for _ in range(24)]
    near = [b.replace(b.split()[40], "edited", 1) for b in base[:8]]
    mails = [f"{' '.join(RNG.choices(WORDS, k=80))} write to a{i}.b@example.org now" for i in range(6)]
    return [*base, *near, *base[:5], *mails, None, "", "too short", "a b c " * 60, "#$% " * 90]


def table(spark, path, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", ("a", "b", None)[i % 3], len(t or ""), "u", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def brute_classes(texts):
    """Smallest index reachable through aligned similarity of 0.8 or more, for each text."""
    ks = [order_minhash.labelled_kmers([t])[0] for t in texts]
    root = list(range(len(texts)))
    while True:
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                if order_minhash.alignment_similarity(ks[i], ks[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            return root


def test_stages_in_a_row(spark, tmp_path):
    texts = made_texts()
    first = table(spark, f"file://{tmp_path}/in", texts)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_near_dedup", "pii", "mixing", "sentencepiece"]
    kept = {}
    docs = first
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == first.columns
    verdicts = {r["doc_id"] for r in quality_rules.quality_verdicts(first).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept["quality_rules"]} == verdicts == set(range(43))
    ids = sorted(verdicts)
    root = brute_classes([texts[i] for i in ids])
    assert sorted(r["doc_id"] for r in kept["minhash_near_dedup"]) == sorted({ids[r] for r in root})
    clean = {r["doc_id"]: r["text"] for r in kept["pii"]}
    for r in kept["minhash_near_dedup"]:
        assert clean[r["doc_id"]] == re.sub(r"a\d\.b@example\.org", "[EMAIL]", r["text"])
    sizes = {s: sum(len(r["text"].split()) for r in kept["pii"] if r["source"] == s) for s in ("a", "b", None)}
    for s, target in zip(sizes, mixing.water_fill(list(sizes.values()), [1, 2, 3], 3)):
        assert abs(sum(len(r["text"].split()) for r in kept["mixing"] if r["source"] == s) - target) <= 100
    assert all(r["round_trip"] for r in kept["sentencepiece"]) and len(kept["sentencepiece"]) == len(kept["mixing"])
    again = corpus_pipeline.run(spark, f"file://{tmp_path}/in").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept["sentencepiece"]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
