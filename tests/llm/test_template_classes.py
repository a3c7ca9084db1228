import random
import time

import pytest

from depthline.llm import template_text

SCHEMA = "page_id long, url string, html string"
WORDS = [f"w{i}x" for i in range(500)]


def texts_of(spark, pages, host="one.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in template_text.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 12])
def test_constant_text_in_the_article_stays_whatever_the_number_of_pages(spark, n):
    rng = random.Random(n)
    for outer in ("article", "div"):
        bodies = [" ".join(rng.choices(WORDS, k=60)) for _ in range(n)]
        pages = [f"<html><body><{outer}><h1>Daily market report</h1><p>By our staff.</p><p>{b}</p></{outer}></body></html>" for b in bodies]
        assert texts_of(spark, pages) == {i: f"Daily market report By our staff. {b}" for i, b in enumerate(bodies)}


def test_classes_nest_and_repeated_items_fill_one_slot(spark):
    rng = random.Random(1)
    pages, want, tags = [], {}, {}
    for i in range(9):
        items = [(f"head {i} {k}", " ".join(rng.choices(WORDS, k=30))) for k in range(2 + i % 4)]
        made = "".join(f"<li class=item><b>{h}</b><div class=sum>{t}</div></li>" for h, t in items)
        pages.append(f"<html><body><div class=z1><a href=1>x</a></div><div class=z2><p>Fixed words of the house</p></div><ul class=z3>{made}</ul><div class=z4>Fixed end</div></body></html>")
        want[i] = " ".join(f"{h} {t}" for h, t in items)
        for path, (n, at) in template_text.page_tokens(pages[-1])[0].items():
            tags.setdefault(path, []).append((n, at))
    assert texts_of(spark, pages) == want
    # The same template made by comparing whole vectors.
    held = [template_text.Tag(p, tuple(n for n, _ in v), len(v), sum(n for n, _ in v), sum(a for _, a in v) / len(v)) for p, v in tags.items() if len(v) == len(pages)]
    classes = template_text.Template(held).classes()
    up = "/html/body/ul.z3"
    assert classes["/html"][0] is None and {"/html/body", "/html/body/ul.z3", "/html/body/div.z4"} <= set(classes["/html"][1])
    assert classes[f"{up}/li.item"] == (up, [f"{up}/li.item", f"{up}/b", f"{up}/div.sum"])


def test_random_templates_by_brute_force(spark):
    # Slots are known from how the pages are made: title and paragraphs in one container among constant ones.
    for seed in range(6):
        rng = random.Random(seed)
        fixed = [" ".join(rng.choices(WORDS, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 4))]
        deep = rng.randint(0, 3)
        n = rng.choice([5, 8, 20])
        pages, want = [], {}
        for i in range(n):
            title, paragraphs = f"Title {seed} {i}", [" ".join(rng.choices(WORDS, k=rng.randint(20, 50))) for _ in range(rng.randint(1, 5))]
            slot = f"<div class=q><h1>{title}</h1><div class=qq>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div></div>"
            for k in range(deep):
                slot = f"<div class=r{k}>{slot}</div>"
            pages.append("<html><body>" + "".join(f"<div class=s{k}>{f}</div>" for k, f in enumerate(fixed)) + slot + f"<div class=t>{fixed[0]}</div></body></html>")
            want[i] = " ".join([title, *paragraphs])
        assert texts_of(spark, pages, f"h{seed}.example") == want


def test_article_renamed_to_div_changes_no_text_of_the_tables(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    named = [template_text.extract(p, None) for p in pages]
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    renamed = table.selectExpr("page_id", "url", "replace(replace(html, '<article', '<div'), '</article', '</div') AS html")
    a = {r["page_id"]: r["text"] for r in template_text.main_texts(table).collect()}
    assert a == {r["page_id"]: r["text"] for r in template_text.main_texts(renamed).collect()} and all(named)


@pytest.mark.parametrize("piece", ['<a "x" ', "<a '", '<a "x\' >', "</nav>", "<", "<!-- ", "<a x=\"", "<p>text", "&amp;<![CDATA[", "<a b='c=\""])
def test_hostile_pages_take_time_in_proportion(piece):
    page = "<html><body><article>kept " + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    assert template_text.extract(page, None).startswith("kept")
    assert time.perf_counter() - began < 4


def test_deep_pages_and_tags_that_never_close():
    deep = "<div class=a>" * 60_000 + "words" + "</nav>" * 60_000 + "</div>" * 60_000
    began = time.perf_counter()
    assert template_text.extract(f"<body>{deep}tail", None) == "words tail"
    template_text.page_tokens(deep)
    assert time.perf_counter() - began < 8
    assert template_text.extract("<body><p>a < b <3 c</p><p title=\"it's\">d<p title='x>e</p>f<b", None) == "a < b <3 c d e f"
