"""The line-block distribution against a slow version, and what it does without the markup's help."""

from __future__ import annotations

import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldtrail.llm import html

SMALL = "/root/testdata/sf0.001"


def slow_main_text(page):
    """Window by window, line by line."""
    lines, weights = html.page_lines(page)
    windows = [sum(weights[max(0, i - 2):i + 1]) for i in range(len(weights) + 2)]
    full = [w for w in windows if w]
    if not full:
        return ""
    spans, open_at = [], None
    for i, w in enumerate([*windows, 0]):
        if w and open_at is None:
            open_at = i
        if not w and open_at is not None:
            spans.append((open_at, min(i, len(weights)), max(windows[open_at:i])))
            open_at = None
    kept = [(a, b) for a, b, top in spans if top >= 0.5 * statistics.median(full)]
    most = max(sum(weights[a:b]) for a, b in kept)
    return " ".join(lines[i] for a, b in kept if sum(weights[a:b]) * 5 >= most for i in range(a, b) if weights[i])


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] or "" for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]


def random_page(rnd):
    parts = []
    for _ in range(rnd.randint(0, 25)):
        tag, words = rnd.choice(["p", "div", "li", "h2", "td", "nav", "footer"]), " ".join("word" for _ in range(rnd.choice([0, 1, 3, 20, 90])))
        parts.append(rnd.choice([f"<{tag}>{words}</{tag}>", f"<{tag} class='menu'>{words}</{tag}>", f"<{tag}><a href='x'>{words}</a></{tag}>", "<br>", words, "<script>x</script>", "<p"]))
    return "".join(parts)


def test_main_text_equals_the_slow_version(pages):
    rnd = random.Random(1)
    for page in [*pages, "", "<p>", "plain", *(random_page(rnd) for _ in range(400))]:
        assert html.main_text(page) == slow_main_text(page)


def overlap(found, wanted):
    both = sum(sum((Counter(a.split()) & Counter(b.split())).values()) for a, b in zip(found, wanted))
    return both / sum(len(a.split()) for a in found), both / sum(len(b.split()) for b in wanted)


def test_articles_are_found_without_article_tags_and_mostly_without_names(pages):
    marked = [" ".join(re.sub(r"<[^>]+>", " ", m).split()) for p in pages for m in re.findall(r"<article>(.*?)</article>", p, re.S)]
    assert len(marked) > len(pages) // 2
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p, flags=re.I) for p in pages]
    text = [html.main_text(p) for p in pages]
    assert [html.main_text(p) for p in plain] == text  # article tags decide nothing
    bare = [re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(nav|footer|aside|header|form|menu)\b", r"<\1div", p, flags=re.I), flags=re.I) for p in plain]
    precision, recall = overlap([html.main_text(p) for p in bare], text)
    assert precision > 0.9 and recall > 0.98


def test_stretches_of_weights():
    assert html.stretches(np.array([0, 0, 0], np.int64)) == [] and html.stretches(np.zeros(0, np.int64)) == []
    assert html.stretches(np.array([5, 0, 0, 0, 400, 300, 0, 200, 0, 0, 0, 6], np.int64)) == [(4, 10)]


def test_pages_of_odd_rows(spark):
    long = "<p>" + "many words here " * 60000 + "</p>"
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<p>some text of a page</p>"), (3, "u", long), (3, "u", long), (4, "u", "<nav>menu</nav>"), (5, "u", "&lt;b&gt; &amp;   caf&eacute;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["n_chars"], len(r["text"])) for r in html.extract_text(pages, "page_id", "html", "url").collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 0), (2, 0, 0), (None, 19, 19), (3, 959999, 959999), (3, 959999, 959999), (4, 0, 0), (5, 10, 10)], key=repr)
    assert html.extract_text(pages.where("false"), "page_id", "html", "url").collect() == []
    clash = pages.withColumns({"text": F.lit("mine"), "n_chars": F.lit(7), "_html": F.lit("x")})
    out = html.extract_text(clash, "page_id", "html", "text", "n_chars", "_html")
    assert out.columns == ["page_id", "text_", "n_chars_", "_html_", "text", "n_chars"] and {r["text_"] for r in out.collect()} == {"mine"}
