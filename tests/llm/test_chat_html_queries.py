from __future__ import annotations

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coldtrail.llm import chat, queries, simhash
from coldtrail.llm.html import extract_text, main_text
from compare import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    error, _, _ = compare(spark, duck(SMALL), name, queries.queries()[name], queries.oracle_sql()[name], SMALL)
    assert error is None, error


def turns(frame):
    return {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in frame.collect()}


def test_json_layouts(spark):
    records = {
        1: {"prompt": "p", "response": "r"}, 2: {"output": "o", "instruction": "i", "input": "x"}, 3: {"instruction": "i", "input": "", "output": None},
        4: {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]},
        5: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, 6: {"other": 1}, 7: {"question": "q", "answer": "a"}}
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(8, "not json"), (9, None), (10, "[]")]
    got = turns(chat.canonical_json(spark.createDataFrame(rows, "id bigint, j string"), "id", "j"))
    assert got[1] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert got[2] == ("instruction_input_output", [("user", "i\n\nx"), ("assistant", "o")])
    assert got[3] == ("instruction_input_output", [("user", "i"), ("assistant", "")])
    assert got[4] == ("messages", [("system", "s"), ("user", "u"), ("assistant", "a")])
    assert got[5] == ("conversations", [("user", "h"), ("assistant", "g")])
    assert got[7][0] == "question_answer" and all(got[k] == (None, []) for k in (6, 8, 9, 10))


def test_table_layouts(spark):
    table = spark.createDataFrame([(1, [("user", "a"), (None, None)]), (2, None)], "id bigint, messages array<struct<role:string,content:string>>")
    assert turns(chat.canonical_turns(table, "id")) == {1: ("messages", [("user", "a"), ("", "")]), 2: ("messages", [])}
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "id bigint, strange string"), "id")


TEXTS = ["", "plain", "\\", "<", "\\l", "</turn>\n", "<turn user>x</turn>\n", "a\\<b>\\g", "\\### Assistant: </turn> ok", "é\U0001F600\n\n", "\\s\\\\l", None]


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, "assistant" if i % 2 else role, t) for i, (role, t) in enumerate(zip(["user", "a>b", None, "</turn>\n", "\\g", "x"] * 2, TEXTS))] + [(None, None, None, None), (2, 5, "user", "z"), (2, 5, "user", "z")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    marked = chat.format_chats(chat.canonical_turns(frame, "conv_id"))
    got = {r["conv_id"]: r for r in chat.digests(marked, "conv_id").collect()}
    mine = [((r or ""), (t or "")) for c, _, r, t in rows if c == 1]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["n_turns"] == len(mine) and got[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in mine))
    learned = "".join(t for r, t in mine if r == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(learned), sha(learned))
    assert got[2]["n_turns"] == 2 and got[None]["turns_sha256"] == sha("\n\n")
    assert chat.digests(chat.format_chats(chat.canonical_turns(frame.limit(0), "conv_id")), "conv_id").count() == 0


LONG = "A sentence of the main text that goes on for quite a while, as they do. "


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<article><p>a &amp; b&nbsp;c<p>d</article>", "a & b c d"), ("<nav>menu</nav><article>x<script>var y='</p>'</script> z</article><footer>f</footer>", "x z"),
    ("<main><h1>T</h1><aside>no</aside><p>one\n two</p><form><p>no</p></form><ul><li>a<li>b</ul></main>", "T one two a b"),
    ("<article><p>body</p><section class='comments'><article class=comment><p>I agree</p></article></section></article>", "body"),
    ("<article><div class='cookie-notice'>no</div><p>yes</p><!-- <p>no</p> --><p hidden>no</p><p>end &am", "yes end &am"),
    (f"<div id=header>Site</div><div class=menu><a href=1>Home</a></div><h1>Head</h1><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p><div class=footer>{LONG * 4}</div>",
     f"Head {(LONG * 3).strip()} Short. {(LONG * 2).strip()}"),
    ("<style>p{}</style><!DOCTYPE html><title>t</title><body><table><tr><td>1<td>2</table>", "1 2"), ("<article>a < b and 3 > 2 <b>bold</b>ly</article>", "a < b and 3 > 2 boldly")])
def test_main_text(page, text):
    assert main_text(page) == text


def test_pages(spark):
    rows = [(1, "u", None), (None, None, "<article>x</article>"), (2, "v", "<p" * 1000), (3, "w", "<article>" + "<p>word</p>" * 20000), (3, "w", "<div>" * 3000)]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "page_id", "html", "url").collect()
    assert [r["n_chars"] for r in got] == [0, 1, 0, 5 * 20000 - 1, 0]


def test_pipeline_stages_take_effect(spark, documents):
    rows = documents.collect()
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == documents.columns
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[2] <= kept[1] <= kept[0] < {r["doc_id"] for r in rows}
    groups = simhash.simhash_groups(docs)
    assert groups.count() == groups.select("component_id").distinct().count()
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SMALL)
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, SMALL)
    assert mixed.columns == documents.columns and {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in mixed.collect()}
    assert corpus_pipeline.run(spark, SMALL).count() == pieces.count()


def test_catalogue():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and duckdb


def test_extra_columns_of_any_name_and_very_long_texts(spark):
    long = "</turn> " + "word \\n" * 50000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (2, None, None, None), (2, 0, "user", "")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = {c: F.lit("x") for c in ("layout", "turns", "_entries", "said", "prompt", "id")}
    for frame in (plain, plain.withColumns(extra)):
        got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.canonical_turns(frame, "conv_id")), "conv_id").collect()}
        assert got[1]["loss_chars"] == len(long) and got[1]["n_turns"] == 2 and got[2]["n_turns"] == 2
    nested = spark.createDataFrame([(7, [("user", "a", 1), ("assistant", "b", 2)], "z")], "id long, messages array<struct<role:string,content:string,name:int>>, other string")
    turns = chat.canonical_turns(nested, "id").first()
    assert turns["layout"] == "messages" and [tuple(t) for t in turns["turns"]] == [("user", "a"), ("assistant", "b")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "id long, other string"), "id")
