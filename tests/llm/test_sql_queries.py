"""Queries that DuckDB can run too, on the smallest tables; and odd rows of these operators."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm import chat_format, common, decontaminate, line_dedup, warc_revisits
from assaykit.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, sf_dir, name):
    duck = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == cols
    key = lambda r: repr([r[c] for c in cols])
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(map(key, rows))


def test_ascii_lower_on_all_characters(spark):
    texts = ["".join(chr(c) for c in range(a, min(a + 512, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 512)]
    df = spark.createDataFrame([(t,) for t in texts] + [(t + "Abc",) for t in texts] + [(c,) for t in texts[:40] for c in t], "t string")
    for r in df.select("t", common.ascii_lower(F.col("t")).alias("low")).collect():
        assert r.low == re.sub("[A-Z]", lambda m: m[0].lower(), r.t)


LINE = "a line that is long enough to count"


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, f"{LINE}\nx\n{LINE.upper()}", 5), (4, f" {LINE}\t\n", 5), (5, LINE, 5), (5, LINE, 5), (None, f"y\n{LINE}", 5), (6, "short\nshort", 5)], "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id or 0), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, "y", 2, 1), (1, "", 1, 0), (2, "", 1, 0), (3, "x", 3, 2), (4, "", 2, 1), (5, LINE, 1, 0), (5, LINE, 1, 0), (6, "short\nshort", 2, 0)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_decontaminate_odd_rows(spark):
    words = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split()
    docs = spark.createDataFrame([(1, None, 0), (1, "...", 0), (2, " ".join(words), 0), (2, " ".join(words), 0), (3, " ".join(words[:9]), 0), (None, "x " + "--".join(words[1:11]).lower() + " solo y", 0), (4, "Solo! solo; q r", 0)], "doc_id long, text string, items int")
    items = spark.createDataFrame([(10, " ".join(words)), (9, "solo"), (8, None), (7, "q R"), (None, "y")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [(0, 13, 11, ["10", "9"]), (1, 0, 0, []), (1, 0, 0, []), (2, 12, 12, ["10"]), (2, 12, 12, ["10"]), (3, 9, 0, []), (4, 4, 4, ["7", "9"])]
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    small = decontaminate.decontaminate(docs, items, broadcast_rows=0)  # the shuffled way
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in small.collect()) == got


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_start|>", "<", "<|", "|>", "", "a\nb", "<|im_end|>\n", "é<|😀"]


def test_chat_round_trip(spark):
    turns = [[("user", t), (f"ro{t}le", t), ("assistant", t + "<"), ("assistant", "|" + t)] for t in NASTY] + [[], None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(turns)], "n int, turns array<struct<role:string,text:string>>")
    done = chat_format.format_turns(df)
    got = done.select("n", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()
    for r in got:
        want = turns[r.n] or []
        assert [(x.role, x.text) for x in r.t] == want
        assert r.m == "".join(t for role, t in want if role == "assistant")


def test_layouts_select_mappings(spark):
    raw = [
        '{"messages": [{"role": "user", "content": "hi"}, {"content": null, "role": "assistant"}]}', '{"messages": []}', '{"prompt": "p", "completion": "c"}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"instruction": "i", "input": "", "output": "o"}', '{"system": "s", "instruction": "i", "input": "x", "output": "o"}', '{"other": 1}', None,
    ]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(raw)], "n int, j string").select("n", F.parse_json("j").alias("record"))
    got = {r.n: (r["mapping"], None if r.turns is None else [(t.role, t.text) for t in r.turns]) for r in chat_format.to_turns(df).collect()}
    assert got[0] == ("messages", [("user", "hi"), ("assistant", "")]) and got[1] == ("messages", [])
    assert got[2] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[3] == ("conversations", [("user", "h"), ("assistant", "g")])
    assert got[4] == ("instruction_input", [("user", "i"), ("assistant", "o")])
    assert got[5] == ("instruction_system", [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")])
    assert got[6] == got[7] == (None, None)
    assert chat_format.fingerprint_census(df).count() == 8


def test_layouts_with_other_fields_and_parts(spark):
    raw = [
        '{"id": 7, "messages": [{"role": "user", "name": "ann", "content": [{"type": "text", "text": "a"}, "b"]}, {"role": "assistant", "content": "ok", "tool_calls": null}]}',
        '{"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}]}]}', '{"messages": [{"role": "user", "content": {"x": 1}}]}',
        '{"conversations": [{"from": "human", "value": "h", "w": 1}, {"from": "gpt"}], "source": "s"}', '{"id": "x", "prompt": "p", "response": null}', '{"prompt": "p", "completion": "c", "answer": "z"}',
        '{"meta": {"system": "no"}, "system": "", "instruction": ["i", "j"], "input": "x", "output": 5}', '[1]', '"text"', 'null',
    ]
    df = spark.createDataFrame([(n, x, "t", 1) for n, x in enumerate(raw)], "n int, j string, turns string, mapping int").withColumn("record", F.parse_json("j"))
    got = {r.n: (r["mapping"], None if r.turns is None else [(t.role, t.text) for t in r.turns]) for r in chat_format.to_turns(df).collect()}
    assert got == {
        0: ("messages", [("user", "a\nb"), ("assistant", "ok")]), 1: (None, None), 2: (None, None), 3: ("conversations", [("user", "h"), ("assistant", "")]),
        4: ("prompt_response", [("user", "p"), ("assistant", "")]), 5: (None, None), 6: ("instruction_system", [("user", "i\nj\n\nx"), ("assistant", "5")]), 7: (None, None), 8: (None, None), 9: (None, None),
    }


def test_turns_without_a_conversation_and_empty_tables(spark):
    schema = "conv_id long, turn int, role string, text string, fingerprint string"
    rows = spark.createDataFrame([(None, 1, "assistant", None, "f"), (None, 0, None, "q", "f"), (1, None, "user", "x", None)], schema)
    for given, want in ((rows, {None: [("", "q"), ("assistant", "")], 1: [("user", "x")]}), (rows.limit(0), {})):
        done = chat_format.format_turns(chat_format.to_turns(chat_format.gather_turns(given)))
        assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()} == want


def test_revisit_outcomes(spark):
    rows = [
        (1, "http://A.com/x?b=2&a=1", 10, 200, {"ETag": '"1"', "X": "old", "Date": "d1"}), (2, "https://www.a.com/x/?a=1&b=2&utm_source=q#f", 20, 304, {"etag": 'W/"1"', "date": "d2", "x": "no"}),
        (3, "a.com/x?a=1&b=2", 10, 304, {"etag": '"1"'}), (4, "a.com/x?a=1&b=2", 30, 304, {"ETAG": '"2"'}), (5, "a.com/x?a=1&b=2", 40, 304, None), (6, None, 40, 304, None), (7, "a.com/x", None, 304, {}),
        (8, "a.com/y", 5, 200, {"Last-Modified": "m"}), (9, "a.com/y", 5, 200, {"Last-Modified": "n"}), (10, "a.com/y", 6, 304, {"last-modified": "n"}), (11, "a.com/y", 7, 304, {"last-modified": "m"}), (12, "a.com/y", 8, 500, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured_at long, status int, headers map<string,string>")
    for slices in (1, 4):
        got = {r.record_id: r for r in warc_revisits.resolve_revisits(df, slices=slices).collect()}
        assert {k: (r.outcome, r.resolved_id) for k, r in got.items()} == {
            2: ("resolved", 1), 3: ("no_earlier_response", None), 4: ("etag_mismatch", None), 5: ("no_validator", None), 6: ("no_earlier_response", None), 7: ("no_earlier_response", None), 10: ("resolved", 9), 11: ("last_modified_mismatch", None),
        }
        assert got[2].headers == {"etag": 'W/"1"', "x": "old", "date": "d2"}
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0


def test_decontaminate_items_without_id(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"before {passage} after"), (2, "clean"), (3, f"solo {passage}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, passage), (None, "two three"), (9, "solo")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL["op9_decontaminate"])
    got = QUERIES["op9_decontaminate"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    left = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert [r.doc_id for r in left] == [2]


def test_repeated_records_and_long_chains(spark):
    """A repeated response gives its body once; thousands of captures of one URL each find the one just before."""
    tag = lambda n: {"ETag": f'"{n}"'}
    rows = [(1, "http://a/x", 10, 200, tag(1), "body", 5)] * 2 + [(2, "http://a/x", 20, 304, tag(1), None, 5)] * 2 + [(3, "http://a/x", 30, 304, None, None, 5)]
    for n in range(3000):
        rows += [(10_000 + 2 * n, "http://hot/", 100 * n, 200, tag(n), f"b{n}", 5), (10_001 + 2 * n, "http://hot/", 100 * n + 50, 304, tag(n if n % 3 else -1), None, 5)]
    df = spark.createDataFrame(rows, "record_id long, url string, captured_at long, status int, headers map<string,string>, body string, slice int").repartition(4)
    got = warc_revisits.resolve_revisits(df, payload="body").collect()
    assert sorted((r.record_id, r.outcome, r.payload) for r in got if r.record_id < 10_000) == [(2, "resolved", "body"), (2, "resolved", "body"), (3, "no_validator", None)]
    chain = {r.record_id: (r.outcome, r.resolved_id, r.payload) for r in got if r.record_id >= 10_000}
    assert chain == {10_001 + 2 * n: ("resolved", 10_000 + 2 * n, f"b{n}") if n % 3 else ("etag_mismatch", None, None) for n in range(3000)}
