"""Operators over vectors, pages and conversations."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakfold.llm import ann, chat, html, queries


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[ids.index(i)]
        s = [(-(float(q @ v) / float(np.sqrt(q @ q) * np.sqrt(v @ v))), j) for j, v in zip(ids, x, strict=True) if j != i]
        out[i] = [j for _, j in sorted((round(a, 12), j) for a, j in s)[:k]]
    return out


def test_nearest_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    x[700:760] = x[0]
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in ann.nearest(df, params=ann.Params(leaf_rows=64, sample=600, block=100)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(list(range(1500)), list(x), range(0, 1500, 50), 5)
    assert set(got) == set(want)
    hits = sum(v in want[q] for q, ranks in got.items() for v, _ in ranks.values())
    assert hits / (5 * len(want)) >= 0.9
    for q, ranks in got.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        order = [(-s, v) for _, (v, s) in sorted(ranks.items())]
        assert order == sorted(order) and q not in {v for v, _ in ranks.values()}
    assert [got[0][n][0] for n in range(1, 6)] == [700, 701, 702, 703, 704]


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>"
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0]), (350, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(bad + good, schema)).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 1, 1), (0, 2, 350), (0, 3, 2), (350, 1, 2), (350, 2, 0), (350, 3, 1)] and abs(got[0][3] - 1) < 1e-12
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame(bad[:2], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    huge = [(0, [3e200, 4e200]), (1, [4e-200, 3e-200]), (2, [-1e308, 1e300]), (50, [5e-324, 5e-324]), (51, [0.3, 0.4])]
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 8 and abs(got[0, 1] - 0.96) < 1e-15 and abs(got[0, 51] - 1) < 1e-15 and abs(got[50, 1] - 7 / 50**0.5) < 1e-15 and abs(got[0, 2] + 0.6) < 1e-7


def test_nearest_of_a_lonely_query_has_all_its_rows(spark):
    """Tight clusters and few visits: an isolated query goes on until its leaves hold enough rows."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1, 8)) + 0.001 * rng.normal(size=(60, 8)) for _ in range(10)] + [100 * np.eye(8)[:2]])
    rows = [(i * 3 + 1, v.tolist()) for i, v in enumerate(x[:-2])] + [(5000, x[-2].tolist()), (5050, x[-1].tolist())]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), params=ann.Params(leaf_rows=8, sample=602, recall=0.5)).collect()
    n = Counter(r.query_id for r in out)
    assert n[5000] == n[5050] == 5 and set(n.values()) == {5}


def page(main, host="h.example", nav="Home About", foot="Copyright all rights reserved by us here now then"):
    return f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>{nav}</li></ul></nav><div class="ad">Buy now</div>{main}<footer>{foot}</footer></body></html>'


CASES = [
    ("<article><h1>A &amp; B</h1><p>x  y\n z<p>w</article>", "A & B\nx y z\nw"),
    ("<article><p>one</p><aside>no</aside><div class='comments'><p>reader</p></div><form>f</form><p>two</p></article>", "one\ntwo"),
    ("<nav><ul><li>open<article><p>in</p></article>", "in"),
    ("<main><header><h1>t</h1></header><p>a &lt; b</p></main>", "t\na < b"),
    ("<article><p>a < b and <b>bold</b>ed<style>p{}</style></p></article>", "a < b and bolded"),
    ("<article class='comment'><p>reader</p></article><article><p>real</p></article>", "real"),
    ("<article><p>caf&eacute; &#x41;&nbsp;b</p><!-- <p>no</p> --></article>", "café A b"),
    ("<article></article>", ""),
    ("<article><div class='ad'><div>x</div>y</div><p>kept</p></article>", "kept"),
]


def test_pages(spark):
    rows = [(n, f"https://h.example/{n}", page(main), n) for n, (main, _) in enumerate(CASES)]
    rows += [(100, None, None, 0), (101, "http://x", "", 0), (102, "http://x", "plain text only", 0), (102, "http://x", "plain text only", 0)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    for n, (_, want) in enumerate(CASES):
        assert got[n].text == want, n
        assert got[n].n_chars == len(want)
    assert (got[100].text, got[101].text, got[102].text) == ("", "", "plain text only")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_marks_lose_what_their_host_repeats(spark):
    r = random.Random(0)
    line = "this notice stands on each and every page of the whole site"
    own = [" ".join(r.choice("abcdefghij") * 3 for _ in range(20)) for _ in range(12)]
    rows = [(n, "http://one.example/", f"<body><div>{line}</div><p>{t}</p></body>") for n, t in enumerate(own)]
    rows += [(50, "http://two.example/", f"<body><div>{line}</div></body>")]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == dict(enumerate(own)) | {50: line}


def test_counted_runs_are_those_of_a_scan():
    r = random.Random(3)
    streams = [np.array([r.randrange(3) for _ in range(r.randrange(0, 40))], np.uint64) for _ in range(30)]
    hosts = [r.choice("abc") for _ in streams]
    for run in (1, 3, 5, 8):
        want: dict = {}
        for name, s in zip(hosts, streams, strict=True):
            one, two = html.run_hashes(s, run)
            for key in set(zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)):
                want[name, *key] = want.get((name, *key), 0) + 1
        # Counts of parts add up to those of the whole.
        for parts in ([30], [7, 11, 12], [1] * 30):
            got: dict = {}
            at = 0
            for n in parts:
                for name, one, two, k in zip(*html.run_counts(streams[at : at + n], hosts[at : at + n], run), strict=True):
                    got[name, one, two] = got.get((name, one, two), 0) + k
                at += n
            assert got == want
    assert html.run_counts([], [], 8)[0] == [] and html.run_counts([np.zeros(2, np.uint64)], ["x"], 8)[0] == []


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_short_and_empty_pages(spark, n):
    rows = [(k, "http://h/", "<p>Hello world</p>") for k in range(n)] + [(100 + k, "http://z/", None) for k in range(3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(k, "Hello world") for k in range(n)] + [(100 + k, "") for k in range(3)]


def test_texts_do_not_depend_on_partitions(spark):
    """Boilerplate of a large host, some of it on one page in a hundred only; whole copies keep their text."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    line = lambda k: " ".join(word() for _ in range(k))
    menu, rare, copied = line(12), line(12), line(30)
    rows, want = [], {}
    for k in range(401):
        own = line(25)
        rows.append((k, "http://big.example/", f"<div>{menu}</div><p>{own}</p>" + f"<div>{rare}</div>" * (k % 100 == 0)))
        want[k] = own
    for k in range(401, 405):
        rows.append((k, "http://big.example/", f"<div>{menu}</div><p>{copied}</p><!-- {k} -->"))
        want[k] = copied
    for parts in (1, 200):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {x.page_id: x.text for x in html.extract(df).collect()}
        assert got == want


def test_articles_lose_nothing_but_chrome(spark):
    word = "<p>first words here</p>"
    cases = [
        ("<main><div class='section-header'><h2>Title</h2></div><p>x</p></main>", "Title\nx"),
        ("<article><section class='related work'><p>others did so</p></section><p>x</p></article>", "others did so\nx"),
        ("<article><p>so <math><mi>a</mi></math> is</p></article>", "so a is"),
        *((f"<article>{word}<{e}>label<p>rest of it</p></article>", "first words here\nrest of it") for e in ("button", "select", "object", "svg")),
        ("<article><p>a <button>press</button> b</p></article>", "a b"),
        ("<article><p>x</p><section id='comments'><p>reader</p></section></article>", "x"),
    ]
    df = spark.createDataFrame([(k, f"http://h{k}/", f"<html><body>{x}</body></html>") for k, (x, _) in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == dict(enumerate(t for _, t in cases))


def test_repetition_decides_on_what_only_may_be_chrome(spark):
    r = random.Random(9)
    line = lambda k: " ".join("".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(k))
    notice = line(15)
    rows = [(k, "http://h/", f"<article><div class='page-header'>{notice}</div><p>{line(20)}</p></article>") for k in range(5)]
    rows.append((9, "http://h/", f"<article><div class='page-header'>{line(15)}</div><p>own</p></article>"))
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(notice not in got[k] and got[k] for k in range(5)) and got[9].count("\n") == 1


SCHEMAS = {"search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False}}


def call(i, name="search", **arguments):
    return json.dumps({"tool_call_id": i, "name": name, "arguments": arguments})


def test_chat(spark):
    rows = [
        (1, 0, "user", 'say "hi"\\ \n\x01é'),
        (1, 3, "assistant", call("c1", query='a "b"', limit=5)),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "r"})),
        (1, 4, "assistant", call("c2", limit="x", more=1)),
        (1, 5, "assistant", call("c3", name="nope")),
        (1, 6, "tool", json.dumps({"tool_call_id": "c9"})),
        (2, 0, None, None),
        (2, 1, "tool", json.dumps({"tool_call_id": "c1"})),
        (2, 2, "assistant", "{not json"),
        (None, 1, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    out = chat.format_chat(df, SCHEMAS).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert got[1, 0].message == '{"content":"say \\"hi\\"\\\\ \\n\\u0001é","role":"user"}'
    assert json.loads(got[1, 0].message)["content"] == rows[0][3]
    c = got[1, 3]
    assert (c.kind, c.linked, c.valid, c.errors) == ("call", True, True, "")
    assert c.message == '{"arguments":{"limit":5,"query":"a \\"b\\""},"name":"search","role":"assistant","tool_call_id":"c1"}'
    assert (got[1, 1].kind, got[1, 1].linked, got[1, 1].order_turn, got[1, 1].order_rank) == ("result", True, 3, 1)
    assert got[1, 4].errors == "missing query; bad limit; extra more" and not got[1, 4].linked
    assert got[1, 5].errors == "unknown tool nope"
    assert (got[1, 6].valid, got[1, 6].errors, got[1, 6].linked) == (False, "no call", False)
    assert (got[2, 0].role, got[2, 0].message) == ("unknown", '{"content":"","role":"unknown"}')
    assert got[2, 1].errors == "no call" and got[2, 2].kind == "text"
    order = [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_rank, r.turn))]
    assert order == [0, 3, 1, 4, 5, 6]
    assert chat.format_chat(df.where("false"), SCHEMAS).count() == 0
    assert chat.format_chat(df.unionByName(df), SCHEMAS).count() == 2 * len(rows)


    assert sorted(r.position for r in out if r.conv_id == 1) == list(range(6))
    assert [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)] == order


def test_chat_arguments_are_read_as_typed_values(spark):
    schemas = {"f": {"properties": {"limit": {"type": ["integer", "null"]}, "filter": {"type": "object", "properties": {"limit": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["limit"], "additionalProperties": False}}}}
    raw = [
        '{"query":"q","filter":{"limit":"x","tags":["a","b"]},"limit":5}',
        '{"z":{"b":1,"a":{"d":[{"y":1,"x":null}],"c":1.5}},"a":"\\u00e9/"}',
        '"not an object"',
        '{"filter":{"tags":["a",1],"more":{}},"limit":null}',
        '{"filter":{"limit":1},"limit":1.5}',
        "[1, 2]",
        None,
    ]
    texts = ['{"tool_call_id":%d,"name":"f"%s}' % (k, f',"arguments":{a}' if a else "") for k, a in enumerate(raw)]
    texts += ['{"tool_call_id":"c","tool_call_id":"d","name":"f"}', '{"tool_call_id":"c","name":"f"', '{"tool_call_id":{"a":1},"name":"f"}']
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)]
    got = {r.turn: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    args = lambda k: json.dumps(json.loads(got[k].message)["arguments"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for k, a in enumerate(raw):
        assert args(k) == (json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if a else "{}")
        assert got[k].message.startswith('{"arguments":' + args(k) + ',"name":"f"') and got[k].tool_call_id == str(k)
    assert [got[k].errors for k in range(7)] == ["", "", "bad arguments", "missing filter.limit; bad filter.tags[]; extra filter.more", "bad filter.limit; bad limit", "bad arguments", ""]
    assert [got[k].kind for k in (7, 8, 9)] == ["text"] * 3 and got[7].message == json.dumps({"content": texts[7], "role": "assistant"}, separators=(",", ":"))


def test_chat_links_one_identifier_of_many_rows(spark):
    """Repeated rows, ties and one identifier on most rows; the order is that of a sort."""
    r = random.Random(2)
    rows = [(1, r.randrange(600), "tool", json.dumps({"tool_call_id": "hot", "n": r.randrange(5)})) for _ in range(300)]
    rows += [(1, 400, "assistant", call("hot", query="q")), (1, 300, "assistant", call("hot", query="p")), (2, 5, "tool", json.dumps({"tool_call_id": "hot"}))]
    rows += [(1, k, "user", "x") for k in range(0, 600, 3)] * 2
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), SCHEMAS).collect()
    assert len(out) == len(rows) and all(x.linked == (x.kind != "text") for x in out if x.conv_id == 1)
    one = [x for x in out if x.conv_id == 1]
    assert sorted(x.position for x in one) == list(range(len(one)))
    at = sorted(one, key=lambda x: x.position)
    assert [(x.order_turn, x.order_rank, x.turn, x.message) for x in at] == sorted((300 if x.kind == "result" else x.turn, int(x.kind == "result"), x.turn, x.message) for x in one)


def test_chat_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chat(df.where(F.col("turn") > 0), SCHEMAS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "ShuffledHashJoin" in plan


def test_chat_plan_stays_small(spark):
    """The driver holds every plan and its strings: on check_h, after the other sizes, they took its memory."""
    q = queries.op7_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    plan = q.executedPlan().toString()
    assert len(q.optimizedPlan().treeString()) < 100_000
    assert plan.count("Scan parquet") <= 6
    assert "Exchange hashpartitioning(coalesce(" not in plan  # the join meets whole messages where the window left them


def test_chat_positions_are_those_of_a_sort_with_null_keys(spark):
    r = random.Random(9)
    rows = [(r.choice([None, 0, 1, -3]), r.choice([None, *range(-20, 40, 3)]), r.choice(["user", "tool", "assistant"]), r.choice(["x", "y", call(f"c{k % 9}", query="q"), json.dumps({"tool_call_id": f"c{k % 9}"})])) for k in range(500)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), SCHEMAS, span=4).collect()
    assert len(out) == len(rows)
    first = lambda x: (x is not None, x or 0)
    for conv in {x[0] for x in rows}:
        one = sorted((x for x in out if x.conv_id == conv), key=lambda x: x.position)
        assert [x.position for x in one] == list(range(sum(x[0] == conv for x in rows)))
        keys = [(first(x.order_turn), x.order_rank, first(x.turn), x.message) for x in one]
        assert keys == sorted(keys)


def test_json_string_escapes_what_json_does(spark):
    texts = [f"a{chr(k)}b" for k in range(160)] + ["".join(map(chr, range(130))), "", "\\u0001\n", "\u2028é😀"]
    got = [x.s for x in spark.createDataFrame([(x,) for x in texts], "t string").select(chat.json_string(F.col("t")).alias("s")).collect()]
    assert got == [json.dumps(x, ensure_ascii=False) for x in texts]
