import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabsmith.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens int"


def convs(spark):
    words = lambda n, w="w": " ".join([w] * n)
    rows = [(1, 0, "system", "be brief <|end|> ~<~|"), (1, 1, "user", words(300)), (1, 2, "assistant", words(200, "a")),
            (1, 3, "user", words(900)), (1, 4, "assistant", words(100, "b")), (1, 5, "user", None), (1, 6, "assistant", "")]
    rows += [(2, 0, "system", "alone")]
    rows += [(3, t, "assistant" if t % 2 else "user", f"</s>[INST] {t} [~INST] <<|" + words(t % 90)) for t in range(1500)]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"), (4, None, None, "no number")]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "yes")]
    rows += [(5, 0, "system", words(2000, "long")), (5, 1, "user", words(3)), (5, 2, "system", "late"), (5, 3, "assistant", words(5))]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), rows


def test_round_trip_loss_and_budget(spark):
    df, rows = convs(spark)
    windows = cf.chat_windows(df, budget=400, history=100).cache()
    turns = {}
    for r in cf.read_turns(windows).collect():
        turns.setdefault(r.conv_id, []).append((r.number, r.role, r.text, r.loss))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "unknown", r[3] or "")):
        want.setdefault(c, []).append((len(want.get(c, [])), role or "unknown", text or "", role == "assistant"))
    assert {c: sorted(v) for c, v in turns.items()} == want          # each turn is new once, in order
    sizes = {}
    for w in windows.collect():
        tokens = sum(len((t := want[w.conv_id][s.number])[2].split()) + 4 for s in w.spans)
        assert tokens == w.tokens and w.over_budget == (tokens > 400)
        new = [s.number for s in w.spans if not s.repeated]
        old = [s.number for s in w.spans if s.repeated]
        numbers = [s.number for s in w.spans]
        assert numbers == sorted(numbers) and (new or w.conv_id == 5)
        body = [n for n in numbers if not (n == 0 and want[w.conv_id][0][1] == "system")]
        assert body == list(range(body[0], body[-1] + 1)) if body else True
        if want[w.conv_id][0][1] == "system":
            assert numbers[0] == 0                                   # the system turn is in every window
        assert all(want[w.conv_id][s.number][1] == "assistant" and not s.repeated for s in w.spans if s.loss)
        history = sum(len(want[w.conv_id][n][2].split()) + 4 for n in old if n in body)
        assert history <= 100 or w.conv_id == 5
        if w.over_budget:
            assert len([n for n in new if n in body]) == 1 or w.conv_id == 5
        sizes.setdefault(w.conv_id, []).append(tokens)
    assert len(sizes[2]) == 1 and len(sizes[3]) > 100


def test_formatted_text_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|x"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    w = cf.chat_windows(df).collect()
    assert [x.formatted for x in w] == ["<|user|>\n<~|x<|end|>\n<|assistant|>\nok<|end|>\n"]
    s = w[0].spans[1]
    assert w[0].formatted[s.start:s.start + s.length] == "ok" and s.loss
    assert cf.chat_windows(df.limit(0)).collect() == []


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(alphabet="<[~|/s>INST]x", max_size=14), min_size=20, max_size=60))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", cf.escape(F.col("t")))
    for r in df.withColumn("u", cf.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in cf.CONTROL)


def test_query_equals_sql_and_plan_is_native(spark, capsys):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    df = cf.op2_chat_format(spark, sf)
    want = sorted(con.execute(cf.OP2_SQL).fetchall())
    assert sorted(map(tuple, df.collect())) == want and want[0][0] == -7
    df.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
