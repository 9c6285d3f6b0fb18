import hashlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import chat

TALK = "conv_id long, turn long, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<|", "\\", "\n", "a", "<", "[", "é\U0001f600", "s>", "/s>", "INST]", "/", "|"]
ROWS = [
    (1, 0, "system", "be <s> brief"),
    (1, 1, "user", "hi\\</s>"),
    (1, 2, "assistant", "[INST] ok \\n"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "bye"),
    (2, 0, "user", "alone"),
    (3, 0, "assistant", "first"),
    (3, 0, "assistant", "first"),
    (3, 1, None, "no role"),
    (4, None, "odd\nrole\\", "x"),
    (None, 0, "assistant", "no id"),
]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=6), st.lists(st.sampled_from(PARTS), max_size=8)), min_size=1, max_size=20))
def test_formatting_is_reversible(spark, turns):
    rows = [("".join(r), "".join(t)) for r, t in turns]
    frame = spark.createDataFrame(rows, "role string, text string")
    out = frame.select("role", "text", chat.formatted_turn(F.col("role"), F.col("text")).alias("f")).withColumn("back", chat.read_turns(chat.raw_turns("f")))
    for r in out.collect():
        assert [tuple(t) for t in r.back] == [(r.role, r.text)]
        inside = r.f.removeprefix("<s>").removesuffix("</s>")
        assert not any(c in inside for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def expected(rows):
    talks = {}
    for c, n, role, text in rows:
        talks.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    for c, turns in talks.items():
        turns.sort()
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        trained = "".join(t for _, _, r, t in turns if r == "assistant")
        yield c, len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest()


def test_query_reads_back(spark, tmp_path):
    spark.createDataFrame(ROWS, TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    said = "</s>[INST] ok [/INST]"
    got = {tuple(r)[:5] for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    assert got == set(expected([*ROWS, (-1, 0, "user", said), (-1, 1, "assistant", said)]))


def test_examples_hold_all_turns_before_and_train_one_reply(spark):
    deltas = chat.prefix_targets(spark.createDataFrame(ROWS, TALK))
    got = sorted((str(r.conv_id), r.example, r.context, r.reply) for r in chat.examples(deltas).collect())
    esc = {r.text: r.e for r in spark.createDataFrame([(t,) for *_, t in ROWS if t], "text string").select("text", chat.escaped(F.col("text")).alias("e")).collect()}
    one = [f"<s>{r}\n{esc.get(t, '')}</s>" for _, _, r, t in ROWS[:6]]
    assert [g for g in got if g[0] == "1"] == [("1", 0, one[0] + one[1] + "<s>assistant\n", esc[ROWS[2][3]]), ("1", 1, "".join(one[:4]) + "<s>assistant\n", "")]
    assert len([g for g in got if g[0] == "3"]) == 2 and not [g for g in got if g[0] == "2"]


@pytest.mark.parametrize("column, value", [("context_turns", 1), ("context_digest", 7), ("context_chars", 3)])
def test_a_context_that_is_not_the_turns_before_is_told(spark, column, value):
    deltas = chat.prefix_targets(spark.createDataFrame([r for r in ROWS if r[0] == 1], TALK))
    names = ("example", "context_turns", "context_digest", "context_chars")

    def holds(rows):
        whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names, "delta"))).alias("xs"))
        raw = chat.raw_turns(F.array_join(F.transform("xs", lambda x: x["delta"]), ""))
        return whole.select(chat._contexts_hold(F.col("xs"), raw, "assistant")).first()[0]

    assert holds(deltas) is True
    assert holds(deltas.withColumn(column, F.when(F.col("example") == 1, F.lit(value).cast("long")).otherwise(F.col(column)))) is False


def test_a_long_conversation(spark):
    turns = [(9, i, "assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(4000)]
    deltas = chat.prefix_targets(spark.createDataFrame(turns, TALK))
    rows = deltas.orderBy("example").collect()
    assert len(rows) == 2000 and [r.context_turns for r in rows] == list(range(1, 4000, 2))
    assert rows[-1].context_chars == sum(len(r.delta) for r in rows[:-1]) + rows[-1].loss_start


def test_no_rows(spark):
    assert chat.prefix_targets(spark.createDataFrame([], TALK)).collect() == []


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in ROWS if r[1] is not None and r[0] is not None]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, TALK).coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{path}/*.parquet'")
    ours = chat.op3_chat(spark, str(tmp_path)).toPandas()
    theirs = duck.execute(chat.OP3_SQL).df()[list(ours.columns)]
    assert sorted(map(str, ours.values.tolist())) == sorted(map(str, theirs.values.tolist()))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10), min_size=1, max_size=40))
@example([["x [| y [s> <INST]"], ["a [| b [/s> </INST] <s>"]])
def test_escapes_as_the_sql_counts_them(spark, texts):
    duckdb = pytest.importorskip("duckdb")
    rows = [("".join(t),) for t in texts]
    got = spark.createDataFrame(rows, "text string").select("text", F.length(chat.escaped(F.col("text")))).collect()
    for text, n in got:
        assert n == duckdb.execute(f"select {chat._sql_length('x')} from (select ?::varchar as x)", [text]).fetchone()[0]


def test_every_reply_is_exploded_with_all_turns_before_it(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(301)]
    piece = "<s>{}\nturn {} <\\s></s>".format
    got = chat.expanded(spark.createDataFrame(rows, TALK)).orderBy("example").collect()
    assert [r.text for r in got] == ["".join(piece(r, i) for _, i, r, _ in rows[:n]) for n in [*range(2, 301, 2), 301]]
    assert [r.text[r.loss_start :][: r.loss_chars] for r in got[:-1]] == [f"turn {i} <\\s>" for i in range(1, 301, 2)]
    assert got[-1].loss_chars is None and [r.last for r in got] == [False] * 150 + [True]


BROKEN = {
    "a context without its first turn": lambda out: out.withColumns({"text": F.when(F.col("example") == 1, F.expr("substring(text, 25)")).otherwise(F.col("text")), "loss_start": F.when(F.col("example") == 1, F.col("loss_start") - 24).otherwise(F.col("loss_start"))}),
    "another first turn": lambda out: out.withColumn("text", F.when(F.col("example") == 0, F.replace("text", F.lit("brief"), F.lit("short"))).otherwise(F.col("text"))),
    "a mask off by one": lambda out: out.withColumn("loss_start", F.col("loss_start") - 1),
    "an example too few": lambda out: out.where("example <> 0"),
}


@pytest.mark.parametrize("how", BROKEN)
def test_query_reads_the_expanded_examples(spark, tmp_path, monkeypatch, how):
    spark.createDataFrame([r for r in ROWS if r[0] == 1], TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    full = chat.expanded
    monkeypatch.setattr(chat, "expanded", lambda turns: BROKEN[how](full(turns)))
    with pytest.raises(Exception, match="context is not the turns before"):
        chat.op3_chat(spark, str(tmp_path)).collect()
