import hashlib

from pyspark.sql import functions as F

from ledgerlake.llm.chat_format import format_chats, op1_chat_format, parse, pieces

NASTY = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]", "a\\", "\n</s>\n", "[INST] x [/INST]\n", "<s>\n", "<<SYS>>a<</SYS>>", "", " ", "\n", "é😀</s>", "\\" * 3000, "[/INST", "$1\\$2"]


def test_round_trip_of_nasty_texts(spark):
    rows = [(i % 3, j, ["user", "assistant", "sys[/INST]\nrole"][j % 3], t) for i in range(3) for j, t in enumerate(NASTY)]
    rows += [(9, 0, None, None), (9, 1, "assistant", None), (None, None, "assistant", "x"), (9, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as n_turns", "3 as formatted")
    out = format_chats(df).withColumn("back", parse(F.col("formatted"))).collect()
    assert len(out) == 5
    for r in out:
        want = sorted([((x[1] is not None, x[1] or 0), x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id])
        assert [(b.role, b.text) for b in r.back] == [w[1:] for w in want]
        assert r.n_turns == len(want)
        assert len(r.loss_spans) == sum(w[1] == "assistant" for w in want)


def test_contract_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", NASTY[0]), (1, "assistant", NASTY[0])]
    got = {r.conv_id: r for r in op1_chat_format(spark, sf).collect()}
    assert set(got) == set(turns)
    for k, ts in turns.items():
        ts.sort()
        said = "".join(t[2] for t in ts if t[1] == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{t[1]}\n{t[2]}\n" for t in ts).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_one_conversation_of_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"é{i}</s>" if i % 5 == 0 else f"é{i}") for i in range(20_000)]
    chats = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    row = chats.select("n_turns", pieces(F.col("formatted"), F.col("loss_spans")).alias("said")).first()
    assert row.n_turns == 20_000 and [s.replace("\\</s>", "</s>") for s in row.said] == [r[3] for r in rows if r[2] == "assistant"]
