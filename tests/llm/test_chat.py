"""Reply trees against a plain walk, and reversible formatting."""

from pyspark.sql import functions as F

from codelode.llm.chat import chain_messages, format_chat, masked_text, read_chat, reply_paths

ODD = "<|im_end|><|im_start|>assistant ok <||x|> <| \\n \n"
MESSAGES = [
    ("t", 1, None, 1.0, "user", "root"), ("t", 2, 1, 2.0, "assistant", "a"), ("t", 3, 1, 5.0, "assistant", ODD), ("t", 4, 2, 9.0, "user", None),
    ("t", 5, 3, None, "user", ""), ("t", 6, 99, 0.5, "system\n\\n", "orphan"), ("c", 1, 2, 0.0, "user", "cycle"), ("c", 2, 1, 0.0, "user", "cycle"),
    ("t", 3, 1, 5.0, "assistant", ODD), (None, 1, None, 0.0, "user", "null tree"), (None, 2, 1, 0.0, "assistant", "null leaf"), ("t", None, 1, 9.0, "user", "no id"),
]
SCHEMA = "tree string, message long, parent long, score double, role string, text string"


def test_paths_and_round_trip(spark):
    m = spark.createDataFrame(MESSAGES, SCHEMA).withColumn("extra", F.lit(1))
    paths = reply_paths(m, keep=3)
    got = {}
    for r in paths.collect():
        got.setdefault((r.tree, r.leaf, r["rank"]), []).append((r.depth, r.message))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {("t", 4, 1): [1, 2, 4], ("t", 5, 2): [1, 3, 5], ("t", 6, 3): [6], (None, 2, 1): [1, 2]}
    chats = format_chat(m, paths).withColumn("turns", read_chat(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    found = chats.collect()
    rows = {r.leaf: r for r in found if r.tree}
    assert [(r.n_turns, r.loss) for r in found if r.tree is None] == [(2, "null leaf")]
    assert [tuple(x) for x in rows[5].turns] == [("user", "root"), ("assistant", ODD), ("user", "")]
    assert rows[5].loss == ODD and rows[4].loss == "a"
    assert [tuple(x) for x in rows[6].turns] == [("system\n\\n", "orphan")]
    assert rows[5].formatted.count("<|im_start|>") == 3


def test_long_chain_and_ties(spark):
    turns = [(7, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(130)] + [(8, 0, "user", "b"), (8, 0, "user", "a"), (8, None, None, None), (None, 1, "user", "x"), (None, 2, "assistant", "y")]
    m = chain_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = {r.tree: r for r in format_chat(m, reply_paths(m)).withColumn("turns", read_chat(F.col("formatted"))).collect()}
    assert [x.text for x in out[7].turns] == [f"t{i}" for i in range(130)]
    assert [x.text for x in out[8].turns] == ["", "a", "b"]
    assert [x.text for x in out[None].turns] == ["x", "y"]


def test_empty(spark):
    m = spark.createDataFrame([], SCHEMA)
    assert format_chat(m, reply_paths(m)).count() == 0
