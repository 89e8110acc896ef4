from rastrel.llm import chat_format
from rastrel.llm import queries as registered

ROWS = [
    (None, 0, "user", "who"), (None, 1, "assistant", "me </turn>"), (None, 2, "user", "and"), (None, 3, "assistant", "### me"), (None, 4, "user", "left over"),
    (1, 0, "assistant", None), (1, 1, "assistant", "b"), (2, 0, "user", "alone"),
]


def test_examples_of_every_conversation_also_null(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    want = {}
    for conv in {r[0] for r in ROWS}:
        text, k = "", 0
        for c, _, role, said in ROWS:
            if c == conv:
                segment, a, b = chat_format.format_turn(role, said or "")
                if role == "assistant":
                    want[conv, k] = (text + segment, len(text) + a, len(text) + b)
                    k += 1
                text += segment
    got = {(r.conv_id, r.example): (r.text, r.loss_start, r.loss_end) for r in chat_format.examples(chat_format.segments(turns)).collect()}
    assert got == want and (None, 1) in got


def test_examples_read_back_as_their_turns(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    found = chat_format.segments(turns)
    got = chat_format.read_examples(chat_format.examples(found, tails=True)).collect()
    assert sorted(map(str, got)) == sorted(map(str, chat_format.read_back(found).collect())) and len(got) == 3
    assert chat_format.read_examples(chat_format.examples(found.limit(0), tails=True)).collect() == []


def test_query_builds_the_examples(spark, sf_dir, monkeypatch):
    built = []
    whole = chat_format.examples
    monkeypatch.setattr(chat_format, "examples", lambda *a, **b: built.append(whole(*a, **b)) or built[-1])
    registered.op4_chat_format(spark, sf_dir)
    replies = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").count()
    assert built[0].where("example is not null").count() == replies + 1
