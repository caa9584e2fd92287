import hashlib

from ledgerfield.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def result(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    made = chat.format_conversations(df)
    return ({r["conv_id"]: r for r in made.collect()},
            {r["conv_id"]: r for r in chat.digests(made).collect()})


def test_turns_are_sorted_merged_and_read_back(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"),
            (1, 3, "assistant", "d"), (2, 0, "system", "only")]
    made, digest = result(spark, rows)
    assert made[1]["formatted"] == ("<|im_start|>user\na<|im_sep|>b<|im_end|>\n"
                                    "<|im_start|>assistant\nc<|im_sep|>d<|im_end|>\n")
    assert [s["text"] for s in made[1]["segments"] if s["loss"]] == ["c", "d"]
    turns = "user\na\nuser\nb\nassistant\nc\nassistant\nd\n"
    assert digest[1]["n_turns"] == 4
    assert digest[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert digest[1]["loss_sha256"] == hashlib.sha256(b"cd").hexdigest()
    assert digest[1]["formatted_chars"] == len(made[1]["formatted"])
    assert digest[2]["loss_chars"] == 0


def test_control_strings_nulls_and_ties(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "<!|x|>", "<!!|", "<", "|", "", None,
           "<|im_sep|>", "é<|im_sep|>\n\n", "<<|im_start|>"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner", t) for i, t in enumerate(odd)]
    rows += [(2, None, "assistant", "x"), (2, 0, None, "y"), (2, 0, None, "y"), (2, 0, "a", None),
             (None, 0, "assistant", "z")]
    _, digest = result(spark, rows)

    def turns(of):
        rank = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows
                       if r[0] == of))
        return "".join(f"{role}\n{text}\n" for _, _, role, text in rank), [
            text for _, _, role, text in rank if role == "assistant"]

    for conv in (1, 2, None):
        told, loss = turns(conv)
        assert digest[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert digest[conv]["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()
        assert digest[conv]["loss_chars"] == len("".join(loss))
    assert digest[2]["n_turns"] == 4


def test_empty(spark):
    made, digest = result(spark, [])
    assert made == {} and digest == {}


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(3000)]
    _, digest = result(spark, rows)
    assert digest[1]["n_turns"] == 3000
    loss = "".join(f"t{i}" for i in range(3000) if i % 3)
    assert digest[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "")], SCHEMA)
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
