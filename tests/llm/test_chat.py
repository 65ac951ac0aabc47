import hashlib

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.cases import values
from tideline.llm import chat
from tideline.llm.queries import conversations_and_probe

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = "\\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", HARD), (1, 2, "user", "<turn x>\n<next>\\l\\b\\g"), (1, 3, "assistant", "</turn>\n"),
    (1, 4, "assistant", "<"), (1, 5, "assistant", ""), (2, 0, "assistant", None), (3, 0, None, "no role"), (3, None, "user", "no turn"),
    (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (4, 1, "user", "tie a"), (None, 0, "user", "no conversation"),
    (5, 0, "a>\n<b\\", "odd role"), (6, 0, "assistant", "long \U0001f600 " * 50_000),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out, by = [], {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_edges_read_back(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("turns", "segments", "formatted", "t", "starts", "merged"):
        turns = turns.withColumn(name, F.lit(1))
    assert values(chat.digests(chat.format_chats(turns)), *COLUMNS) == expected(ROWS)


def test_table_reads_back(spark):
    rows = [tuple(r) for r in conversations_and_probe(spark, SMALL).collect()]
    assert values(chat.digests(chat.format_chats(conversations_and_probe(spark, SMALL))), *COLUMNS) == expected(rows)


def test_template(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b</turn>"), (1, 2, "assistant", "c\\")]
    row = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.formatted == "<turn user>\na<next>b\\l/turn></turn>\n<turn assistant>\nc\\b</turn>\n"
    assert [s.text for s in row.segments if s.loss] == ["c\\b"]
    assert "".join(s.text for s in row.segments) == row.formatted


def test_many_turns_of_one_conversation(spark):
    rows = [(1, i, "user" if i // 3 % 2 else "assistant", f"text {i}") for i in range(5000)]
    assert values(chat.digests(chat.format_chats(spark.createDataFrame(rows, SCHEMA))), *COLUMNS) == expected(rows)


def test_no_rows(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = chat.digests(chat.format_chats(spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
