"""What a task of model calls holds, and that rows come through it as they were."""

import datetime as dt
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from threadloom.operators.models import complete_prompts, embed_texts

TEXTS = T.StructType().add("id", "long").add("text", "string")


def held_while_running(ask):
    """Most bytes of Python values while a task works through one large batch, and its rows."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000)), "text": ["x" * 3_000 + str(i) for i in range(10_000)]})
    task = SimpleNamespace(columns=TEXTS.names, schema=TEXTS, mapInArrow=lambda run, schema: run)
    run, rows = ask(task), 0
    tracemalloc.start()
    for out in run(iter([batch])):
        rows += out.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_embedding_holds_one_call_of_texts():
    embed = lambda texts: [[1.0, 2.0] for _ in texts]
    most, rows = held_while_running(lambda df: embed_texts(df, "text", [("m", embed)], 100, dealt=True))
    assert rows == 10_000 and most < 2e6  # the batch's texts are 30 MB


def test_completion_holds_a_few_prompts():
    complete = lambda system, user: str(len(user))
    most, rows = held_while_running(lambda df: complete_prompts(df, "text", "text", [("m", complete)], dealt=True))
    assert rows == 10_000 and most < 2e6


def test_other_columns_come_through_as_they_were(spark):
    schema = "id int, at timestamp, big decimal(20,2), m map<string,int>, s struct<a:array<int>>, b binary, text string"
    rows = [
        (1, dt.datetime(1500, 1, 2, 3, 4, 5, 6), None, {"a": None}, ([1, None],), b"\x00", "one"),
        (None, None, None, None, None, None, None),
        (3, dt.datetime(2024, 1, 1), None, {}, None, b"", "three"),
    ]
    df = spark.createDataFrame(rows, schema)
    embedded = embed_texts(df, "text", [("m", lambda texts: [[len(t)] for t in texts])], 2)
    done = complete_prompts(embedded, "text", "text", [("m", lambda s, u: s + u)])
    got = sorted(done.collect(), key=lambda r: (r.id is None, r.id))
    assert [r[:7] for r in got] == [tuple(r) for r in sorted(df.collect(), key=lambda r: (r.id is None, r.id))]
    assert [r.embedding for r in got] == [[3.0], [5.0], None]
    assert [r.embedding_usage for r in got] == [{"prompt_tokens": 1}, {"prompt_tokens": 1}, None]
    assert [r.reply for r in got] == ["oneone", "threethree", None]
    assert got[2].error.startswith("TypeError")
    assert done.schema["embedding"].dataType == T.ArrayType(T.FloatType(), containsNull=False)


@pytest.mark.parametrize("given", [3, 1])
def test_a_vector_for_each_text(spark, given):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    asked = embed_texts(df, "text", [("m", lambda texts: [[0.0]] * given)], dealt=True)
    with pytest.raises(Exception, match=f"2 texts, {given} vectors"):
        asked.collect()
