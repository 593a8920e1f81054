"""Answers are asked for once, and outlive a job that died."""

import collections
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.operators import ledger as L
from threadloom.operators.models import embed_texts
from threadloom.plans.knowledge import Models, build_knowledge_base, run_queries
from threadloom.sources import writers


def noted(folder, text):
    """A call leaves a file: calls are counted across processes."""
    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
        f.write(text)


def calls(folder):
    return collections.Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


@pytest.fixture
def notes(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return str(folder)


def completer(folder, broken=()):
    def complete(system, user):
        noted(folder, f"{system}/{user}")
        if user in broken:
            raise ValueError("broken")
        return f"{system}:{user}"

    return complete


def test_each_prompt_is_asked_once(spark, tmp_path, notes):
    rows = [(i, "s", f"p{i % 7}") for i in range(50)] + [(50, "s", None), (51, None, None), (52, "s", ""), (53, "s|1:p", "1")]
    df = spark.createDataFrame(rows, "id long, system string, user string").withColumn("reply", F.lit("old"))
    path = str(tmp_path / "ledger")
    providers = [("m", completer(notes, {"p3"}))]
    for _ in range(2):
        done = L.complete_once(df, "system", "user", providers, path)
        got = {r.id: (r.reply, r.reply_model, r.error) for r in done.collect()}
        assert len(got) == len(rows) and done.columns == ["id", "system", "user", "reply", "reply_model", "error"]
        for i, s, u in rows:
            want = (None, None, "ValueError: broken") if u == "p3" else (f"{s}:{u}", "m", None)
            assert got[i] == want
    counted = calls(notes)
    # what failed is asked again, what was answered is not
    assert counted.pop("s/p3") == 2 and set(counted.values()) == {1}
    # another model and another parameter are other questions
    L.complete_once(df, "system", "user", [("m2", completer(notes))], path).count()
    L.complete_once(df, "system", "user", providers, path, {"temperature": 1}).count()
    assert calls(notes)["s/p0"] == 3


def test_a_job_that_died_goes_on_where_it_was(spark, tmp_path, notes):
    """One task dies after all others are done; the second run asks its questions alone."""
    texts = [f"text {i}" for i in range(64)]
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    path, task = str(tmp_path / "ledger"), 8
    armed = str(tmp_path / "armed")
    open(armed, "w").close()

    def embed(batch):
        for t in batch:
            noted(notes, t)
        if os.path.exists(armed) and "text 9" in batch:
            until = time.time() + 60
            done = 0
            while time.time() < until and done < 7:
                time.sleep(0.3)
                done = len([f for f in os.listdir(path) if f.endswith(".parquet")]) if os.path.isdir(path) else 0
            raise SystemExit("killed")
        return [[float(len(t)), 1.0] for t in batch]

    with pytest.raises(Exception):
        L.embed_once(df, "text", [("m", embed)], path, attempts=1, task_questions=task).count()
    asked = calls(notes)
    os.remove(armed)
    done = L.embed_once(df, "text", [("m", embed)], path, attempts=1, task_questions=task)
    assert {r.text: list(r.embedding) for r in done.collect()} == {t: [float(len(t)), 1.0] for t in texts}
    again = calls(notes) - asked
    assert "text 9" in again and set(calls(notes)) == set(texts)
    # questions are dealt out by hash, so tasks hold 8 of them on average
    assert 0 < sum(again.values()) <= 24
    assert done.count() == 3 * len(texts) and max(calls(notes).values()) <= 2


def test_entries_of_several_jobs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "_key string, reply string, reply_model string, error string, _failed boolean, _at timestamp"
    at = [F.to_timestamp(F.lit(f"2024-01-01 00:00:0{i}")) for i in range(4)]
    rows = [("a", None, None, "e1", True, 0), ("a", "first", "m", None, False, 1), ("a", "second", "m", None, False, 2), ("b", None, None, "e1", True, 1), ("b", None, None, "e2", True, 3)]
    df = spark.createDataFrame([r[:5] + (i,) for i, r in enumerate(rows)], "_key string, reply string, reply_model string, error string, _failed boolean, n int")
    when = F.coalesce(*[F.when(F.col("n") == i, at[r[5]]) for i, r in enumerate(rows)])
    df.withColumn("_at", when).drop("n").write.parquet(path)
    assert spark.read.parquet(path).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    best = {r._key: (r.reply, r.error, r._failed) for r in L.best_entries(L.read_ledger(spark, path, L.REPLIES)).collect()}
    assert best == {"a": ("first", None, False), "b": (None, "e2", True)}
    assert L.read_ledger(spark, str(tmp_path / "none"), L.VECTORS).count() == 0


def test_null_texts_are_not_sent(spark, notes):
    def embed(batch):
        noted(notes, str(len(batch)))
        return [[1.0] for _ in batch]

    df = spark.createDataFrame([(i, None if i % 3 else f"t{i}") for i in range(9)] + [(9, "")], "id long, text string").coalesce(1)
    rows = embed_texts(df, "text", [("m", embed)], batch_size=4, dealt=True).orderBy("id").collect()
    assert [r.embedding is None for r in rows] == [bool(i % 3) for i in range(9)] + [False]
    assert all((r.embedding_model is None) == (r.embedding_usage is None) == (r.embedding is None) for r in rows)
    assert embed_texts(df.where("text IS NULL"), "text", [("m", embed)], dealt=True).count() == 6
    assert sum(int(n) * c for n, c in calls(notes).items()) == 4


def test_knowledge_through_a_ledger(spark, tmp_path, notes):
    """Empty fields of CSV subsets are null; a rebuilt base and a second run ask nothing."""
    subsets, base, store = str(tmp_path / "subsets"), str(tmp_path / "kb"), str(tmp_path / "ledger")
    rows = [(f"{i % 3}", "2024-02-01 00:00:00", None if i == 4 else f"a text of twenty letters and more {i % 5}", "f", i % 2) for i in range(12)]
    posts = spark.createDataFrame(rows, "thread_id string, posted_date_time string, text_clean string, filename string, split_id int")
    writers.write_subsets(posts, subsets, "csv")

    def embed(batch):
        for t in batch:
            noted(notes, "embed " + t)
        return [[float(len(t)), 1.0] for t in batch]

    models = Models(embed=[("e", embed)], complete=[("c", completer(notes))], ledger=store)
    for n in range(2):
        assert build_knowledge_base(spark, subsets, f"{base}{n}", models.embed, ledger=f"{store}")
        assert not build_knowledge_base(spark, subsets, f"{base}{n}", models.embed, ledger=f"{store}")
        kb = spark.read.parquet(f"{base}{n}")
        assert kb.count() == 12 and kb.where("embedding IS NULL").count() == 1
        kb = kb.where("text IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
        queries = spark.createDataFrame([(0, "what?")], "query_id long, query string")
        analyses, summaries = run_queries(kb, queries, models, k=2)
        assert analyses.count() > 0 and summaries.count() == 1
    counted = calls(notes)
    assert all(c == 1 for t, c in counted.items() if not t.startswith("embed what"))
