"""Readers and writers on files made by hand."""

import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.operators.models import complete_prompts, embed_texts
from threadloom.plans.knowledge import Models, build_knowledge_base, run_queries
from threadloom.plans.prepare import prepare_data
from threadloom.sources import readers, writers
from threadloom.streaming import ingest

HEADER = "thread_id,posted_date_time,text_clean,filename"


def put(path, text, age=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if age is not None:
        os.utime(path, (age, age))


def test_new_csv(spark, tmp_path):
    put(tmp_path / "a/one.csv", f'{HEADER}\n1,2024-01-01,"line\nbreak, ""q""",f\n', 1_000_000)
    put(tmp_path / "a/cut.csv", f"{HEADER}\n9,9,9,9\n", 999_999)
    put(tmp_path / "a/two.csv", "extra,text_clean,filename,thread_id,posted_date_time\nx,b,f,2,t\n")
    put(tmp_path / "a/empty.csv", "")
    put(tmp_path / "a/other.txt", f"{HEADER}\n8,8,8,8\n")
    df = readers.read_new_csv(spark, str(tmp_path), "1970-01-12 13:46:39")
    rows = {r.thread_id: r for r in df.collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].text_clean == 'line\nbreak, "q"' and rows["1"].extra is None
    assert rows["2"].extra == "x" and rows["2"].text_clean == "b"
    assert readers.read_new_csv(spark, str(tmp_path), name_contains="none").count() == 0


def test_subsets(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_subsets(spark, str(tmp_path / "no"))
    put(tmp_path / "x.csv", f"{HEADER}\n0,0,0,0\n")
    assert readers.read_subsets(spark, str(tmp_path)).count() == 0
    put(tmp_path / "dataset_1_subset.csv", f"{HEADER}\n1,t,a,f\n")
    put(tmp_path / "dataset_2_subset.csv", "thread_id,text_clean\n2,b\n")
    assert [r.thread_id for r in readers.read_subsets(spark, str(tmp_path)).collect()] == ["1"]


def test_json_and_types(spark, tmp_path):
    put(tmp_path / "ok.json", '{"a": 1,\n "b": "x"}')
    put(tmp_path / "bad.json", "{nope")
    rows = readers.read_json(spark, str(tmp_path), "a long, b string").collect()
    assert sorted((r.a, r.b) for r in rows if r.a) == [(1, "x")] and len(rows) == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path), "pickle")
    with pytest.raises(ValueError):
        writers.write_subsets(spark.range(1), str(tmp_path / "o"), "excel")


def test_row_count_sees_files_without_rows(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "b"))
    assert readers.count_total_rows(spark, str(tmp_path)).first().asDict() == {
        "files": 2, "total_rows": 7,
    }


def test_build_if_absent(spark, tmp_path):
    path = str(tmp_path / "kb")
    assert writers.build_if_absent(spark.range(0), path)
    assert spark.read.parquet(path).columns == ["id"]
    assert writers.build_if_absent(spark.range(3), path)
    assert not writers.build_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_prepare(spark, tmp_path):
    rows = "".join(f"{i},2024-02-{i % 28 + 1:02d} 0{i % 10}:00:00+00:00,text {i},f\n" for i in range(300))
    put(tmp_path / "in/posts.csv", f"{HEADER}\n{rows}")
    out = str(tmp_path / "subsets")
    split = prepare_data(
        spark, str(tmp_path / "in"), str(tmp_path / "all"), out, ["thread_id"],
        "2024-02-02", sample_size=100,
    )
    total = split.count()
    assert 0 < total <= 100
    assert readers.read_subsets(spark, out).count() == total
    assert split.filter("posted_date_time < '2024-02-03'").count() == 0


def odd_files(folder):
    put(folder / "good.csv", f'{HEADER}\n1,t,"a, ""b""\nc",f\n')
    put(folder / "turned.csv", "\ufefffilename,text_clean,posted_date_time,thread_id,more\r\nf,b,t,2,x\r\n")
    put(folder / "twice.csv", "thread_id,posted_date_time,text_clean,filename,Filename\n3,t,c,f,g\n")
    put(folder / "none.csv", "")
    (folder / "noise.csv").write_bytes(bytes(range(256)) * 8)


def test_odd_files_are_skipped(spark, tmp_path):
    odd_files(tmp_path / "in")
    paths = [str(p) for p in sorted((tmp_path / "in").iterdir())]
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in readers.file_headers(spark, paths).collect()}
    assert problems["good.csv"] is None and problems["turned.csv"] is None
    assert problems["twice.csv"] == "repeated column" and problems["noise.csv"]
    batch = readers.read_new_csv(spark, str(tmp_path / "in"))
    assert sorted(r.thread_id for r in batch.collect()) == ["1", "2"]


def test_cut_files_are_not_read_in_part(spark, tmp_path, caplog):
    rows = "".join(f"{i},t,{os.urandom(20).hex()},f\n" for i in range(20_000))
    whole = gzip.compress(f"{HEADER}\n{rows}".encode())
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "stub.csv.gz").write_bytes(whole[:12])
    put(tmp_path / "a b.csv", f"{HEADER}\n1,t,a,f\n")
    put(tmp_path / "none.csv", "")
    paths = {p.name: str(p) for p in tmp_path.iterdir()}
    with pytest.raises(Exception):
        readers.read_csv_files(spark, [paths["cut.csv.gz"]]).collect()
    caplog.clear()
    groups = readers._by_header(spark, list(paths.values()))
    assert len(groups) == 1
    logged = " ".join(r.getMessage() for r in caplog.records)
    assert paths["stub.csv.gz"] in logged and paths["none.csv"] in logged
    assert "cut.csv.gz" not in logged and "a b.csv" not in logged


def test_header_names(spark, tmp_path):
    put(tmp_path / "h.csv", '"a ""x"" b",c,"d,e",\n')
    (row,) = readers.file_headers(spark, [str(tmp_path / "h.csv")]).collect()
    assert row.header == ['a "x" b', "c", "d,e", ""]


def test_stream_equals_batch(spark, tmp_path):
    """Each file once, any column order, bad files left out, the batch reader's filters."""
    target, mark = str(tmp_path / "t"), str(tmp_path / "m")
    odd_files(tmp_path / "in")
    put(tmp_path / "in/old.csv", f"{HEADER}\n8,t,a,f\n", 1_000)
    for i in range(2):
        put(tmp_path / f"in/{i}.csv", f"{HEADER}\n1{i},t,a,f\n")
        files = ingest.stream_files(spark, str(tmp_path / "in"), "2000-01-01 00:00:00")
        ingest.ingest_available(files, target, mark).awaitTermination()
    batch = readers.read_new_csv(spark, str(tmp_path / "in"), "2000-01-01 00:00:00")
    batch = batch.select(*schemas.RAW_POSTS.fieldNames())
    streamed = spark.read.parquet(target).drop("batch")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert streamed.count() == 4


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_subsets_reach_the_knowledge_base(spark, tmp_path, kind):
    posts = spark.createDataFrame(
        [(str(i), "2024-01-01 00:00:00", f"text {i}", "f", i % 4) for i in range(40)],
        "thread_id string, posted_date_time string, text_clean string, filename string, split_id int",
    )
    subsets, kb = str(tmp_path / "s"), str(tmp_path / "kb")
    writers.write_subsets(posts, subsets, kind)
    embed = [("stub", lambda texts: [[float(len(t))] for t in texts])]
    assert build_knowledge_base(spark, subsets, kb, embed)
    assert spark.read.parquet(kb).count() == 40
    assert not build_knowledge_base(spark, subsets, kb, embed)
    other = "csv" if kind == "parquet" else "parquet"
    with pytest.raises(ValueError):
        readers.read_subsets(spark, subsets, other)
    writers.write_subsets(posts, f"{subsets}/more", other)
    assert readers.read_subsets(spark, subsets).count() == 40


def test_models_are_asked_once(spark):
    calls = {n: spark.sparkContext.accumulator(0) for n in ("embed", "chunk", "summary")}

    def embed(texts):
        calls["embed"].add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def chunk(system, user):
        calls["chunk"].add(1)
        return "(t, a, 1, 1)\n<signal_context>\nKey claims detected:\n- c"

    def summarize(system, user):
        calls["summary"].add(1)
        return "done"

    kb = spark.createDataFrame(
        [(i, f"t{i % 9}", f"some longer words of post number {i}. And another sentence here.", [float(i), 1.0]) for i in range(40)],
        "id long, thread_id string, text string, embedding array<float>",
    ).withColumn("posted_date_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    queries = spark.createDataFrame([(i, "q" * (i + 1)) for i in range(8)], "query_id long, query string")
    models = Models([("m", embed)], [("m", chunk)], [("m", summarize)])
    analyses, summaries = run_queries(kb, queries, models, k=2)
    for _ in range(2):
        assert summaries.count() == 8 and len(summaries.collect()) == 8
        chunks = analyses.count()
    assert calls["embed"].value == 8 and calls["summary"].value == 8
    assert calls["chunk"].value == chunks > 0


def test_model_calls_overlap(spark):
    def slow(system, user):
        time.sleep(0.2)
        return user

    df = spark.range(16).select(F.col("id").cast("string").alias("u"), F.lit("s").alias("s")).coalesce(1)
    df = spark.createDataFrame(df.collect(), df.schema)
    started = time.perf_counter()
    rows = complete_prompts(df, "s", "u", [("m", slow)], max_workers=16).collect()
    assert all(r.reply == r.u for r in rows) and len(rows) == 16
    assert time.perf_counter() - started < 16 * 0.2


def test_models_retry_and_fall_back(spark):
    calls = spark.sparkContext.accumulator(0)

    def down(texts):
        calls.add(1)
        raise ConnectionError("down")

    df = spark.createDataFrame([(i, "t" * i) for i in range(1, 5)], "i int, t string")
    good = ("good", lambda texts: [[float(len(t))] for t in texts])
    out = embed_texts(df, "t", [("bad", down), good], batch_size=2, attempts=2, wait=0.0).collect()
    assert [r.embedding for r in out] == [[1.0], [2.0], [3.0], [4.0]]
    assert {r.embedding_model for r in out} == {"good"} and calls.value >= 4
    with pytest.raises(Exception):
        embed_texts(df, "t", [("bad", down)], attempts=1).collect()

    def moody(system, user):
        if user == "tt":
            raise ValueError("no")
        return system + user

    asked = complete_prompts(df.withColumn("s", F.lit("S")), "s", "t", [("m", moody)])
    rows = {r.i: (r.reply, r.error) for r in asked.collect()}
    assert rows[1] == ("St", None) and rows[2] == (None, "ValueError: no")
