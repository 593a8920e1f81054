"""What the tasks of a whole query run hold, from embedding to summaries."""

import os
import tracemalloc
import uuid

from pyspark.sql import functions as F

from catalog import replies
from threadloom.operators import models

DOCUMENTS, QUERIES = 5_000, 500
SENTENCE = " some words of a sentence."
#: bytes of a text, nearly
TEXT = 120 * len(SENTENCE)


def watched(method, folder):
    """A frame's ``method`` that also notes a task's rows, and the most bytes Python held for it, in ``folder``."""

    def mapped(df, run, schema):
        step = "similar" if "rank_by" in schema.names else "prompts" if "_user" in df.columns else "embed"

        def noted(batches):
            import pandas  # noqa: F401  its modules are not what a task holds

            rows = 0
            tracemalloc.start()
            for out in run(batches):
                rows += len(out)
                yield out
            most = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            with open(os.path.join(folder, f"{step}-{uuid.uuid4().hex}"), "w") as note:
                note.write(f"{rows} {most}")

        return method(df, noted, schema)

    return mapped


def test_no_step_holds_the_values_of_a_batch_or_all_pairs(spark, tmp_path, monkeypatch):
    sf, notes = tmp_path / "sf", tmp_path / "notes"
    notes.mkdir()
    text = F.concat(F.lit("post "), F.col("id"), F.repeat(F.lit(SENTENCE), 120))
    documents = spark.range(DOCUMENTS).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("src"), F.col("id") % 20).alias("source")
    )
    documents.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    asked = spark.range(QUERIES).select(F.col("id").alias("item_id"), F.concat(F.lit("query "), "id").alias("text"))
    asked.write.parquet(f"{sf}/benchmark.parquet")
    # one task with large batches, as the tasks of a large table have
    monkeypatch.setattr(models, "spread", lambda df: df.coalesce(1))
    frame = type(documents)
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, name, watched(getattr(frame, name), str(notes)))

    summaries = replies.sum_run_queries(spark, str(sf)).collect()
    assert len({r.query_id for r in summaries}) == len(summaries) == QUERIES
    assert all(r.summary for r in summaries)

    found = {}
    for note in notes.iterdir():
        rows, most = map(int, note.read_text().split())
        step = note.name.split("-")[0]
        found[step] = max(found.get(step, (0, 0)), (rows, most))
    assert found["embed"][0] == DOCUMENTS and found["prompts"][0] >= 3 * QUERIES
    # a batch as it was sent counts once; of its texts, or of chunks and prompts, a few are values besides
    assert found["embed"][1] < 1.25 * DOCUMENTS * TEXT
    assert found["prompts"][1] < 1.5 * 3 * QUERIES * 2 * TEXT
    # a number for each pair takes 20 MB, and a candidate several
    assert found["similar"][1] < 3 * DOCUMENTS * QUERIES * 8
