"""Sources and sinks: written, read back and compared with the table they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import POSTS, ntz, posts, read, shown, sql_embed, sql_shown, stub_embed
from threadloom.functions.text import expand_contractions
from threadloom.functions.lexicons import CONTRACTIONS
from threadloom.operators.models import embed_texts
from threadloom.operators.splitting import stratified_split
from threadloom.plans.knowledge import build_knowledge_base
from threadloom.session import scratch_path, store
from threadloom.sources import manifests, readers, writers

RAW = ["thread_id", "posted_date_time", "text_clean", "filename"]


def _raw(spark, sf):
    return posts(spark, sf).select(
        "doc_id",
        "thread_id",
        F.date_format("posted_date_time", "yyyy-MM-dd HH:mm:ss").alias("posted_date_time"),
        F.col("text").alias("text_clean"),
        "filename",
        "lang",
    )


RAW_SQL = f"""{POSTS}, raw AS (
  SELECT doc_id, thread_id, strftime(posted_date_time, '%Y-%m-%d %H:%M:%S') AS posted_date_time,
         text AS text_clean, filename, lang FROM posts)"""


def src_new_csv(spark, sf):
    """Files of two layouts, one with its columns in another order and one more."""
    path = scratch_path(spark, "csv")
    raw = _raw(spark, sf)
    writers.write_csv(raw.filter("lang = 'en'").select(*RAW), f"{path}/board_a")
    writers.write_csv(
        raw.filter("lang <> 'en'").select("lang", *reversed(RAW)), f"{path}/board_b"
    )
    return readers.read_new_csv(spark, path, "2000-01-01 00:00:00", "board_").select(*RAW, "lang")


def src_csv_ranges(spark, sf):
    """CSV files read by byte ranges, with line breaks, commas and quotes in their fields."""
    path = scratch_path(spark, "csv-large")
    texts = read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit('He said: "'), F.col("text"), F.lit('",\n\n"ok"')).alias("text"), "source"
    )
    writers.write_csv(texts, path)
    rows = readers.read_new_csv(spark, path, schema=texts.schema, split_bytes=0)
    return rows.select("doc_id", "text", "source")


def src_subsets(spark, sf):
    """Subsets read back, the ones lacking a column skipped whole."""
    path = scratch_path(spark, "subsets")
    raw = _raw(spark, sf)
    split = stratified_split(raw.select("doc_id", *RAW), "filename", "doc_id", fraction=0.25)
    writers.write_subsets(split.drop("doc_id"), path, "csv")
    writers.write_csv(raw.drop("filename"), f"{path}/subset=other_subset.csv")
    return readers.read_subsets(spark, path)


def src_subsets_parquet(spark, sf):
    """The same with the default format."""
    path = scratch_path(spark, "subsets")
    raw = _raw(spark, sf)
    split = stratified_split(raw.select("doc_id", *RAW), "filename", "doc_id", fraction=0.25)
    writers.write_subsets(split.drop("doc_id"), path)
    raw.drop("filename").write.parquet(f"{path}/subset=other_subset.parquet")
    return readers.read_subsets(spark, path)


def src_typed_tables(spark, sf):
    """One table through CSV and through Parquet, by declared type."""
    table = read(spark, sf, "customer")
    frames = []
    for kind in ("csv", "parquet"):
        path = scratch_path(spark, f"customer-{kind}")
        writers.replace_table(table, path, kind)
        frame = readers.read_table(spark, path, kind, table.schema)
        frames.append(frame.withColumn("kind", F.lit(kind)))
    return frames[0].unionByName(frames[1])


def src_json(spark, sf):
    """One JSON document per file."""
    path = scratch_path(spark, "json")
    table = read(spark, sf, "benchmark")
    document = F.to_json(F.struct("item_id", "text"))
    table.select(document.alias("value"), F.col("item_id").alias("item")).write.partitionBy(
        "item"
    ).text(path)
    return readers.read_json(spark, f"{path}/*", table.schema)


def src_row_count(spark, sf):
    path = scratch_path(spark, "count")
    events = read(spark, sf, "events").repartition("event_type")
    # a file per type
    events.write.partitionBy("event_type").parquet(path)
    return readers.count_total_rows(spark, path)


def _kb(spark, sf):
    vectors = read(spark, sf, "embeddings")
    # a document without a vector is part of the base
    return posts(spark, sf).join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        "thread_id",
        F.date_format("posted_date_time", "yyyy-MM-dd HH:mm:ss").alias("posted_date_time"),
        F.col("text").alias("text_clean"),
        F.to_json("embedding").alias("embedding"),
    )


def src_knowledge_base(spark, sf):
    """A knowledge base kept as CSV, its vectors as text."""
    path = scratch_path(spark, "kb-csv")
    writers.write_csv(_kb(spark, sf), path)
    kb = readers.read_knowledge_base(spark, path, "csv")
    return kb.select(
        "thread_id",
        ntz("posted_date_time").alias("posted_date_time"),
        "text",
        shown("embedding").alias("vector"),
    )


CONTRACTED = "concat(text, ' They don''t know, I''m sure; Don''t ask')"


def src_lexicon(spark, sf):
    """The contraction lexicon, written, read and applied to every document."""
    path = scratch_path(spark, "lexicon")
    table = readers.lexicon_table(spark, CONTRACTIONS)
    entries = F.map_from_entries(F.array_agg(F.struct("token", "expansion")))
    table.agg(F.to_json(entries)).write.text(path)
    lexicon = readers.read_lexicon(spark, path)
    text = F.expr(CONTRACTED)
    return read(spark, sf, "documents").select(
        "doc_id", expand_contractions(text, lexicon).alias("expanded")
    )


def snk_csv(spark, sf):
    path = scratch_path(spark, "events-csv")
    table = read(spark, sf, "events")
    writers.write_csv(table, path)
    return readers.read_table(spark, path, "csv", table.schema)


def snk_subsets(spark, sf):
    """Rows of every written subset, by its file name."""
    path = scratch_path(spark, "split")
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    writers.write_subsets(stratified_split(docs, "lang", "doc_id", fraction=0.1), path, "parquet")
    return spark.read.parquet(path).select("doc_id", "lang", F.col("subset").cast("string"))


def snk_build_if_absent(spark, sf):
    """The second build finds the first and leaves it alone."""
    path = scratch_path(spark, "kb-once")
    docs = read(spark, sf, "documents").select("doc_id", "text")
    first = embed_texts(docs, "text", [("stub", stub_embed)]).select("doc_id", "embedding")
    writers.build_if_absent(first, path)
    writers.build_if_absent(first.withColumn("doc_id", F.lit(-1).cast("long")), path)
    return spark.read.parquet(path).select(
        "doc_id", shown("embedding").alias("vector")
    )


def snk_replace(spark, sf):
    path = scratch_path(spark, "replaced")
    writers.replace_table(read(spark, sf, "orders"), path)
    writers.replace_table(read(spark, sf, "events"), path)
    return spark.read.parquet(path)


def snk_missing_only(spark, sf):
    """Documents copied to a target that already has the labelled ones."""
    path = scratch_path(spark, "sync")
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    labels = read(spark, sf, "labels").select("doc_id", F.lit("kept").alias("lang"))
    writers.replace_table(labels, path)
    writers.append_missing(docs, path, ["doc_id"])
    return spark.read.parquet(path)


def snk_file_sync(spark, sf):
    """Files of labelled documents are copied, then those of the others; and the state of each at the second time."""
    source, target = scratch_path(spark, "files"), scratch_path(spark, "copies")
    docs = read(spark, sf, "documents").select("doc_id", "lang", "text")
    labelled = read(spark, sf, "labels").select("doc_id")
    docs.join(labelled, "doc_id", "left_semi").write.json(f"{source}/labelled")
    manifests.sync(spark, source, target)
    docs.join(labelled, "doc_id", "left_anti").write.json(f"{source}/others")
    states = manifests.sync(spark, source, target).select(F.substring_index("path", "/", 1).alias("part"), "state")
    rows = spark.read.schema(docs.schema).json([f"{target}/labelled", f"{target}/others"])
    rows = rows.withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows.join(F.broadcast(states.distinct()), "part").select("doc_id", "lang", "text", "part", "state")


def emb_knowledge_base(spark, sf):
    """Subsets of either format to an embedded knowledge base."""
    raw = _raw(spark, sf).select("doc_id", *RAW)
    # stored: it is written twice, and its texts move once
    split = store(stratified_split(raw, "filename", "doc_id", fraction=0.5))
    bases = []
    for kind in ("parquet", "csv"):
        subsets, kb = scratch_path(spark, "kb-in"), scratch_path(spark, "kb-out")
        writers.write_subsets(split.drop("doc_id"), subsets, kind)
        build_knowledge_base(spark, subsets, kb, [("stub", stub_embed)], batch_size=50)
        bases.append(spark.read.parquet(kb).withColumn("kind", F.lit(kind)))
    return bases[0].unionByName(bases[1]).select(
        "kind",
        "thread_id",
        ntz("posted_date_time").alias("posted_date_time"),
        "text",
        shown("embedding").alias("vector"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        src_new_csv, src_csv_ranges, src_subsets, src_subsets_parquet, src_typed_tables, src_json, src_row_count, src_knowledge_base,
        src_lexicon, snk_csv, snk_subsets, snk_build_if_absent, snk_replace, snk_missing_only, snk_file_sync,
        emb_knowledge_base,
    )
}

_RAW_COLUMNS = ", ".join(RAW)


def _lexicon_sql() -> str:
    from catalog.base import sql_words

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    keys = ", ".join(quote(k) for k in CONTRACTIONS)
    values = ", ".join(quote(v) for v in CONTRACTIONS.values())
    return f"""WITH lexicon AS (SELECT MAP([{keys}], [{values}]) AS m)
SELECT doc_id, array_to_string(list_transform({sql_words(CONTRACTED)},
  lambda w: coalesce(m[w], w)), ' ') AS expanded FROM documents, lexicon"""


ORACLES = {
    "src_new_csv": f"""WITH {RAW_SQL} SELECT {_RAW_COLUMNS},
        CASE WHEN lang <> 'en' THEN lang END AS lang FROM raw""",
    "src_csv_ranges": """SELECT doc_id, 'He said: "' || text || '",' || chr(10) || chr(10) || '"ok"' AS text,
        source FROM documents""",
    "src_subsets": f"WITH {RAW_SQL} SELECT {_RAW_COLUMNS} FROM raw",
    "src_subsets_parquet": f"WITH {RAW_SQL} SELECT {_RAW_COLUMNS} FROM raw",
    "src_typed_tables": """SELECT *, 'csv' AS kind FROM customer
        UNION ALL SELECT *, 'parquet' AS kind FROM customer""",
    "src_json": "SELECT item_id, text FROM benchmark",
    "src_row_count": "SELECT count(DISTINCT event_type) AS files, count(*) AS total_rows FROM events",
    "src_knowledge_base": f"""WITH {POSTS}
        SELECT thread_id, date_trunc('second', posted_date_time) AS posted_date_time, text,
               {sql_shown('embedding')} AS vector
        FROM posts LEFT JOIN embeddings ON doc_id = vec_id WHERE length(text) >= 20""",
    "src_lexicon": _lexicon_sql(),
    "snk_csv": "SELECT * FROM events",
    "snk_subsets": """WITH ranked AS (
          SELECT doc_id, lang, md5('42|' || doc_id) AS h, count(*) OVER (PARTITION BY lang) AS n,
                 row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS rn
          FROM documents),
        placed AS (SELECT *, row_number() OVER (ORDER BY (rn - phase) / n, h) - 1 AS place FROM
          (SELECT *, CAST(('0x' || substr(md5('42/phase|=' || lang), 1, 12)) AS BIGINT)::DOUBLE
            / 281474976710656::DOUBLE AS phase FROM ranked))
        SELECT doc_id, lang, 'dataset_' || (place // (SELECT CAST(floor(count(*) * 0.1) AS BIGINT)
          FROM documents) + 1) || '_subset.parquet' AS subset FROM placed""",
    "snk_build_if_absent": f"""SELECT doc_id, {sql_shown(sql_embed('text'))} AS vector
        FROM documents""",
    "snk_replace": "SELECT * FROM events",
    "snk_missing_only": """SELECT doc_id, 'kept' AS lang FROM labels UNION ALL
        SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "snk_file_sync": """SELECT doc_id, lang, text, CASE WHEN l THEN 'labelled' ELSE 'others' END AS part,
          CASE WHEN l THEN 'same' ELSE 'missing' END AS state
        FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)""",
    "emb_knowledge_base": f"""WITH {RAW_SQL}
        SELECT kind, thread_id, CAST(posted_date_time AS TIMESTAMP) AS posted_date_time,
               text_clean AS text, {sql_shown(sql_embed('text_clean'))} AS vector
        FROM raw, (VALUES ('parquet'), ('csv')) k(kind)""",
}
