"""Large CSV files by ranges: the rows of the whole-file reader, wherever the cuts fall."""

import random

import pytest

from threadloom.sources import ranges, readers

HEADER = "thread_id,posted_date_time,text_clean,filename"


@pytest.fixture
def sized(spark):
    """Cuts files every so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(n):
        spark.conf.set(names[0], str(n))
        # the cost of opening bounds the size from above as well
        spark.conf.set(names[1], str(n))

    yield cut
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def field(rng, line):
    text = "".join(rng.choice(["a", "é", "日本", " ", ",", '"', line, line, "x" * 9, "\r" if line == "\n" else ""]) for _ in range(rng.randrange(12)))
    if any(c in text for c in ',"\n\r') or rng.random() < 0.3:
        return '"' + text.replace('"', '""') + '"'
    return text


def made(seed, line, n=40):
    rng = random.Random(seed)
    rows = [",".join([str(i), *(field(rng, line) for _ in range(rng.choice([3, 3, 3, 2, 4])))]) for i in range(n)]
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 2]))] + [""]
    rng.shuffle(rows)
    return HEADER + line + line.join(rows) + rng.choice(["", line, line + line])


def found(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("line", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [23, 40, 100_000])
def test_any_cut_gives_the_rows_of_the_whole_file(spark, tmp_path, sized, line, size):
    paths = []
    for seed in range(2):
        (tmp_path / f"f {seed}.csv").write_bytes(made(f"{seed}{line}", line).encode())
        paths.append(str(tmp_path / f"f {seed}.csv"))
    whole = found(readers.read_csv_files(spark, paths, with_file=True))
    sized(size)
    cut = readers.read_csv_files(spark, paths, with_file=True, split_bytes=0)
    assert "mapInArrow" in cut._jdf.queryExecution().toString() or "MapInArrow" in cut._jdf.queryExecution().toString()
    assert found(cut) == whole and len(whole) > 80
    if size == 40:
        scanned, _ = ranges.scan_ranges(spark, paths)
        assert scanned.where("inside").count() > 10
        # beyond a broadcast, lines are dealt out by range and put back in order
        lines = [ranges.records(spark, paths, scanned, small).count() for small in (True, False)]
        texts = [found(ranges.records(spark, paths, scanned, small)) for small in (True, False)]
        assert texts[0] == texts[1] and lines[0] == lines[1]


@pytest.mark.parametrize(
    "body",
    ['1,t,5" wide,f\n2,t,6" wide,f\n', '1,t, "a",f\n', '1,t,"a"b,f\n', '1,t,"open,f\n2,t,x,f\n', '1,t,a,f\r\n2,t,"b\nc",f\n'],
)
def test_irregular_files_are_read_whole(spark, tmp_path, sized, body, caplog):
    header = HEADER + ("\r\n" if "\r" in body else "\n")
    (tmp_path / "a.csv").write_bytes((header + body * 3).encode())
    whole = found(readers.read_csv_files(spark, [str(tmp_path / "a.csv")]))
    sized(16)
    with caplog.at_level("WARNING"):
        assert found(readers.read_csv_files(spark, [str(tmp_path / "a.csv")], split_bytes=0)) == whole
    assert "read whole" in caplog.text


def test_typed_and_odd_columns(spark, tmp_path, sized):
    (tmp_path / "a.csv").write_text('"a.b",`c`,n\n"x\ny",2,7\nz,,bad\n,"",8\n')
    schema = "`a.b` string, n int"
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    whole = found(readers.read_csv_files(spark, [str(tmp_path / "a.csv")], kind))
    sized(9)
    cut = readers.read_csv_files(spark, [str(tmp_path / "a.csv")], kind, split_bytes=0)
    assert cut.columns == ["a.b", "`c`", "n"] and found(cut) == whole


def test_a_field_over_many_ranges(spark, tmp_path, sized):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "a.csv").write_text(f'{HEADER}\n1,t,"{long}",f\n2,t,b,f\n')
    sized(50)
    rows = {r.thread_id: r for r in readers.read_csv_files(spark, [str(tmp_path / "a.csv")], split_bytes=0).collect()}
    assert rows["1"].text_clean == long and rows["2"].filename == "f" and len(rows) == 2
