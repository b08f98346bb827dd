"""CSV by byte ranges against a machine that reads a character at a time."""

import random

import pytest
from proofline.sources import csv_ranges, readers
from pyspark.sql import functions as F


def machine(text):
    """Rows of cells, one state and one character at a time."""
    rows, row, cell, quoted, k = [], [], "", False, 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    while k < len(text):
        c = text[k]
        if quoted and c == '"' and text[k + 1 : k + 2] == '"':
            cell, k = cell + '"', k + 1
        elif c == '"':
            quoted = not quoted
        elif quoted:
            cell += c
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        else:
            cell += c
        k += 1
    return rows + ([[*row, cell]] if row or cell else [])


def filled(rows):
    return [[c.strip() for c in r] for r in rows if any(c.strip() for c in r)]


@pytest.fixture
def ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


PARTS = ["a", "é", ",", ",", '"', '""', "\n", "\r\n", "\r", " ", '"x,\ny"', '"say ""hi"""', "name", '\n"', '",']


def test_cells():
    rng = random.Random(1)
    for _ in range(3000):
        record = "".join(rng.choice([p for p in PARTS if "\n" not in p and "\r" not in p]) for _ in range(rng.randrange(12)))
        if record.count('"') % 2 == 0:
            assert [csv_ranges.cells_of(record)] == machine(record + "\n"), record


def test_ranges_give_what_the_machine_gives(spark, ranges, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(120))) for _ in range(5)]
    texts += ["", "\n\n , \n", '"' + "q\n" * 40, 'h,i\n"' + "long,\n" * 30 + '",z\nlast,"1\r\n2"', "\n" * 45 + '"\n",' + "\n" * 45 + ',"\n , \n"\nx', "h\n" + "row,1,2,3\n" * 20]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, t in enumerate(texts):
        (folder / f"f{k:02}.csv").write_bytes(t.encode())
    want_rows, want_heads = [], []
    for t in texts:
        all_ = machine(t)
        first = next((k for k, r in enumerate(all_) if any(c.strip() for c in r)), None)
        if first is not None:
            want_heads += filled([all_[first]])
            want_rows += filled(all_[first + 1 :])
    for size, most in ((67, 50_000), (151, 0)):
        ranges(size)
        monkeypatch.setattr(csv_ranges, "MOST_SENT", most)
        if size == 67:
            assert csv_ranges.lines(spark, str(folder)).select("file", "block").distinct().count() > 12
        rows, heads = csv_ranges.read_records(spark, str(folder))
        got = sorted(map(tuple, rows.collect()))
        assert filled(cells for _, cells in got) == want_rows and len({n for n, _ in got}) == len(got)
        assert filled(r.cells for r in heads.orderBy("file").collect()) == want_heads


def test_one_quoted_file_is_read_by_several_tasks(spark, ranges, tmp_path):
    body = "File,Note\r\n" + "".join(f'f{k % 50}.png,"line {k},\r\n""two"""\r\n' for k in range(400))
    (tmp_path / "big.csv").write_bytes(body.encode())
    ranges(900)
    rows = readers.read_csv(spark, str(tmp_path / "big.csv"))
    assert rows.select(F.spark_partition_id()).distinct().count() > 4
    got = rows.orderBy("_line").collect()
    assert [(r.file, r.note) for r in got] == [(f"f{k % 50}.png", f'line {k},\n"two"') for k in range(400)]
    last = readers.last_per_key(rows, "file", "_line").collect()
    assert {r.file: r.note.split(",")[0] for r in last} == {f"f{k}.png": f"line {350 + k}" for k in range(50)}


def test_the_last_row_of_a_name_is_that_of_the_last_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,type,brand name\nx.png,wine,old\n")
    (tmp_path / "b.csv").write_text("filename,type,brand name\n" + "y.png,wine,other\n" * 500 + "x.png,wine,new\n")
    got = {r.filename_key: r.brand_name for r in readers.load_manifest(readers.read_csv(spark, str(tmp_path))).collect()}
    assert got == {"x.png": "new", "y.png": "other"}
