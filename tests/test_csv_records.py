"""CSV files read by many splits at once against a reader that goes through them from the start."""
import csv
import io
import random

import pytest

from logweave.sources import readers as rd
from logweave.sources.csv_records import csv_records, stays_open


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(rng):
    parts = ["a", "bc", " ", ",", '"', "\n", "\r\n", "x,y", '""', "é", "日本", "1", "", "\n\n", "'"]
    return "".join(rng.choices(parts, k=rng.choice([0, 1, 1, 2, 3, 9])))


def write(path, rows, rng, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        for row in rows:
            f.write(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') or rng.random() < 0.2 else c for c in row) + end)


def plain(path):
    with open(path, encoding="utf-8", newline="") as f:
        return [r for r in csv.reader(f) if r]


def got(spark, path, header):
    df = rd.read_csv(spark, str(path), infer=False)
    assert df.columns == header
    return sorted([["" if v is None else v for v in r] for r in df.collect()])


def missing(rows):
    return sorted([["" if c in rd.CSV_NA_TOKENS else c for c in r] for r in rows])


@pytest.mark.parametrize("seed", range(4))
def test_random_files(spark, small_splits, tmp_path, seed):
    """Cells with separators, quotes and line breaks, several files, both line ends; splits of a few hundred bytes."""
    rng = random.Random(seed)
    want = []
    for k in range(3):
        rows = [["id", "text", "more"]] + [[f"{k}-{i}", cells(rng), cells(rng)] for i in range(rng.randint(0, 150))]
        write(tmp_path / f"part {k}.csv", rows, rng, "\r\n" if k == 1 else "\n")
        assert plain(tmp_path / f"part {k}.csv") == rows
        want += rows[1:]
    assert got(spark, tmp_path, ["id", "text", "more"]) == missing(want)
    assert csv_records(spark, str(tmp_path))[0].rdd.getNumPartitions() > 5 if len(want) > 100 else True


def test_one_cell_over_many_splits(spark, small_splits, tmp_path):
    """A cell longer than several splits, a quote-free stretch inside it, and a file that ends within a cell."""
    rng = random.Random(9)
    long = "\n".join(f"line {k} of a long cell, with commas" for k in range(200))
    rows = [["id", "text"]] + [[str(k), "short"] for k in range(40)] + [["x", long]] + [[str(k), 'a "b"\n'] for k in range(40)]
    write(tmp_path / "long.csv", rows, rng)
    assert got(spark, tmp_path / "long.csv", ["id", "text"]) == missing(rows[1:])
    with open(tmp_path / "open.csv", "w", encoding="utf-8") as f:
        f.write("\n\nid,text\n" + "".join(f"{k},plain\n" for k in range(200)) + '9,"never closed\nat all')
    assert got(spark, tmp_path / "open.csv", ["id", "text"]) == sorted([[str(k), "plain"] for k in range(200)] + [["9", "never closed\nat all"]])


def test_awkward_files(spark, tmp_path):
    for name, text, header, want in [
            ("empty", "", [], []), ("only", "a,b\n", ["a", "b"], []), ("bom", "﻿a,b\n1,2\n", ["a", "b"], [["1", "2"]]),
            ("ragged", "a,b\n1\n1,2,3\n\n", ["a", "b"], [["1", ""], ["1", "2"]]),
            ("quoted head", '"a\nb","c ""d"""\n1,2', ["a_b", 'c_"d"'], [["1", "2"]]),
            ("inner quote", 'a,b\n5" disk,6"\n"x"y,z\n', ["a", "b"], None)]:
        path = tmp_path / f"{name}.csv"
        path.write_text(text, encoding="utf-8")
        df = rd.read_csv(spark, str(path), infer=False)
        assert df.columns == header, name
        if want is not None:
            assert sorted(["" if v is None else v for v in r] for r in df.collect()) == want, name
        else:
            sequential = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(path))
            assert sorted(map(tuple, df.collect())) == sorted(map(tuple, sequential.collect()))


def test_line_states():
    """The state after a line, from either side, equals that of a character by character reader."""
    def slow(line, inside):
        state = "quoted" if inside else "start"
        k = 0
        while k < len(line):
            c = line[k]
            if state == "quoted":
                if c == '"':
                    if line[k + 1:k + 2] == '"':
                        k += 1
                    else:
                        state = "after"
            elif c == ",":
                state = "start"
            elif state == "start":
                state = "quoted" if c == '"' else "plain"
            k += 1
        return state == "quoted"
    rng = random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choices('"",ab', k=rng.randint(0, 12)))
        for inside in (False, True):
            assert stays_open(line, inside) == slow(line, inside), (line, inside)
    assert stays_open('"' + 'a""' * 100_000, False) and not stays_open("x," * 100_000 + '"y"', False)
    assert next(csv.reader(io.StringIO('a,"b"\n'))) == ["a", "b"]
