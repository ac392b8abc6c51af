"""Splittable reading of quoted CSV: equal to the csv module and to a one-task read, whatever the splits."""

import csv as pycsv
import io
import os
import random

import pytest
from pyspark.sql import types as TY

from tensio.sources import csv, records

PIECES = ["a", "bc", " ", "é", "日本", '""', "\n", "\n\n", ",", ";", "x,y\nz", "\r\n", "NAme", "'"]


def random_file(rng, n, columns=3, newline="\n"):
    """Quoted fields with newlines, separators and doubled quotes; plain ones with stray quotes."""
    out = [",".join(f"h{i}" for i in range(columns))]
    for _ in range(n):
        fields = []
        for _ in range(columns):
            if rng.random() < 0.5:
                fields.append('"' + "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 9, 60]))) + '"')
            else:
                fields.append(rng.choice(["p", "plain text", 'say 5" tall', "o'clock", "7"]) + str(rng.randint(0, 99)))
        out.append(",".join(fields))
    return newline.join(out) + rng.choice(["", newline])


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


@pytest.fixture()
def splits(spark):
    yield lambda size: small_splits(spark, size)
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def by_module(text):
    return [r for r in pycsv.reader(io.StringIO(text, newline=""), strict=False) if r][1:]


@pytest.mark.parametrize("seed,size,newline", [(1, 64, "\n"), (2, 200, "\r\n"), (3, 17, "\n")])
def test_random_quoting_equals_csv_module(spark, tmpdir_path, splits, seed, size, newline):
    rng = random.Random(seed)
    text = random_file(rng, size // 2, newline=newline)
    path = put(tmpdir_path, "r.csv", text)
    splits(size)
    df = csv.read_csv(spark, path, na_tokens=(), position="at")
    got = [tuple(r)[:3] for r in df.orderBy("at").collect()]
    want = [tuple(r) for r in by_module(text)]
    assert [tuple(v or "" for v in r) for r in got] == want
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.rdd.getNumPartitions() >= 10


def test_one_task_read_is_equal(spark, tmpdir_path, splits):
    """The same records as Spark's own multi-line reader, without stray quotes."""
    text = random_file(random.Random(9), 50).replace('5"', "5")
    path = put(tmpdir_path, "o.csv", text)
    whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', emptyValue="").collect()
    splits(150)
    split = csv.read_csv(spark, path, na_tokens=(), position="at").orderBy("at").drop("at").collect()
    assert [tuple(v or "" for v in r) for r in split] == [tuple(v or "" for v in r) for r in whole]


def test_many_files_keep_their_order(spark, tmpdir_path, splits):
    rng = random.Random(4)
    texts = [random_file(rng, n) for n in (30, 1, 0, 40)]
    for i, t in enumerate(texts):
        put(tmpdir_path, f"f{i}.csv", t)
    splits(300)
    got = [tuple(v or "" for v in tuple(r)[:3]) for r in csv.read_csv(spark, tmpdir_path, na_tokens=(), position="at").orderBy("at").collect()]
    assert got == [tuple(r) for t in texts for r in by_module(t)]


def test_record_over_many_splits_and_unclosed_quote(spark, tmpdir_path, splits):
    long = "line\n" * 300
    path = put(tmpdir_path, "l.csv", f'h,i\n1,"{long}"\n2,x\n3,"open, and the rest\nof the file\n')
    splits(100)
    rows = csv.read_csv(spark, path, na_tokens=(), position="at").orderBy("at").collect()
    assert [(r.h, r.i) for r in rows[:2]] == [("1", long), ("2", "x")]
    assert len(rows) == 3 and rows[2].h == "3" and rows[2].i.startswith("open, and the rest\nof the file")


def test_effects_compose():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        effects = np.array([rng.randrange(4) for _ in range(rng.randint(1, 12))])
        for opened in (False, True):
            now, want = opened, []
            for e in effects:
                now = {records.KEEP: now, records.FLIP: not now, records.CLOSE: False, records.OPEN: True}[int(e)]
                want.append(now)
            assert records._open_after(effects, opened).tolist() == want


def test_same_text_from_four_encodings(spark, tmpdir_path):
    text = 'h,i\n1,"café\nnaïve"\n2,über\n'
    want = [("1", "café\nnaïve"), ("2", "über")]
    for encoding, name in (("utf-8", "auto"), ("latin-1", "auto"), ("cp1252", "auto"), ("utf-8-sig", "auto"), ("latin-1", "ISO-8859-1")):
        path = put(tmpdir_path, f"{encoding}-{name}.csv", text, encoding)
        df = csv.read_csv(spark, path, encoding=name, position="at")
        assert df.columns[:2] == ["h", "i"]
        assert [tuple(r)[:2] for r in df.orderBy("at").collect()] == want
    path = put(tmpdir_path, "high.csv", "h\n“quoted” – 5 €…\n", "cp1252")
    assert csv.read_csv(spark, path, encoding="auto").first().h == "“quoted” – 5 €…"
    assert len(records.CP1252_HIGH) == 32 and bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252") == "".join(c for c in records.CP1252_HIGH if ord(c) > 0xFF)


SIX = TY.StructType([TY.StructField(c, TY.StringType()) for c in "abcdef"])


@pytest.mark.parametrize("multiline", [True, False])
def test_too_many_fields_whatever_they_hold(spark, tmpdir_path, multiline):
    lines = ["1,b,c,d,e,long,,eight", "2,b,c,d,e,long,NA,eight", "3,b,c,d,e,f", "4,b,c", "5,b,c,d,e,f,", '6,b,c,d,e,"f,g,h"', '7,b,c,d,e,5" x,y', "8,b,c,d,e,f,g"]
    path = put(tmpdir_path, "w.csv", "\n".join(lines) + "\n")
    rows, report = csv.read_csv_tolerant(spark, path, SIX, multiline=multiline)
    assert {r.a for r in rows.collect()} == {"3", "4", "6"}
    assert tuple(report.first()) == (8, 5)
    assert {r.a: r.f for r in rows.collect()} == {"3": "f", "4": None, "6": "f,g,h"}
