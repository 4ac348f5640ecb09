import os

import pytest
from pyspark.sql import functions as F

from lodestrata.sources.label_files import LabelFileWriter, change_label_files, file_lines, write_lines

CHANGE = "change_id long, path string, key string, value string, new_key string"
A, B, C = (f"P/M/AxLabelFile/{x}.en-us.label.txt" for x in "ABC")
TEXT = "﻿; Správce\r\n\r\n one = 1=1\r\n;about two\r\ntwo=2\r\ntwo=again\r\nno key\r\n=x\r\nthree=3\r\n"


@pytest.fixture
def root(tmp_path):
    for path, text in ((A, TEXT), (B, "k=v\nl=w")):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    return str(tmp_path)


def changed(spark, root, rows, **how):
    got = change_label_files(spark, root, spark.createDataFrame(rows, CHANGE), **how).collect()
    return [r["outcome"] for r in sorted(got, key=lambda r: r["change_id"])]


def content(root, path):
    with open(f"{root}/{path}", "rb") as f:
        return f.read().decode()


def test_round_trip_keeps_all_lines(spark, root):
    lines = file_lines(spark, root)
    assert [(r["key"], r["value"]) for r in lines.filter(F.col("path") == A).orderBy("n").collect() if r["key"]] == [("one", " 1=1"), ("two", "2"), ("two", "again"), ("three", "3")]
    write_lines(spark.createDataFrame(lines.collect(), lines.schema), root)
    assert content(root, A) == TEXT.replace("\r\n", "\n") and content(root, B) == "﻿k=v\nl=w\n"
    assert content(root, A + ".bak") == TEXT


def test_changes_and_their_outcomes(spark, root):
    rows = [
        (1, A, "two", "zwei\r\nlines", None), (2, A, "one", None, "uno"), (3, A, "three", None, None), (4, A, "four", "4", None), (5, C, "new", "file", None), (6, C, "x", None, "y"),
        (7, B, "none", None, None), (8, B, "k", None, "k"), (9, A, "a=b", "1", None), (10, A, None, "1", None), (11, A, "five", "old", None), (12, A, "five", "5", None), (13, A, " ", None, "q"), (14, "zz", "x", None, None),
    ]
    want = ["Updated", "Renamed", "Deleted", "Created", "Created", "FileMissing", "KeyMissing", "NoChange", "Invalid", "Invalid", "Superseded", "Created", "Invalid", "FileMissing"]
    assert changed(spark, root, rows, overwrite=True) == want
    assert content(root, A) == "﻿; Správce\n\nuno= 1=1\n;about two\ntwo=zwei\\nlines\ntwo=again\nno key\n=x\nfour=4\nfive=5\n"
    assert content(root, C) == "﻿new=file\n" and content(root, B) == "k=v\nl=w" and not os.path.exists(f"{root}/{B}.bak")


def test_keys_that_exist(spark, root):
    assert changed(spark, root, [(1, B, "k", "x", None), (2, B, "l", None, "k")]) == ["KeyExists", "KeyExists"] and content(root, B) == "k=v\nl=w"
    assert changed(spark, root, [(1, B, "l", None, "k"), (2, B, "m", "1", None), (3, A, "one", None, "q"), (4, A, "two", None, "q")], overwrite=True) == ["Renamed", "Created", "Renamed", "KeyExists"]
    assert content(root, B) == "﻿k=w\nm=1\n"
    assert changed(spark, root, [(1, B, "k", None, "m"), (2, B, "m", None, "k")], overwrite=True) == ["Renamed", "Renamed"] and content(root, B) == "﻿m=w\nk=1\n"
    assert changed(spark, root, [(1, B, "k", None, None), (2, B, "m", None, None)]) == ["Deleted", "Deleted"] and content(root, B) == "﻿"
    assert changed(spark, root, [(1, B, "z", "1", None)]) == ["Created"] and changed(spark, root, []) == []


def test_an_aborted_write_leaves_the_files(spark, root):
    fails = F.when(F.col("n") == 6, F.raise_error(F.lit("broken off")).cast("string")).otherwise(F.lit("new=1"))
    lines = spark.createDataFrame([(A, n) for n in range(8)] + [(B, 0)], "path string, n long").withColumn("line", fails)
    with pytest.raises(Exception, match="broken off"):
        write_lines(lines, root)
    assert content(root, A) == TEXT and content(root, B) == "k=v\nl=w"
    assert sorted(os.listdir(os.path.dirname(f"{root}/{A}"))) == sorted(os.path.basename(x) for x in (A, B))
    w = LabelFileWriter(root)
    staged = w.write(iter([(A, "a=1"), (B, None)]))
    w.abort([staged, None])
    assert content(root, A) == TEXT and sorted(os.listdir(os.path.dirname(f"{root}/{A}"))) == sorted(os.path.basename(x) for x in (A, B))
