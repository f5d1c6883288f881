"""One file, many tasks: equal to the one-task readers."""

import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textlens.sources import large_files as L
from textlens.sources import readers as R


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _texts(n, seed=7):
    rng = random.Random(seed)
    pieces = ["plain", 'say "hi"', "two\nlines", "a,b", "}{][", "\\", 'end\\"', "é漢😀", "", " ", "null", "\t", '"', "x" * 300, "}\n}"]
    return ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(6))) for _ in range(n)]


@pytest.mark.parametrize("split", [37, 1000, None])
def test_csv_in_splits(spark, tmp_path, split):
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "text", "label"])
        for i, t in enumerate(_texts(60 if split == 37 else 400)):
            w.writerow([i, t, i % 3])
    ddl = "id bigint, text string, label int"
    got = L.read_large_csv(spark, path, ddl, split_bytes=split, with_order=True)
    assert _rows(got.drop("_order")) == _rows(R.read_csv(spark, path, ddl))
    ids = [r["id"] for r in got.orderBy("_order").collect()]
    assert ids == sorted(ids)
    if split:
        with L._splits_of(spark, split):
            assert spark.read.text(path).rdd.getNumPartitions() > 4


def test_csv_one_record_over_many_splits_and_bad_quotes(spark, tmp_path):
    path = str(tmp_path / "long.csv")
    text = "\n".join(f'line {i} "q"' for i in range(500))
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\r\n").writerows([["id", "text"], [1, text], [2, "short"]])
    got = L.read_large_csv(spark, path, "id int, text string", split_bytes=64)
    assert _rows(got) == sorted([(1, text), (2, "short")], key=repr)
    with open(path, "a") as f:
        f.write('3,"never closed\n')
    with pytest.raises(ValueError, match="ends inside"):
        L.read_large_csv(spark, path, "id int, text string", split_bytes=64)


def test_empty_files(spark, tmp_path):
    for name, content in (("e.csv", ""), ("h.csv", "id,text\n")):
        (tmp_path / name).write_text(content)
        assert L.read_large_csv(spark, str(tmp_path / name), "id int, text string").count() == 0
    for name, content in (("a.json", "[]"), ("b.json", " [ ]\n"), ("c.json", "")):
        (tmp_path / name).write_text(content)
        assert L.read_large_json_array(spark, str(tmp_path / name), "a int").count() == 0
    for name, content in (("d.json", "{}"), ("f.json", "{ }\n")):
        (tmp_path / name).write_text(content)
        assert L.read_large_json_map(spark, str(tmp_path / name), "a int").count() == 0


@pytest.mark.parametrize("split", [53, 2000, None])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_in_splits(spark, tmp_path, split, indent):
    texts = _texts(60 if split == 53 else 300, seed=3)
    recs = [{"id": i, "text": t, "spans": [{"a": t[:2]}, {"a": None}] if i % 3 else []} for i, t in enumerate(texts)]
    ddl = "id bigint, text string, spans array<struct<a:string>>"
    array, mapped = str(tmp_path / "a.json"), str(tmp_path / "m.json")
    with open(array, "w", encoding="utf-8") as f:
        json.dump(recs, f, indent=indent, ensure_ascii=bool(indent))
    with open(mapped, "w", encoding="utf-8") as f:
        json.dump({f'k{r["id"]}"}}{{\\': r for r in recs}, f, indent=indent, ensure_ascii=bool(indent))
    assert _rows(L.read_large_json_array(spark, array, ddl, split_bytes=split)) == _rows(R.read_json_array(spark, array, ddl))
    got = L.read_large_json_map(spark, mapped, ddl, "key", split_bytes=split)
    assert _rows(got) == _rows(R.read_json_map(spark, mapped, ddl, "key"))
    assert got.count() == len(recs)


def test_json_scalar_member_is_an_error(spark, tmp_path):
    path = str(tmp_path / "a.json")
    with open(path, "w") as f:
        f.write('[{"a": 1}, 5, {"a": 2}]')
    with pytest.raises(Exception, match="not a member"):
        L.read_large_json_array(spark, path, "a int").collect()


def test_many_files_of_splits(spark, tmp_path):
    expected = []
    for k in range(5):
        with open(tmp_path / f"p{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "text"])
            for i, t in enumerate(_texts(40, seed=k)):
                w.writerow([100 * k + i, "v" + t])
                expected.append((100 * k + i, "v" + t))
    got = L.read_large_csv(spark, str(tmp_path), "id bigint, text string", na_strings=None, split_bytes=200)
    assert _rows(got) == sorted(expected, key=repr)
    assert os.path.exists(tmp_path / "p0.csv") and got.select(F.count_distinct("id")).first()[0] == 200
