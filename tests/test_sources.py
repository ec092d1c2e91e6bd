import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions.bytes import decode_text
from sieveline.operators import corpus
from sieveline.sources import artifacts, files


def test_csv_with_plain_header(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Resume,Category\n"line one\nsays ""hi"", ok",HR\n,\nNA,null\nlast,IT\n')
    rows = files.read_labeled_csv(spark, str(path)).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: int(r["id"]))] == [
        ("0", 'line one\nsays "hi", ok', "HR"),
        ("1", "", "Unknown"),
        ("2", "", "Unknown"),
        ("3", "last", "IT"),
    ]


def test_csv_with_keyed_header(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("Category,Extra,ID,Resume_str\nHR,1,007,text\n,2,8,\n")
    rows = files.read_labeled_csv(spark, str(path)).collect()
    assert sorted(map(tuple, rows)) == [("007", "text", "HR"), ("8", "", "Unknown")]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def by_number(df):
    return sorted(map(tuple, df.collect()), key=lambda r: int(r[0]))


CELLS = ["plain", "", "NA", "two\nlines", 'he said ""x""\n\n', ",", "a\r\nb", "x" * 300, "\n" * 90, "日本\n\"\"", " pad ", '""']


def written(rows, end):
    quoted = lambda c: f'"{c}"' if any(x in c for x in ',"\r\n') else c
    return end.join(",".join(map(quoted, r)) for r in rows) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_split_file_reads_like_a_whole_one(spark, tmp_path, small_splits, end):
    draw = random.Random(7)
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        rows = [("Resume", "Category")] + [(draw.choice(CELLS), draw.choice(CELLS)) for _ in range(150)]
        (folder / name).write_text(written(rows, end), newline="")
    whole, split = (files.read_labeled_csv(spark, str(folder), split=s) for s in (False, True))
    assert spark.read.text(str(folder), lineSep="\n").rdd.getNumPartitions() > 50
    assert by_number(split) == by_number(whole)
    assert len(by_number(split)) == 300


def test_split_files_with_awkward_edges(spark, tmp_path, small_splits):
    cases = {
        "no-end": 'ID,Resume_str,Category\n1,"a\nb",x\n2,last,y',
        "empty-lines": 'ID,Resume_str,Category\n\n\n1,a,x\n\n2,"b\n\n\nc",y\n\n',
        "header-only": "ID,Resume_str,Category\n",
        "mark": "\ufeffID,Resume_str,Category\n1,a,x\n",
        "quoted-header": '"ID","Resume_str","Category"\n1,"' + "z\n" * 200 + '",x\n2,"",y\n',
        "short-row": "ID,Resume_str,Category\n1\n2,b\n3,c,z,more\n",
    }
    for name, text in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        whole, split = (files.read_labeled_csv(spark, str(path), split=s) for s in (False, True))
        assert by_number(split) == by_number(whole), name


def test_missing_marks_count_in_text_tables_only(spark):
    df = spark.createDataFrame([(1, "None", "NA"), (2, None, None)], "ID long, Resume_str string, Category string")
    assert sorted(map(tuple, corpus.normalize_corpus(df).collect())) == [("1", "None", "NA"), ("2", "", "Unknown")]


def test_other_headers_are_refused(spark):
    with pytest.raises(ValueError, match="schema"):
        corpus.normalize_corpus(spark.createDataFrame([("a", "b")], "Resume string, Label string"))


def test_row_numbers_follow_files(spark, tmp_path):
    for name, rows in (("1.csv", ["a", "b", "c"]), ("2.csv", ["d"]), ("3.csv", ["e", "f"])):
        (tmp_path / name).write_text("Resume,Category\n" + "".join(f"{r},x\n" for r in rows))
    rows = files.read_labeled_csv(spark, str(tmp_path)).collect()
    assert [r["doc_text"] for r in sorted(rows, key=lambda r: int(r["id"]))] == list("abcdef")


def test_row_ids_are_dense_over_ranges(spark):
    df = spark.range(0, 5000).select((F.col("id") * F.col("id")).alias("k"))
    rows = corpus.assign_row_ids(df, "k", ranges=7).collect()
    assert sorted((r["k"], int(r["row_id"])) for r in rows) == [(i * i, i) for i in range(5000)]


def test_row_ids_of_text_keys(spark):
    df = spark.createDataFrame([(k,) for k in "delta alpha echo bravo charlie".split()], "k string")
    rows = corpus.assign_row_ids(df, "k", ranges=3).collect()
    assert [r["row_id"] for r in sorted(rows)] == list("01234")


def test_pages(spark):
    rows = [(1, 2, "two"), (1, 1, "one"), (1, 3, " \n"), (1, 4, None), (2, 1, ""), (3, 10, "b"), (3, 9, " a ")]
    df = spark.createDataFrame(rows, "d int, p int, t string")
    got = {r["d"]: r["doc_text"] for r in corpus.assemble_pages(df, "d", "p", "t").collect()}
    assert got == {1: "one\ntwo", 2: "", 3: " a \nb"}


def test_blank_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "i int, t string")
    accepted, rejected = corpus.split_blank(df, "t")
    assert [r["i"] for r in accepted.collect()] == [1]
    assert sorted(r["i"] for r in rejected.collect()) == [2, 3]


def test_decode(spark):
    cases = [
        "é€".encode(),
        b"\x80uro \x93q\x94",
        b"\x81\xe9",
        b"caf\xe9",
        b"",
        None,
        "﻿x".encode(),
        b"\xed\xa0\x80",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, b binary").orderBy("i")
    got = [r[0] for r in df.select(decode_text(F.col("b"))).collect()]
    assert got == ["é€", "€uro “q”", "\x81é", "café", "", "", "﻿x", "í\xa0€"]
    forced = df.select(decode_text(F.col("b"), "utf-8"), decode_text(F.col("b"), "cp1252")).collect()
    assert forced[3][0] == b"caf\xe9".decode("utf-8", "replace")
    assert forced[2][1] == b"\x81\xe9".decode("cp1252", "replace")


def test_text_files(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("né".encode())
    (tmp_path / "w.txt").write_bytes("né".encode("cp1252"))
    rows = files.read_text_files(spark, str(tmp_path)).collect()
    assert [r["doc_text"] for r in rows] == ["né", "né"]


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert artifacts.read_index(spark, path).count() == 0
    rows = [(i, [float(i)], i % 3, "secret") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, cluster_id int, label string")
    artifacts.write_index(df, path)
    back = artifacts.read_index(spark, path)
    assert back.columns == ["doc_id", "embedding", "cluster_id"] and back.count() == 10
    assert "label" not in spark.read.parquet(path).columns
    plan = back.filter("cluster_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan


def test_encoder_name(spark, tmp_path):
    path = str(tmp_path / "name")
    assert artifacts.load_encoder_name(spark, path) == "sentence-transformers/all-mpnet-base-v2"
    artifacts.save_encoder_name(spark, path, "hashing")
    assert artifacts.load_encoder_name(spark, path) == "hashing"
