import json

import pytest

from sieveline.operators import constraints as C
from sieveline.sources import files, sinks
from sieveline.streaming import incremental


def test_labels_and_lists(spark, tmp_path):
    d = tmp_path / "labels"
    d.mkdir()
    (d / "7.txt").write_text("0 .5 .5 .1 .2\nbad line\n 2.0  .1 .2 .3 .4 \n")
    (d / "8.txt").write_text("")
    (d / "x.txt").write_text("0 1 1 1 1")
    got = sorted(tuple(r) for r in files.labels(spark, f"file://{d}").collect())
    assert got == [(7, 0, 0, 0.5, 0.5, 0.1, 0.2), (7, 2, 2, 0.1, 0.2, 0.3, 0.4)]
    assert {(r.id, r.ext) for r in files.listing(spark, f"file://{d}").collect()} == {(7, "txt"), (8, "txt")}
    (tmp_path / "ids").write_text("3 1\n\n2\n")
    assert sorted(r.id for r in files.ids(spark, f"file://{tmp_path}/ids", unique=True).collect()) == [1, 2, 3]
    assert sorted(r.bytes for r in files.manifest(spark, f"file://{d}").collect()) == [0, 9, 42]
    (tmp_path / "p.json").write_text(json.dumps({"e1": {"train": [1, 2], "test": [3]}}))
    parts = files.partitions(spark, f"file://{tmp_path}/p.json")
    assert sinks.datasets(parts, f"file://{tmp_path}/ds") == {("e1", "train"): 2, ("e1", "test"): 1}
    sinks.id_list(parts, f"file://{tmp_path}/out")
    assert sorted(r.id for r in files.ids(spark, f"file://{tmp_path}/out").collect()) == [1, 2, 3]
    sinks.csv(parts, f"file://{tmp_path}/csv")
    assert files.csv(spark, f"file://{tmp_path}/csv", "dataset string, split string, id long").count() == 3
    sinks.macros(spark.createDataFrame([("b", None), ("a", "1")], "name string, value string"), f"file://{tmp_path}/tex")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/tex").collect()] == ["\\newcommand{\\a}{1}", "\\newcommand{\\b}{??}"]


def test_constraints(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    got = {r.name: r.violations for r in C.report({"missing": C.missing(a, b, "id"), "shared": C.shared(a, b, "id"), "different": C.different(a, b, "id"), "repeated": C.repeated(a, "id"), "sized": C.sized(a, 3)}).collect()}
    assert got == {"missing": 1, "shared": 1, "different": 2, "repeated": 1, "sized": 0}


def test_incremental_equals_all_at_once(spark, tmp_path):
    rows = [(i, (i * 2654435761) % (1 << 40) & ~(i % 4)) for i in range(60)] + [(100 + i, i) for i in range(12)]
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], "id long, sig long").coalesce(1).write.mode("append").parquet(f"file://{src}")
    stream = spark.readStream.schema("id long, sig long").option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = incremental.run(stream, f"file://{tmp_path}/state", most=3)
    q.awaitTermination(120)
    got = {(r.a, r.b) for r in spark.read.parquet(f"file://{tmp_path}/state/pairs").collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 3}


def test_what_readers_reject(spark, tmp_path):
    (tmp_path / "1.txt").write_text("0 .5 .5 .1 .2\n1 2 3\n")
    with pytest.raises(Exception, match="malformed label line of item 1"):
        files.labels(spark, f"file://{tmp_path}/1.txt", strict=True).collect()
    (tmp_path / "ids").write_text("3 1 3")
    with pytest.raises(ValueError, match="more than once"):
        files.ids(spark, f"file://{tmp_path}/ids", unique=True)
    df = spark.createDataFrame([("a", "s", 1), ("a", "s", 2)], "dataset string, split string, id long")
    sinks.checked_datasets(df, f"file://{tmp_path}/ds")
    there = spark.createDataFrame([(1, "x")], "id long, v string")
    assert C.looked_up(df, there, "id").where("id = 1").first().v == "x"
    with pytest.raises(Exception, match="no row for id 2"):
        C.looked_up(df, there, "id").collect()


def test_json_and_directories(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a": 1, "b": [1, 2]}, indent=1))
    assert tuple(files.json(spark, f"file://{tmp_path}/r.json").first()) == (1, [1, 2])
    for split, ids in (("train", (1, 2)), ("test", (3,))):
        (tmp_path / "labels" / split).mkdir(parents=True)
        for i in ids:
            (tmp_path / "labels" / split / f"{i}.txt").write_text("0")
    assert sorted(map(tuple, files.split_of_directories(spark, f"file://{tmp_path}/labels").collect())) == [(1, "train"), (2, "train"), (3, "test")]
    (tmp_path / "s.csv").write_text(" a, b \n1,x\n")
    df = files.csv(spark, f"file://{tmp_path}/s.csv")
    assert df.columns == ["a", "b"] and df.dtypes == [("a", "string"), ("b", "string")] and tuple(df.first()) == ("1", "x")


def test_manifest_with_empty_files(spark, tmp_path):
    """Sizes and digests of all files, and the four kinds of difference."""
    import hashlib

    for name, content in (("a/1.txt", b"one"), ("a/2.txt", b""), ("b/3.txt", b"three"), ("b/4.txt", b"4")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(content)
    found = files.manifest(spark, f"file://{tmp_path}/tree")
    short = {r.path.rsplit("/tree/", 1)[1]: (r.bytes, r.digest) for r in found.collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert short == {"a/1.txt": (3, sha(b"one")), "a/2.txt": (0, sha(b"")), "b/3.txt": (5, sha(b"three")), "b/4.txt": (1, sha(b"4"))}
    want = spark.createDataFrame([("a/1.txt", 3, sha(b"0ne"), 1), ("a/2.txt", 0, sha(b""), 1), ("b/3.txt", 9, sha(b"three"), 1), ("c/5.txt", 1, "", 1)], "path string, bytes long, digest string, __x int")
    own = spark.createDataFrame([(p, *v) for p, v in short.items()], "path string, bytes long, digest string")
    assert {tuple(r) for r in files.compared(own, want).collect()} == {("a/1.txt", "digest"), ("b/3.txt", "size"), ("b/4.txt", "extra"), ("c/5.txt", "missing")}
    assert files.compared(own, own).collect() == []


def test_a_missing_json_document(spark, tmp_path):
    (tmp_path / "x.json").write_text('[\n {"a": 1},\n {"a": null}]')
    assert [r.a for r in files.json_or_null(spark, f"file://{tmp_path}/x.json", "a int, b string").collect()] == [1, None]
    assert [tuple(r) for r in files.json_or_null(spark, f"file://{tmp_path}/none.json", "a int, b string").collect()] == [(None, None)]


def test_saved_ids_that_were_spoilt(spark):
    """The check against saved lists finds ids that are missing, added or in another part."""
    from sieveline.plans.design import saved_differences

    split = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val"), (4, "test")], "id long, split string")
    assert saved_differences(spark, split, split).collect() == []
    spoilt = spark.createDataFrame([(1, "train"), (2, "val"), (3, "val"), (5, "test")], "id long, split string")
    assert sorted(r.id for r in saved_differences(spark, spoilt, split).collect()) == [2, 2, 4, 5]
