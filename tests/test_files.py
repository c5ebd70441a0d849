import os

import pytest
from pyspark.sql import Row, functions as F

from inkstone import jobs
from inkstone.sources.files import FilesWriter, checked_name, write_files


def found(path):
    """Content by name, below a folder."""
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs}


def test_a_file_a_row(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(" 漢.txt")).alias("name"), F.when(F.col("id") != 5, F.encode(F.repeat(F.lit("喫"), F.col("id").cast("int")), "UTF-16LE")).alias("data"), F.lit(1).alias("more"))
    write_files(rows.repartition(5), str(tmp_path / "out"))
    assert found(tmp_path / "out") == {f"d{k % 7}/{k} 漢.txt": ("喫" * k).encode("utf-16-le") for k in range(200) if k != 5} | {"_SUCCESS": b""}
    write_files(rows.limit(0), str(tmp_path / "none"))
    assert found(tmp_path / "none") == {"_SUCCESS": b""}


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    (tmp_path / "a").write_text("old")
    good = spark.createDataFrame([(f"n{k}" if k else "a", b"new") for k in range(40)], "name string, data binary").repartition(4)
    for bad in ("../x", None, "/x", "a//b"):
        with pytest.raises(Exception, match="not a name of a file"):
            write_files(good.unionByName(spark.createDataFrame([(bad, b"")], "name string, data binary")), str(tmp_path))
        assert found(tmp_path) == {"a": b"old"} and os.listdir(tmp_path) == ["a"]
    with pytest.raises(ValueError, match="one name, as n1"):
        write_files(good.union(good.where("name = 'n1'")), str(tmp_path))
    write_files(good, str(tmp_path))
    assert found(tmp_path) == {"a": b"new", "_SUCCESS": b""} | {f"n{k}": b"new" for k in range(1, 40)}


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A task that dies within a file, one that ends but is repeated, and the one that counts."""
    writer = FilesWriter(str(tmp_path))

    def dies():
        yield Row(name="x", data=b"whole")
        yield Row(name="y", data=b"half")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.write(iter([Row(name="x", data=b"first")]))
    writer.commit([writer.write(iter([Row(name="x", data=b"second")])), None])
    assert found(tmp_path) == {"x": b"second", "_SUCCESS": b""} and sorted(os.listdir(tmp_path)) == ["_SUCCESS", "x"]
    assert checked_name("a/b") == "a/b"


def test_jobs_write_files_in_a_character_set(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("喫甲".encode("big5"))
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.7")
    for job, names in (("convert", {"a_t2tw.txt", "b_t2tw.pdf", "_SUCCESS"}), ("files", {"a_t2tw.txt", "_SUCCESS"})):
        jobs.main([job, "-i", str(tmp_path / "in"), "-o", str(tmp_path / job), "-c", "t2tw", "--in-enc", "big5", "--out-enc", "big5", "--as-files"], spark)
        got = found(tmp_path / job)
        assert set(got) == names and got["a_t2tw.txt"].decode("big5") == "吃甲"


def test_files_job_with_wide_characters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("喫甲 a".encode("utf-16-le"))
    jobs.main(["files", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", "t2tw", "--in-enc", "utf-16le", "--out-enc", "utf-8", "--as-files"], spark)
    assert found(tmp_path / "out") == {"a_t2tw.txt": "吃甲 a".encode(), "_SUCCESS": b""}
