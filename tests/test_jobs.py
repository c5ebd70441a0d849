import pytest
from test_reflow import members, packed

from inkstone import jobs
from inkstone.sources.dictionaries import example_slots, read_bundle


def test_files_job(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("喫", "utf-8")
    (source / "b.odt").write_bytes(packed({"content.xml": "<p>喫</p>"}))
    (source / "c.odt").write_bytes(b"no")
    (source / "d.bin").write_bytes(b"\0\1")
    (source / "e.pdf").write_bytes(b"%PDF-1.7")
    jobs.main(["files", "-i", str(source), "-o", str(tmp_path / "out"), "-c", "T2TW"], spark)
    rows = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r["success"] for k, r in rows.items()} == {"a_t2tw.txt": True, "b_t2tw.odt": True, "c_t2tw.odt": False, "d_t2tw.bin": False, "e_t2tw.pdf": False}
    assert bytes(rows["a_t2tw.txt"]["data"]).decode() == "吃" and members(rows["b_t2tw.odt"]["data"])[0]["content.xml"] == "<p>吃</p>"
    assert rows["d_t2tw.bin"]["data"] is None and "PDF" in rows["e_t2tw.pdf"]["message"]


def test_convert_job_with_character_sets_and_own_dictionary(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("漢字甲".encode("big5"))
    (tmp_path / "own.txt").write_text("甲\t乙\n", "utf-8")
    jobs.main(["convert", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", "t2tw", "--in-enc", "cp950", "--out-enc", "cp936", "-D", f"tw_variants:append:{tmp_path / 'own.txt'}"], spark)
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first()["data"]).decode("gbk") == "漢字乙"


def test_pages_job(spark, tmp_path):
    spark.createDataFrame([(1, ["他走進房間以後看見了那封\n桌上放著的從遠方來的信", "然後坐下來慢慢地喫了飯。"]), (2, None)], "k int, pages array<string>").write.parquet(str(tmp_path / "in"))
    jobs.main(["pages", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", "t2tw", "-r"], spark)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("k").collect()] == ["他走進房間以後看見了那封桌上放著的從遠方來的信然後坐下來慢慢地吃了飯。", None]
    with pytest.raises(SystemExit):
        jobs.main(["pages", "-i", "x", "-o", "y"], spark)
    with pytest.raises(SystemExit):
        jobs.main(["convert", "-i", "x", "-o", "y", "-c", "nope"], spark)


def test_dictgen_job(tmp_path):
    (tmp_path / "tw_variants.txt").write_text("# no\n喫\t吃\n", "utf-8")
    jobs.main(["dictgen", "-f", str(tmp_path), "-o", str(tmp_path / "out.json"), "-c"])
    assert read_bundle((tmp_path / "out.json").read_text("utf-8")) == {"tw_variants": {"喫": "吃"}} and "tw_variants" in example_slots()


def test_convert_chain_and_usual_names(spark, tmp_path):
    """The options before and after a conversion, and dictionaries of a folder."""
    import json

    import pytest

    from inkstone import jobs
    from inkstone.sources.dictionaries import OPTIONAL_FILES, SLOTS, file_name

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("豈丁q", "utf-8")
    (tmp_path / "dicts").mkdir()
    for s in SLOTS:
        if s not in OPTIONAL_FILES:
            (tmp_path / "dicts" / file_name(s)).write_text("丁\t\U0002003e\n" if s == "tw_variants" else "", "utf-8")
    for name, text in (("compat", "豈\t丁\n"), ("rare", "\U0002003e\tz\tExtB\n"), ("own", "q\tr\n")):
        (tmp_path / name).write_text(text, "utf-8")
    path = lambda n: str(tmp_path / n)
    base = ["convert", "-i", path("in"), "-c", "t2tw", "-d", path("dicts")]
    for k, (options, expected) in enumerate((([], "豈\U0002003eq"), (["-n", path("compat")], "\U0002003e\U0002003eq"), (["-n", path("compat"), "--detofu", "all", "--detofu-table", path("rare"), "--detofu-file", path("own")], "zzr"), (["--detofu", "ExtC", "--detofu-table", path("rare")], "豈\U0002003eq"))):
        jobs.main([*base, *options, "-o", path(f"out{k}")], spark)
        assert spark.read.parquet(path(f"out{k}")).first()["data"].decode() == expected
    for bad in (["--detofu", "ExtZ"], ["--detofu-file", path("own")]):
        with pytest.raises(SystemExit):
            jobs.main([*base, *bad, "-o", path("none")], spark)
    jobs.main(["dictgen", "-f", path("dicts"), "-o", path("bundle.json")])
    assert json.loads((tmp_path / "bundle.json").read_text("utf-8"))["tw_variants"][0] == {"丁": "\U0002003e"}
