"""Readers of payload files, over splits far smaller than the files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import relational as ra
from paperloom.sources import files, payloads, services
from paperloom.sources.bibtex import read_bibtex

ENTRY = "<entry>\n<id>http://arxiv.org/abs/{i}</id><title>T {i} &amp; more</title>\n<summary>{t}</summary><published>2020-01-02</published><author><name>A</name></author></entry>\n"
BIB = "@article{{k{i},\n title = {{T {i} {{X}} y}},\n year = 20{i:02d},\n note = \"a, b\"{end}\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_feed_of_many_splits_equals_a_plain_parse(spark, small_splits, tmp_path):
    text = "<feed><title>all</title>\n" + "".join(ENTRY.format(i=i, t="é" * (37 * i % 500)) for i in range(60)) + "</feed>\n"
    (tmp_path / "a.xml").write_text(text, encoding="utf-8")
    (tmp_path / "b.xml").write_text(text[: len(text) // 2].replace("/abs/", "/abs/b"), encoding="utf-8")  # ends inside an entry
    (tmp_path / "empty.xml").write_text("")
    got = files.read_feeds(spark, str(tmp_path))
    plain = payloads.arxiv(spark.createDataFrame([((tmp_path / n).read_text(encoding="utf-8"),) for n in ("a.xml", "b.xml")], "xml string"))
    assert _rows(got.drop(*files.PLACE)) == _rows(plain)
    assert files.read_records(spark, str(tmp_path), "<entry>").rdd.getNumPartitions() > 20
    order = [r.arxiv_id for r in got.where(F.col("path").endswith("a.xml")).orderBy(*files.PLACE).collect()]
    assert order == [str(i) for i in range(60)]


def test_first_relevant_composes_both_cuts(spark, small_splits, tmp_path):
    for feed in "xy":
        (tmp_path / f"feed={feed}").mkdir()
        (tmp_path / f"feed={feed}" / "1.xml").write_text("".join(ENTRY.format(i=i, t="s") for i in range(90)))
    r = files.read_feeds(spark, str(tmp_path))
    got = files.first_relevant(r, "feed", F.col("arxiv_id").cast("int") % 3 != 0)
    want = [i for i in range(60) if i % 3][:30]
    for feed in "xy":
        assert sorted(int(x.arxiv_id) for x in got.where(F.col("feed") == feed).collect()) == want
    few = files.first_relevant(r, "feed", F.col("arxiv_id").cast("int") % 30 == 0)
    assert few.count() == 4  # 0 and 30; 60 was not fetched
    assert files.first_relevant(r, "feed", F.lit(None).cast("boolean")).count() == 0


def test_bibtex_of_many_splits_equals_a_plain_parse(spark, small_splits, tmp_path):
    ends = ("\n}", "\r\n}", "\n  }", "\n} trailing words")
    text = "% a remark\n" + "".join(BIB.format(i=i, end=ends[i % 4]) for i in range(50))
    (tmp_path / "a.bib").write_bytes(text.encode())
    got = files.read_bibtex_files(spark, str(tmp_path / "a.bib"))
    plain = read_bibtex(spark.createDataFrame([(text,)], "bibtex string"))
    show = lambda d: d.select("type", "key", F.to_json("fields"), "title", "year", "doi", "arxiv_id")
    assert _rows(show(got)) == _rows(show(plain)) and got.count() == 50
    (tmp_path / "none.bib").write_text("")
    assert files.read_bibtex_files(spark, str(tmp_path / "none.bib")).count() == 0


def test_bibtex_values_of_a_megabyte(spark):
    long = "word " * 200_000
    e = f"@misc{{k,\n title = {{T}},\n abstract = {{{long}{{in}} {long}}},\n note = \"{long}\"\n}}"
    r = read_bibtex(spark.createDataFrame([(e,)], "bibtex string")).first()
    assert r.title == "T" and len(r.fields["abstract"]) == len(f"{long}{{in}} {long}".strip()) and r.fields["note"] == long.strip()


def test_json_lines_keep_their_order(spark, small_splits, tmp_path):
    page = lambda k: json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": f"page {k} " + "z" * (k * 91 % 400), "images": {}}}]}})
    (tmp_path / "d.jsonl").write_text("\n".join(page(k) for k in range(40)) + "\n\n")
    got = services.ocr_pages(files.read_json_lines(spark, str(tmp_path))).first()
    assert [p.split(" ")[1] for p in got.markdown.split("\n\n---\n\n")] == [str(k) for k in range(40)]


def test_open_access_answers(spark):
    p = spark.createDataFrame([(1, "10.1/a", None), (2, None, None), (3, "10.1/c", "own"), (4, "10.1/d", "")], "id long, doi string, pdf_url string")
    f = spark.createDataFrame([("https://doi.org/10.1/A", "", "land"), ("10.1/c", "x", "y"), ("10.1/d", "pdf", None), (None, "n", "n")], "doi string, url_for_pdf string, url string")
    assert dict(payloads.enrich_unpaywall(p, f).select("id", "pdf_url").collect()) == {1: "land", 2: None, 3: "own", 4: "pdf"}
    assert ra.few(payloads.enrich_unpaywall(p.limit(0), f)) == []


def test_fields_of_an_entry_are_found_once(spark):
    """A filter on the title was pushed below the fields, where each of its uses found them anew."""
    from paperloom.sources.bibtex import read_bibtex

    odd = ["@Book{a,\n title={T {x}\n y},\n note={b\\}c},\n url=\"u\"\n \n }\n@misc{b,\n title = {V}\n}", "@a{k,}\n@b{c,\n\n title={t}\n\n}", "@a{k title={x}\n}", "@a{k,\n title={open", "", None, "@a{k,\n title={no\n } end},\n year = 1999\n}\n"]
    df = read_bibtex(spark.createDataFrame([(x,) for x in odd], "bibtex string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    got = sorted((r["type"], r["key"], r["title"], r["fields"].get("note"), r["fields"].get("url")) for r in df.collect())
    assert got == [("a", "k", "no", None, None), ("a", "k", "t", None, None), ("book", "a", "T {x}\n y", "b\\", "u"), ("misc", "b", "V", None, None)]
