from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import structure as st


def test_prepare():
    md = "My Paper\nAnn^{1}, Bob^{2}\n# Introduction\ntext\n# My Paper\n## II. Method\n### 2.1 Data\n#### B. Parts\n## Other thing\n---\nend"
    assert st.prepare(md, "My paper") == "## Introduction\ntext\n## II. Method\n### 2.1 Data\n### B. Parts\n### Other thing\n\nend"
    assert [st.numbered_depth(x) for x in ("3 Model", "3.1.2 Model", "I. Introduction", "V. Thing", "Thing")] == [2, 4, 2, 3, None]


def test_references():
    assert st.number_references("# References\n[4] First one.\n\nSecond\nline.\n# Next").split("\n") == ["# References", "", "1. First one.", "2. Second line.", "# Next"]
    assert st.number_references("# References\n7. Alpha x. 9. Beta y.").endswith("1. Alpha x.\n2. Beta y.")
    assert st.number_references("no section") == "no section"


def test_front_matter():
    md = "Title\nAnn Lee^{1,2}, Bob Ray^{2}\n1 First Lab\n$^{2}$ Second Lab\n# Abstract\n3 Not one"
    assert st.affiliations(md, "Title") == [(1, "First Lab"), (2, "Second Lab")] and st.author_markers(md) == [("Ann Lee", [1, 2]), ("Bob Ray", [2])]
    assert (2, "Li Lab") in st.affiliations("Zhao$^{1}$, CAS, $^{2}$Li Lab, x", "t")


def test_binding(spark):
    good = "![a](x.png)\n\nFigure 1: A.\n\nTable I: T.\n\n<table><tr><td>1</td></tr></table>\n\n![b](y.png)\n\n**Figure 2.** B."
    found, review = st.bind(good)
    assert [(o.id, o.caption_number, o.ambiguous) for o in found] == [("figure-001", 1, False), ("table-001", 1, False), ("figure-002", 2, False)] and review == []
    assert st.bind("![a](x.png)")[1] == ["figure-001"] and st.bind("Figure 3: x")[1] == ["caption-001"]
    assert st.bind("![a](x.png)\n\nFigure 2: gap.")[1] == ["figure-001"]
    side = "![](assets/page-1-0-img_in_image_box_10_50_1_1.jpg)\n![](assets/page-1-1-img_in_image_box_400_60_1_1.jpg)\n\nFigure 1: Two."
    assert len(st.objects(side)) == 1 and st.bind(side)[1] == []
    assert [st.number_value(x) for x in ("XIV", "$IX$", "12")] == [14, 9, 12]
    df = spark.createDataFrame([(1, good), (2, None)], "id long, markdown string")
    assert st.bind_documents(df).count() == 3
    assert df.select(st.table_signature(F.col("markdown")).alias("s")).first()["s"] == "1:1:0:0:0"


def test_institutions(spark):
    names = spark.createDataFrame([("MIT",), ("Nowhere",)], "original string")
    alias = spark.createDataFrame([("M.I.T.", "Massachusetts Institute of Technology", "麻省理工学院")], "original string, canonical_en string, name_zh string")
    got = {r["original"]: (r["canonical_en"], r["confidence"]) for r in st.resolve_institutions(names, alias).collect()}
    assert got == {"MIT": ("Massachusetts Institute of Technology", 1.0), "Nowhere": ("Nowhere", 0.0)}
