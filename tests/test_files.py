"""Readers and sinks on files that the tests make."""

from __future__ import annotations

import io
import zipfile

import pytest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str, styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
    return out.getvalue()


def p(text: str, pr: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


TABLE = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (("错误", "正确", "类别"), ("甲乙", "甲丙", "字"), ("同", "同", ""))) + "</w:tbl>"


def test_docx_blocks_in_order():
    from lexmill.sources.office import docx_blocks

    styles = '<w:style w:styleId="a"><w:name w:val="heading 2"/></w:style><w:style w:styleId="b"><w:name w:val="own"/><w:basedOn w:val="a"/></w:style><w:style w:styleId="c"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>'
    body = p("One", '<w:pStyle w:val="c"/>') + p("Two", '<w:pStyle w:val="b"/>') + p("text") + p("") + TABLE + p("item", "<w:numPr/>") + p("Three", '<w:outlineLvl w:val="2"/>')
    got = docx_blocks(docx(body, styles))
    assert [(k, n, t) for k, n, t, _ in got if k != "table"] == [("heading", 1, "One"), ("heading", 2, "Two"), ("paragraph", 0, "text"), ("list", 0, "item"), ("heading", 3, "Three")]
    assert got[3][0] == "table" and got[3][3][1] == ["甲乙", "甲丙", "字"]
    with pytest.raises(ValueError, match="document type"):
        docx_blocks(docx("<!ENTITY x 'y'>"))


def test_workbooks_round_trip(spark):
    from lexmill.sources.office import xlsx_sheets
    from lexmill.sources.sinks import workbook, workbook_of

    data = workbook([("A & B", ["x", "y"], [["007", 1.5], [None, "<tag>"]]), ("二", ["z"], [])])
    assert xlsx_sheets(data) == [("A & B", [["x", "y"], ["007", "1.5"], ["", "<tag>"]]), ("二", [["z"]])]
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert xlsx_sheets(workbook_of({"t": df.orderBy("id")})) == [("t", [["id", "name"], ["1", "a"], ["2"]])]


def test_workbook_limits(monkeypatch):
    from lexmill.sources import office, sinks

    data = sinks.workbook([("s", [f"c{i}" for i in range(20)], [])])
    monkeypatch.setattr(office, "COLUMNS", 10)
    with pytest.raises(ValueError, match="limits"):
        office.xlsx_sheets(data)
    monkeypatch.setattr(office, "MEMBER_BYTES", 10)
    with pytest.raises(ValueError, match="limits"):
        office.xlsx_sheets(data)


def test_word_lists(spark, tmp_path):
    from lexmill.sources.office import read_words
    from lexmill.sources.sinks import workbook

    (tmp_path / "a.json").write_text('{"error_pairs": [{"wrong": "a1", "correct": "b1", "confidence": 3}, {"wrong": "x", "correct": "x"}, 5], "terms": [{"正确": "标准", "aliases": "别一，别二"}], "words": [{"词": "专名"}]}')
    (tmp_path / "b.tbx").write_text('<?xml version="1.0" encoding="UTF-8"?><martif xmlns="urn:x"><termEntry><langSet><tig><term>碳达峰</term></tig><tig><term>碳峰</term></tig></langSet><langSet><tig><term>carbon peak</term></tig></langSet></termEntry></martif>')
    (tmp_path / "c.xlf").write_text('<xliff xmlns="urn:y"><trans-unit><source>旧名</source><target>新名</target></trans-unit><trans-unit><source>old</source><target>新</target></trans-unit></xliff>')
    (tmp_path / "d.xlsx").write_bytes(workbook([("s", ["Wrong", "correct", "note"], [["teh", "the", 1]])]))
    (tmp_path / "e.docx").write_bytes(docx(p("intro") + TABLE))
    (tmp_path / "f.json").write_text("{broken")
    (tmp_path / "g.xlsx").write_bytes(b"no zip")
    got = {(r["name"], r["role"], r["wrong"], r["correct"], r["word"]) for r in read_words(spark, str(tmp_path)).where("error is null").collect()}
    assert got == {
        ("a.json", "pairs", "a1", "b1", None), ("a.json", "terms", "别一", "标准", None), ("a.json", "terms", "别二", "标准", None), ("a.json", "protect", None, None, "专名"),
        ("b.tbx", "terms", "碳峰", "碳达峰", None), ("c.xlf", "terms", "旧名", "新名", None), ("d.xlsx", "pairs", "teh", "the", None), ("e.docx", "pairs", "甲乙", "甲丙", None),
    }
    assert {r["name"] for r in read_words(spark, str(tmp_path)).where("error is not null").collect()} == {"f.json", "g.xlsx"}


def test_files_of_a_folder_and_sinks(spark, tmp_path):
    from lexmill.sources.parsers import read_files, read_word_list
    from lexmill.sources.sinks import write_csv, write_package, write_rules

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx(p("Title", '<w:outlineLvl w:val="0"/>') + p("body")))
    (folder / "b.txt").write_bytes("标题\n正文".encode("gb18030"))
    (folder / "c.docx").write_bytes(b"broken")
    got = {r["name"]: (r["ok"], r["title"], len(r["blocks"])) for r in read_files(spark, str(folder)).collect()}
    assert got["a.docx"] == (True, "Title", 2) and got["b.txt"][0] and not got["c.docx"][0]
    df = spark.createDataFrame([("=1+1", "-5"), ("@x", "plain")], "a string, b string")
    write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == [("'=1+1", "-5"), ("'@x", "plain")]
    pairs = spark.createDataFrame([("a", "b", "c", 0.5, True), ("d", "e", "f", 0.5, False)], "wrong string, correct string, category string, confidence double, enabled boolean").coalesce(1)
    write_rules(pairs, str(tmp_path / "rules"))
    assert [(r["wrong"], r["correct"], r["confidence"]) for r in read_word_list(spark, str(tmp_path / "rules")).collect()] == [("a", "b", 0.5)]
    docs = spark.createDataFrame([(1, "t", "text"), (2, "u", "")], "id long, title string, content string")
    assert {(r["id"], r["bytes"]) for r in write_package(docs, str(tmp_path / "pack")).collect()} == {(1, 4), (2, 0)}
