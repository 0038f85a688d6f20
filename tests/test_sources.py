"""Sources and sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from indemna.sources import contracts, readers

XML = "<법령><행정규칙일련번호>12</행정규칙일련번호><시행일자>20200101</시행일자><발령일자>20191201</발령일자><별표단위><별표번호>14</별표번호><별표제목><![CDATA[다른 표]]></별표제목><별표내용><![CDATA[x]]></별표내용></별표단위><별표단위><별표번호>0015</별표번호><별표제목><![CDATA[표준약관]]></별표제목><별표내용><![CDATA[첫 줄]]><![CDATA[둘째 줄]]></별표내용></별표단위></법령>"


def test_editions(spark, tmp_path):
    (tmp_path / "20200101_12.txt").write_text("한 줄\n둘")
    (tmp_path / "notes.md").write_text("x")
    rows = readers.editions(spark, str(tmp_path)).collect()
    assert [(r.effective_on, r.seq, r.text) for r in rows] == [("20200101", 12, "한 줄\n둘")]


def test_attachments(spark):
    found, rejected = readers.attachments(spark.createDataFrame([(XML,), ("error page",), ("<a/>",)], "value string"), "15")
    r = found.first()
    assert (r.seq, r.effective_on, r.promulgated_on, r.title, r.text) == (12, "20200101", "20191201", "표준약관", "첫 줄\n둘째 줄")
    assert sorted(x.value for x in rejected.collect()) == ["<a/>", "error page"] and found.count() == 1


def test_lists(spark):
    raw = spark.createDataFrame([("<l><law id='1'><seq>1</seq><name><![CDATA[가]]></name><on>2019</on></law><law id='2'><seq>2</seq><name>가</name><on>2020</on></law></l>",)], "value string")
    rows = readers.listed(raw, "law", {"seq": "seq", "name": "name", "promulgated_on": "on"})
    assert [tuple(r) for r in rows.orderBy("seq").collect()] == [("1", "가", "2019"), ("2", "가", "2020")]
    later = spark.createDataFrame([("2", "가", "2021"), ("3", "나", "2022")], rows.schema)
    assert [tuple(r) for r in readers.all_revisions(rows, later, "가").collect()] == [("2", "가", "2021"), ("1", "가", "2019")]


def test_chosen_attachment(spark):
    rows = spark.createDataFrame([("15", "표준약관", "a"), ("15", "서식", "b"), ("16", "표준약관", "c")], "number string, title string, link string")
    assert readers.chosen_attachment(rows, "15", "표준").first().link == "a"
    with pytest.raises(ValueError, match="0 attachments"):
        readers.chosen_attachment(rows, "17", "표준")


def test_code_master(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_bytes("상병기호,한글명,영문명,완전코드구분\n a00 ,콜레라,Cholera,y\n,빈 코드,none,N\nA010,장티푸스,Typhoid,N\n".encode("cp949"))
    names = {"code": "상병기호", "name": "한글명", "english": "영문명", "complete": "완전코드구분"}
    rows = readers.code_master(spark, str(path), names)
    assert [tuple(r) for r in rows.orderBy("code").collect()] == [("A00", "콜레라", "Cholera", True), ("A010", "장티푸스", "Typhoid", False)]
    assert rows.select(readers.category(F.col("code"))).distinct().count() == 2
    with pytest.raises(ValueError, match="lacks 없음"):
        readers.code_master(spark, str(path), names | {"name": "없음"})


def test_contract(spark):
    rows = spark.range(3)
    assert tuple(contracts.row_count(rows, "r", 3).first()) == ("r", 3, 3, True)
    assert contracts.row_count(rows, "r", 4).first().ok is False and contracts.row_count(rows.limit(0), "r").first().ok is False


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, label string")
    readers.write_json_lines(rows, str(tmp_path / "x"))
    assert sorted(map(tuple, readers.json_lines(spark, str(tmp_path / "x"), "id long, label string").collect())) == [(1, "a"), (2, None)]


def test_html(spark):
    html = '<div class="bd-view x">하나<div>둘</div>셋</div><div>밖</div>'
    df = spark.createDataFrame([(html,), ('<div class="bd-view">열림',), (None,)], "h string").select(readers.html_body(F.col("h"), "bd-view").alias("b"))
    assert [r.b for r in df.collect()] == ["하나<div>둘</div>셋", None, None]
    rows = readers.html_rows(spark.createDataFrame([('<tr><th>no</th></tr><tr><td>1</td><td><a href="/v?id=3">제 목</a></td></tr>',)], "h string"), "h", 2)
    assert [(r.cells, r.href) for r in rows.collect()] == [(["1", "제 목"], "/v?id=3")]


def test_pages(spark):
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "page int, pos int, line string")
    assert {r.page: r.lines for r in readers.pages_of_lines(lines, "page", "pos", "line").collect()} == {1: ["a", "b"], 2: ["c"]}
    sheets = spark.createDataFrame([(7, 3), (7, 2), (None, 1)], "printed int, sheet int")
    assert [tuple(r) for r in readers.first_sheet(sheets, "printed", "sheet").collect()] == [(7, 2)]
