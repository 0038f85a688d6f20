"""Sources and sinks: files written from the tables' columns into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.sources import readers
from indemna.plans.views import Tables, query

#: Documents of one edition; its text is a file.
BATCH = 50
DAY = "20200101"


@query("source_editions", f"SELECT ({DAY} + batch % 9)::VARCHAR AS effective_on, batch AS seq, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS text_md5 FROM (SELECT *, doc_id // {BATCH} AS batch FROM documents) GROUP BY batch")
def source_editions(t: Tables) -> DataFrame:
    """Whole files, their date and number in their names."""
    rows = t.documents.withColumn("seq", F.floor(F.col("doc_id") / BATCH).cast("long")).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    rows = rows.select("seq", (F.lit(int(DAY)) + F.col("seq") % 9).cast("string").alias("effective_on"), F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
    path = readers.scratch(t.spark, "editions")
    readers.write_editions(rows, path)
    return readers.editions(t.spark, path).select("effective_on", "seq", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def payloads(t: Tables) -> DataFrame:
    """Each document as the answer of a service: XML with two attachments, or an error page."""
    cdata = lambda c: F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))
    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), cdata), "")
    body = F.concat(
        F.lit("<a><행정규칙일련번호>"), F.col("doc_id").cast("string"), F.lit(f"</행정규칙일련번호><시행일자>{DAY}</시행일자><발령일자>"), F.coalesce("lang", F.lit("")), F.lit("</발령일자><별표단위><별표번호>14</별표번호><별표내용>"), cdata(F.lit("x")),
        F.lit("</별표내용></별표단위><별표단위><별표번호>0015</별표번호><별표제목>"), cdata(F.coalesce("source", F.lit(""))), F.lit("</별표제목><별표내용>"), lines, F.lit("</별표내용></별표단위></a>"),
    )
    return t.documents.select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("error "), F.col("doc_id").cast("string"))).otherwise(body).alias("value"))


@query("source_attachments", f"SELECT doc_id AS seq, '{DAY}' AS effective_on, coalesce(lang, '') AS promulgated_on, coalesce(source, '') AS title, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT NULL, NULL, NULL, 'error ' || doc_id, NULL FROM documents WHERE doc_id % 10 = 0")
def source_attachments(t: Tables) -> DataFrame:
    """Payloads from a JSON lines file: the attachment that is asked for, and what is rejected."""
    path = readers.scratch(t.spark, "payloads")
    readers.write_json_lines(payloads(t), path)
    found, rejected = readers.attachments(readers.json_lines(t.spark, path, "value string"), "15")
    found = found.select("seq", "effective_on", "promulgated_on", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return found.unionByName(rejected.select(F.col("value").alias("title")), allowMissingColumns=True)


def lists(t: Tables, rows: DataFrame) -> DataFrame:
    """(seq, name, promulgated_on, status) through files of XML lists of fifty entries."""
    entry = F.concat(F.lit("<law id='1'><일련번호>"), F.col("doc_id").cast("string"), F.lit("</일련번호><이름><![CDATA["), "name", F.lit("]]></이름><발령일자>"), "day", F.lit("</발령일자><상태>"), "status", F.lit("</상태></law>"))
    pages = rows.groupBy(F.floor(F.col("doc_id") / BATCH).alias("page")).agg(F.array_join(F.collect_list(entry), "\n").alias("e"))
    path = readers.scratch(t.spark, "lists")
    pages.select(F.concat(F.lit("<list>"), F.replace("e", F.lit("\n"), F.lit(" ")), F.lit("</list>")).alias("value")).write.text(path)
    fields = {"seq": "일련번호", "name": "이름", "promulgated_on": "발령일자", "status": "상태"}
    return readers.listed(t.spark.read.text(path), "law", fields)


def entries(t: Tables, status: str, shift: int) -> DataFrame:
    day = (F.lit(20000101) + (F.col("doc_id") * 7 + shift) % 1000).cast("string")
    return t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("name"), day.alias("day"), F.lit(status).alias("status"))


@query("source_lists", "SELECT doc_id::VARCHAR AS seq, coalesce(source, '') AS name, (20000101 + doc_id * 7 % 1000)::VARCHAR AS promulgated_on, '현행' AS status FROM documents")
def source_lists(t: Tables) -> DataFrame:
    """The rows of lists in XML."""
    return lists(t, entries(t, "현행", 0))


@query("source_revisions", "SELECT doc_id::VARCHAR AS seq, coalesce(source, '') AS name, CASE WHEN doc_id % 3 = 0 THEN (20000101 + (doc_id * 7 + 5) % 1000)::VARCHAR ELSE (20000101 + doc_id * 7 % 1000)::VARCHAR END AS promulgated_on, CASE WHEN doc_id % 3 = 0 THEN '연혁' ELSE '현행' END AS status FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def source_revisions(t: Tables) -> DataFrame:
    """What stands in the list in force and in that of earlier revisions, each once."""
    return readers.all_revisions(lists(t, entries(t, "현행", 0).where("doc_id % 2 = 0")), lists(t, entries(t, "연혁", 5).where("doc_id % 3 = 0")))


@query("source_code_master", "SELECT upper('p' || p_partkey) AS code, '부품 ' || trim(p_name) AS name, p_type AS english, p_size % 2 = 0 AS complete, upper('p' || p_partkey)[:3] AS category FROM part WHERE p_partkey % 11 <> 0")
def source_code_master(t: Tables) -> DataFrame:
    """A master of codes from a CSV in an old charset; rows without a code go."""
    code = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit(" p"), F.col("p_partkey").cast("string")))
    rows = t.part.select(code.alias("상병기호"), F.concat(F.lit("부품 "), F.trim("p_name")).alias("한글명"), F.col("p_type").alias("영문명"), F.when(F.col("p_size") % 2 == 0, "y").otherwise("N").alias("완전코드구분"))
    path = readers.scratch(t.spark, "codes")
    readers.write_code_master(rows, path)
    out = readers.code_master(t.spark, path, {"code": "상병기호", "name": "한글명", "english": "영문명", "complete": "완전코드구분"})
    return out.withColumn("category", readers.category(F.col("code")))


@query("source_labels", "SELECT doc_id, quality, toxic FROM labels")
def source_labels(t: Tables) -> DataFrame:
    """Labels written as JSON lines and read with a fixed schema."""
    path = readers.scratch(t.spark, "labels")
    readers.write_json_lines(t.labels.select("doc_id", "quality", "toxic"), path)
    return readers.json_lines(t.spark, path, "doc_id long, quality int, toxic int")


@query("source_chosen", "SELECT page, CASE WHEN n = 1 THEN title END AS title, CASE WHEN n = 1 THEN link END AS link, n FROM (SELECT doc_id // 10 AS page, count(*) FILTER (f) AS n, min(title) FILTER (f) AS title, min(link) FILTER (f) AS link FROM (SELECT doc_id, doc_id % 4 = 1 AND contains(source || ' ' || doc_id, '7') AS f, source || ' ' || doc_id AS title, md5(text) AS link FROM documents) GROUP BY 1)")
def source_chosen(t: Tables) -> DataFrame:
    """Of each list of attachments the one with a number and a mark in its title."""
    rows = t.documents.select(F.floor(F.col("doc_id") / 10).cast("long").alias("page"), (F.col("doc_id") % 4).cast("string").alias("number"), F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), F.md5(F.col("text").cast("binary")).alias("link"))
    return readers.chosen_attachments(rows, "page", "1", "7")


@query("source_bodies", "SELECT page_id, CASE WHEN page_id % 6 = 5 THEN NULL ELSE md5('<div>' || html || '</div>') END AS body_md5 FROM pages")
def source_bodies(t: Tables) -> DataFrame:
    """The inside of a container in each page, up to where it closes."""
    open_ = F.when(F.col("page_id") % 6 == 5, "<div>").otherwise("")
    html = F.concat(F.lit('<p>before</p><div id="1" class="a bd-view b"><div>'), "html", F.lit("</div>"), open_, F.lit("</div>"), F.when(F.col("page_id") % 6 == 5, "").otherwise("<div>after</div>"))
    return t.pages.select("page_id", F.md5(readers.html_body(html, "bd-view").cast("binary")).alias("body_md5"))


@query("source_sheets", """SELECT key, n, "first", sheet FROM (SELECT doc_id || '/' || i // 5 AS key, count(*) AS n, arg_min(line, i) AS "first", min(i // 5 + doc_id % 3) AS sheet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY 1)""")
def source_sheets(t: Tables) -> DataFrame:
    """Lines by printed page, and the first sheet that bears it."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("key", F.concat_ws("/", "doc_id", F.floor(F.col("i") / 5)))
    gathered = readers.pages_of_lines(lines, "key", "i", "line")
    sheets = readers.first_sheet(lines.select("key", (F.floor(F.col("i") / 5) + F.col("doc_id") % 3).alias("sheet")), "key", "sheet")
    return gathered.join(sheets, "key").select("key", F.size("lines").cast("long").alias("n"), F.col("lines")[0].alias("first"), "sheet")
