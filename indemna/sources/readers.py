"""Sources and sinks of terms, lists, masters and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.sources.contracts import require_columns


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/indemna-{name}-{uuid.uuid4().hex}"


def editions(spark: SparkSession, path: str) -> DataFrame:
    """(effective_on, seq, text) of whole files named ``<effective>_<seq>.txt``; others go. A folder with such a name, as
    ``write_editions`` makes them, stands for the one file in it."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    form = "(?:/|=)([0-9]{8})_([0-9]+)[.]txt(?:/[^/]*)?$"
    return rows.where(F.rlike("name", F.lit(form))).select(F.regexp_extract("name", form, 1).alias("effective_on"), F.regexp_extract("name", form, 2).cast("long").alias("seq"), "text")


def write_editions(rows: DataFrame, path: str) -> None:
    """Writes each text of ``rows`` (effective_on, seq, text) as a folder ``<effective>_<seq>.txt`` with one file."""
    rows.select(F.concat("effective_on", F.lit("_"), F.col("seq").cast("string"), F.lit(".txt")).alias("edition"), "text").repartition("edition").write.partitionBy("edition").text(path)


def _tag(xml: Column, name: str) -> Column:
    inner = F.regexp_extract(xml, f"(?s)<{name}(?: [^>]*)?>(.*?)</{name}>", 1)
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(inner, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", 1), F.lit("")), inner))


def attachments(raw: DataFrame, number: str, xml: str = "value") -> tuple[DataFrame, DataFrame]:
    """(editions, rejected): of each payload the attachment block with a number, its CDATA parts joined by newlines,
    with seq, dates and title. Payloads that aren't XML or lack the block are rejected whole."""
    blocks = F.filter(F.regexp_extract_all(xml, F.lit("(?s)<별표단위[^>]*>(.*?)</별표단위>"), F.lit(1)), lambda b: F.ltrim(F.regexp_extract(b, "(?s)<별표번호>\\s*(?:<!\\[CDATA\\[)?\\s*0*([0-9]+)", 1)) == number)
    rows = raw.withColumn("block", F.get(blocks, 0))
    ok = F.rlike(F.ltrim(xml), F.lit("^<")) & F.col("block").isNotNull()
    content = F.regexp_extract("block", "(?s)<별표내용>(.*?)</별표내용>", 1)
    text = F.array_join(F.regexp_extract_all(content, F.lit("(?s)<!\\[CDATA\\[(.*?)\\]\\]>"), F.lit(1)), "\n")
    found = rows.where(ok).select(
        _tag(F.col(xml), "행정규칙일련번호").cast("long").alias("seq"),
        _tag(F.col(xml), "시행일자").alias("effective_on"),
        _tag(F.col(xml), "발령일자").alias("promulgated_on"),
        _tag(F.col("block"), "별표제목").alias("title"),
        text.alias("text"),
    )
    return found, raw.join(rows.where(ok).select(xml), xml, "left_anti")


def listed(raw: DataFrame, tag: str, fields: dict[str, str], xml: str = "value") -> DataFrame:
    """One row for each ``tag`` element of the payloads, its child elements as columns ``{column: element}``."""
    rows = raw.select(F.explode(F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))).alias("e"))
    return rows.select(*[_tag(F.col("e"), element).alias(column) for column, element in fields.items()])


def all_revisions(current: DataFrame, history: DataFrame, name: str | None = None) -> DataFrame:
    """Both lists (seq, name, promulgated_on) for one name, or for all, each seq once (the second list wins), newest first."""
    both = current.withColumn("list", F.lit(0)).unionByName(history.withColumn("list", F.lit(1)))
    both = both if name is None else both.where(F.col("name") == name)
    last = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("list")))
    return both.withColumn("n", last).where("n = 1").drop("n", "list").orderBy(F.desc("promulgated_on"), F.desc("seq"))


def chosen_attachment(rows: DataFrame, number: str, marker: str) -> DataFrame:
    """The one attachment (number, title, link) with this number and marker in its title; none or several are an error."""
    found = rows.where((F.col("number") == number) & F.contains("title", F.lit(marker)))
    n = found.count()
    if n != 1:
        raise ValueError(f"{n} attachments have the number {number} and {marker} in their title")
    return found


def chosen_attachments(rows: DataFrame, by: str, number: str, marker: str) -> DataFrame:
    """(by, title, link, n): the same for many lists at once; title and link are null, and n tells why, where a list hasn't exactly one."""
    fits = (F.col("number") == number) & F.contains("title", F.lit(marker))
    told = rows.groupBy(by).agg(F.count_if(fits).alias("n"), F.min(F.when(fits, F.struct("title", "link"))).alias("one"))
    return told.select(by, F.when(F.col("n") == 1, F.col("one.title")).alias("title"), F.when(F.col("n") == 1, F.col("one.link")).alias("link"), "n")


def write_code_master(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` as a CSV with headings in the charset MS949."""
    rows.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows.write.option("encoding", "MS949").option("header", "true").csv(path)


def code_master(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(code, name, english, complete) from a CSV in the charset MS949; ``columns`` names its headings.

    Codes are trimmed and upper-cased, rows without a code go; complete is Y in either case."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = require_columns(spark.read.csv(path, header=True, encoding="MS949"), *columns.values())
    text = lambda c: F.trim(F.coalesce(F.col(columns[c]), F.lit("")))
    out = rows.select(F.upper(text("code")).alias("code"), text("name").alias("name"), text("english").alias("english"), (F.upper(text("complete")) == "Y").alias("complete"))
    return out.where("code <> ''")


def category(code: Column) -> Column:
    """The first three letters and digits of a code."""
    return F.substring(F.regexp_replace(F.upper(F.trim(code)), "[^A-Z0-9]", ""), 1, 3)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file with a fixed schema; malformed lines are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def html_body(html: Column, class_: str) -> Column:
    """The inside of the first ``<div>`` of a class, up to where its depth is 0 again; null where it doesn't close."""
    rest = F.regexp_extract(html, f'(?s)<div[^>]*class="[^"]*{class_}[^"]*"[^>]*>(.*)$', 1)
    parts = F.split(F.regexp_replace(rest, "(?i)(</?div\\b[^>]*>)", "\x1e$1\x1f"), "\x1e")
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))

    def step(a: Column, part: Column) -> Column:
        tag = F.when(F.contains(part, F.lit("\x1f")), F.lower(F.substring_index(part, "\x1f", 1)))
        depth = a["depth"] + F.when(F.startswith(tag, F.lit("</")), -1).when(tag.isNotNull(), 1).otherwise(0)
        grown = F.when(depth > 0, F.concat(a["text"], F.replace(part, F.lit("\x1f"), F.lit("")))).otherwise(a["text"])
        return F.when(a["depth"] <= 0, a).otherwise(F.struct(depth.alias("depth"), grown.alias("text")))

    end = F.aggregate(parts, start, step)
    return F.when(end["depth"] == 0, end["text"])


def html_rows(pages: DataFrame, html: str, columns: int) -> DataFrame:
    """(cells, href): the rows of a list table with this many cells, and the first link in each."""
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit("(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit("(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " ")))
    return rows.select(cells.alias("cells"), F.regexp_extract("r", 'href="([^"]*)"', 1).alias("href")).where(F.size("cells") == columns)


def pages_of_lines(lines: DataFrame, page: str, order: str, line: str) -> DataFrame:
    """(page, lines): the lines of each page in order."""
    return lines.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]).alias("lines"))


def first_sheet(sheets: DataFrame, printed: str, sheet: str) -> DataFrame:
    """(printed, sheet): the first sheet that bears a printed page number."""
    return sheets.where(F.col(printed).isNotNull()).groupBy(printed).agg(F.min(sheet).alias(sheet))
