"""What receipts and questions say of institutions and co-payments, and checks of codes from models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of institutions on receipts, by the name that the rules use.
INSTITUTIONS = {
    "상급종합병원": "상급종합병원", "종합병원": "종합병원", "전문요양기관": "전문요양기관", "병원급": "병원급", "요양병원": "요양병원", "정신병원": "정신병원",
    "치과병원": "치과병원", "한방병원": "한방병원", "의원": "의원", "의원급": "의원", "의원급보건기관": "의원", "치과의원": "치과의원", "한의원": "한의원",
    "보건기관": "보건기관", "보건소": "보건기관", "보건지소": "보건기관", "보건진료소": "보건기관", "보건의료원": "보건기관",
}
#: A rate right after the word for co-payment, as a percentage or as a ratio; words of pregnancy.
COPAY = "(?:본인|환자)\\s*부담[^0-9]{0,10}?(?:([0-9]{1,3}(?:[.][0-9]+)?)\\s*(?:%|퍼센트|프로)|(0[.][0-9]+|1[.]0+)(?![0-9.,]|\\s*(?:%|퍼센트|프로)))"
PREGNANCY = "임신|임부|산모|분만|출산|태반|태아"


def _vocabulary() -> Column:
    return F.create_map(*[F.lit(x) for pair in INSTITUTIONS.items() for x in pair])


def institution(raw: Column) -> Column:
    """struct(institution, rejected): the known kind of institution; blank or only signs count as not given, any other
    value is rejected. The text should be in NFKC."""
    key = F.regexp_replace(raw, "[\\s·ㆍᆞ・‧]+", "")
    blank = (key == "") | F.rlike(key, F.lit("^[\\[\\]()/|\"'.,;-]+$"))
    found = F.when(~blank, F.try_element_at(_vocabulary(), key))
    return F.struct(found.alias("institution"), F.coalesce(~blank & found.isNull(), F.lit(False)).alias("rejected"))


def _spaced(name: str) -> str:
    for word in ("병원", "종합", "요양", "기관"):
        name = name[:1] + name[1:].replace(word, f"\\s*{word}")
    name = name.replace("치과의원", "치과\\s*의원")
    return f"(?:(?<![가-힣])|(?<=과)){name}" if name.startswith("의원") else name


def institutions_in(text: Column) -> Column:
    """Kinds of institutions that a text mentions, longest names first, blanks between their words allowed."""
    pattern = "|".join(_spaced(n) for n in sorted(INSTITUTIONS, key=len, reverse=True))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.try_element_at(_vocabulary(), F.regexp_replace(x, "\\s+", "")))
    return F.array_sort(F.array_distinct(found))


def copay_rates_in(text: Column) -> Column:
    """Co-payment rates right after the word for it, above 0 and up to 1."""
    group = lambda i: F.filter(F.regexp_extract_all(text, F.lit(COPAY), F.lit(i)), lambda x: x != "")
    percent, ratio = F.transform(group(1), lambda x: x.cast("double") / 100), F.transform(group(2), lambda x: x.cast("double"))
    return F.filter(F.concat(percent, ratio), lambda x: (x > 0) & (x <= 1))


def model_codes(raw: Column, limit: int = 6) -> Column:
    """struct(codes, dropped) of a model's answer: its distinct codes, ``limit`` at most, and the words beside them."""
    upper = F.upper(F.trim(raw))
    none = (upper == "") | F.startswith(upper, F.lit("NONE"))
    code = "[A-Z][0-9]{2}(?:[.][0-9]{1,2})?"
    words = F.filter(F.regexp_extract_all(F.regexp_replace(upper, code, " "), F.lit("[A-Z가-힣0-9]+"), F.lit(0)), lambda w: w != "NONE")
    empty = F.array().cast("array<string>")
    codes = F.slice(F.array_distinct(F.regexp_extract_all(upper, F.lit(code), F.lit(0))), 1, limit)
    return F.struct(F.when(none, empty).otherwise(codes).alias("codes"), F.when(none, empty).otherwise(words).alias("dropped"))


def model_choices(raw: Column, options: Column) -> Column:
    """Distinct option numbers of a model's answer; those outside 1..options go."""
    numbers = F.transform(F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    kept = F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= options)))
    return F.when(F.startswith(F.upper(F.trim(raw)), F.lit("NONE")), F.array().cast("array<int>")).otherwise(kept)


def split_tail(codes: Column, text: Column, chapter: str = "O") -> Column:
    """struct(sure, weak) of the codes of a dictionary's tail key: those of pregnancy need its context; of the others
    none is sure if they are of several chapters."""
    pregnant = F.filter(codes, lambda c: F.startswith(c, F.lit(chapter)))
    others = F.filter(codes, lambda c: ~F.startswith(c, F.lit(chapter)))
    several = F.size(F.array_distinct(F.transform(others, lambda c: F.substring(c, 1, 1)))) > 1
    context = (F.size(pregnant) > 0) & F.rlike(text, F.lit(PREGNANCY))
    none = F.array().cast("array<string>")
    sure = F.when(context, pregnant).when(several, none).otherwise(others)
    weak = F.when(context, others).when(several, codes).otherwise(pregnant)
    return F.struct(sure.alias("sure"), weak.alias("weak"))
