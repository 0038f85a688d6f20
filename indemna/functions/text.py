"""Column functions on texts: cleaning, quoting, stems, dates and ratios."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Particles that a stem loses, long ones first, and what a proviso in parentheses says.
PARTICLES_KO = ("에서", "으로", "에게", "부터", "까지", "로서", "로써", "하는", "되는", "이나", "은", "는", "이", "가", "을", "를", "에", "로", "의", "도", "만", "한", "인", "된")
PARTICLES_EN = ("tion", "ing", "ed", "es", "ly", "er")
TABLE_MARK = " …(표)"
_BOX = "[─-╿▀-▟]"


def valid_ratio(raw: Column) -> Column:
    """struct(ratio, rejected): a negative ratio counts as not given; 0, above 1, NaN and infinite ones are rejected."""
    bad = (raw == 0) | (raw > 1) | F.isnan(raw)
    return F.struct(F.when(bad | (raw < 0), None).otherwise(raw).alias("ratio"), F.coalesce(bad, F.lit(False)).alias("rejected"))


def unboxed(text: Column) -> Column:
    """Table borders and runs of white space become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _BOX, " "), "\\s+", " "))


def prose_quote(text: Column, limit: int) -> Column:
    """The prose of a text up to its first table, cut at ``limit``; a table is told by a mark."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    table = F.rlike(flat, F.lit(_BOX + "{2,}"))
    prose = F.rtrim(F.regexp_extract(flat, "(?s)^(.*?)(?:" + _BOX + "{2,}|$)", 1))
    short = F.substring(F.trim(F.concat(prose, F.lit(TABLE_MARK))), 1, limit)
    whole = F.concat(prose, F.when(table, TABLE_MARK).otherwise(""))
    return F.when(flat == "", "").when(table & (F.length(prose) < 24), short).when(F.length(prose) > limit, F.concat(F.rtrim(F.substring(prose, 1, limit)), F.lit("…"))).otherwise(whole)


def stem(token: Column, particles: tuple[str, ...] = PARTICLES_KO, least: int = 2) -> Column:
    """The token without its first particle that leaves ``least`` characters, tried in the order given."""
    out = token
    for p in reversed(particles):
        fits = F.endswith(token, F.lit(p)) & (F.length(token) - len(p) >= least)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(p))).otherwise(out)
    return out


def stemmed_tokens(text: Column, particles: tuple[str, ...] = PARTICLES_KO, pattern: str = "[가-힣]{2,}") -> Column:
    """Stems in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: stem(w, particles))


def without_provisos(clause: Column, word: str = "다만") -> Column:
    """The clause less the parentheses that hold the word of a proviso."""
    return F.regexp_replace(clause, f"\\([^()]*{word}[^()]*\\)", " ")


def mask(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """struct(masked, changed) after all replacements in order."""
    out = text
    for pattern, to in patterns:
        out = F.regexp_replace(out, pattern, to)
    return F.struct(out.alias("masked"), (~out.eqNullSafe(text)).alias("changed"))


#: Resident numbers keep six digits, mobile numbers their carrier and last four.
PERSONAL_KO = (("(?U)\\b(\\d{6})[-\\s]?([1-4]\\d{6})\\b", "$1-*******"), ("(?U)\\b(01[016-9])[-\\s]?(\\d{3,4})[-\\s]?(\\d{4})\\b", "$1-****-$3"))


@F.pandas_udf(StringType())
def clean(texts: pd.Series) -> pd.Series:
    """NFKC, without invisible characters, in NFKC again."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        kept = (c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) not in ("Cf", "Cc", "Cn") or c in "\n\t")
        return unicodedata.normalize("NFKC", "".join(kept).replace("ㅤ", "").replace("ᅠ", ""))

    return texts.map(one)


def first_date(text: Column) -> Column:
    """The first written date that exists, else null."""
    pattern = "(\\d{4})[.\\-/년]\\s*(\\d{1,2})[.\\-/월]\\s*(\\d{1,2})"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    days = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)]), lambda r: F.try_to_date(F.concat_ws("-", r["a"], F.lpad(r["b"], 2, "0"), F.lpad(r["c"], 2, "0")), "yyyy-MM-dd"))
    return F.get(F.filter(days, lambda d: d.isNotNull()), 0)
