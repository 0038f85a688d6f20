"""Strings inside texts by hash joins: containment, whole-word keys, and the terms of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indemna.functions.receipts import split_tail

#: Everyday words and the official ones that are read along with them.
SYNONYMS = {"충치": "치아우식", "발목 골절": "복사의 골절", "입덧": "과다구토", "치핵": "치질"}
#: What makes a short term glued to it an illness; words that hold a term but are no illness.
ILLNESS_PREFIXES = (
    "급성", "만성", "아급성", "초기", "말기", "조기", "진행성", "재발성", "반복성", "습관성", "선천성", "후천성", "외상성", "노인성", "소아", "영아",
    "신생아", "산후", "임신성", "알코올성", "약물성", "세균성", "바이러스성", "흡인성", "혈관성", "이차성", "원발성", "속발성", "전이성", "악성",
    "수술후", "금단", "야간", "중환자실", "고도", "병적", "중증", "경증", "경도", "중등도", "복부", "과다",
)
_VISITS = "탐방|관광|답사|명소|여행|트레킹|방문|지구|공원|지역|등재|유적|견학|체험|투어|관람"
_AEROBIC = "운동|성|능력|훈련|활동|를|가|는|도|에|로|와|만"
HOMONYMS = (
    "(?:세계|국가|유네스코|지정)\\s*자연\\s*유산",
    f"자연\\s*유산\\s*(?:{_VISITS})",
    "(?:문화|세계|국가|무형|역사)\\s*유산",
    "유산(?:균|슬)",
    f"유산소(?:{_AEROBIC}|(?![가-힣]))",
    "유착\\s*(?:방지|예방|차단)",
)
#: Stands before every character of a homonym.
_MARK = "\x01"


def contained(parts: DataFrame, part: str, wholes: DataFrame, whole: str, most: int = 8) -> DataFrame:
    """(part, whole, h1, h2): the distinct pairs in which the text ``whole``, of hashes h1 and h2, holds the string
    ``part``. Null and empty strings are in no pair.

    A string is met by its head, its first ``most`` characters: each distinct text gives its pieces of the lengths that
    heads have, which are joined with the heads, and what meets is looked up in full. Work grows with the characters
    of the texts, not with texts times strings."""
    keys = parts.select(F.col(part).alias("part")).where("part <> ''").distinct().withColumn("head", F.substring("part", 1, most))
    sizes = F.broadcast(keys.agg(F.array_sort(F.collect_set(F.length("head"))).alias("sizes")))  # ``most`` numbers at most
    # Without any string no text is shuffled.
    texts = wholes.select(F.col(whole).alias("whole")).where("whole <> ''").crossJoin(sizes).where("size(sizes) > 0").distinct()
    texts = texts.withColumns({"h1": F.xxhash64("whole"), "h2": F.xxhash64(F.lit(1), "whole")})
    chars = texts.select("h1", "h2", "sizes", F.regexp_extract_all("whole", F.lit("(?s)."), F.lit(0)).alias("chars"))
    met = chars.select("h1", "h2", F.explode(_runs(F.col("chars"), F.col("sizes"), "")).alias("head")).join(keys, "head").select("h1", "h2", "part").distinct()
    return met.join(texts.drop("sizes"), ["h1", "h2"]).where(F.contains("whole", "part")).select("part", "whole", "h1", "h2")


def _runs(items: Column, sizes: Column, by: str) -> Column:
    """The distinct runs of consecutive items of each of the sizes, joined by ``by``."""
    starts = lambda n: F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice(items, i, n), by)))))


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def dictionary_match(texts: DataFrame, uid: str, text: str, keys: DataFrame) -> DataFrame:
    """(uid, key): the keys that occur in a text as whole words, less those that only occur as part of a longer
    key that was matched. Equal texts are looked up once; their runs of as many words as some key has meet the keys in
    a hash join. Keys are words joined by single blanks, in lower case."""
    known = keys.select("key").where("key is not null").distinct()
    sizes = F.broadcast(known.agg(F.array_sort(F.collect_set(F.size(F.split("key", " ")))).alias("sizes")))  # few: lengths of names
    seen = texts.select(F.col(text).alias("said")).where("said is not null").distinct().crossJoin(sizes)
    met = seen.select("said", F.explode(_runs(_words("said"), F.col("sizes"), " ")).alias("key")).join(known, "key")
    inner = known.crossJoin(sizes).select(F.col("key").alias("longer"), F.explode(_runs(F.split("key", " "), F.col("sizes"), " ")).alias("key")).where("key <> longer")
    covered = met.withColumnRenamed("key", "longer").join(inner, "longer").select("said", "key").distinct()
    left = met.join(covered, ["said", "key"], "left_anti")
    return texts.select(uid, F.col(text).alias("said")).join(left, "said").select(uid, "key")


def _marked(text: Column, homonyms: tuple[str, ...]) -> Column:
    """The text with a mark before each character that some homonym covers."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    covered = None
    for pattern in homonyms:
        between, inside = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        blank = F.array_join(F.zip_with(between, inside, lambda a, b: F.concat(a, F.repeat(F.lit(_MARK), F.coalesce(F.length(b), F.lit(0))))), "")
        here = F.transform(chars(blank), lambda c: c == _MARK)
        covered = here if covered is None else F.zip_with(covered, here, lambda a, b: a | b)
    marked = F.array_join(F.zip_with(chars(text), covered, lambda c, x: F.when(x, F.concat(F.lit(_MARK), c)).otherwise(c)), "")
    return F.when(F.rlike(text, F.lit("|".join(homonyms))), marked).otherwise(text)


def with_synonyms(text: Column, synonyms: dict[str, str]) -> Column:
    """The text followed by the official word for each everyday one that it holds by then."""
    for everyday, official in synonyms.items():
        text = F.concat(text, F.when(F.contains(text, F.lit(everyday)), F.lit(f" {official}")).otherwise(""))
    return text


def entity_match(texts: DataFrame, uid: str, text: str, keys: DataFrame, synonyms: dict[str, str] = SYNONYMS, homonyms: tuple[str, ...] = HOMONYMS, prefixes: tuple[str, ...] = ILLNESS_PREFIXES, bounded: int = 2) -> DataFrame:
    """(uid, key, strong): the dictionary terms that occur anywhere in a text, official words of synonyms appended first.

    A term is strong if it occurs once outside every homonym and, with ``bounded`` characters or fewer, not glued to
    Hangul before it unless this ends with one of the ``prefixes``. A term inside another strong one of the text goes.
    Equal texts are looked up once. Null texts give no rows."""
    rows = texts.select(uid, with_synonyms(F.col(text), synonyms).alias("said"))
    met = contained(keys, "key", rows, "said")
    quoted = F.regexp_replace("part", "([^\\p{L}\\p{N}\\s])", "\\\\$1")
    glued = "|".join("".join(f"{_MARK}?{c}" for c in p) for p in prefixes)
    short = F.concat(F.lit(f"(?:(?<![가-힣{_MARK}])|{glued})" if glued else f"(?<![가-힣{_MARK}])"), quoted)
    said = _marked(F.col("whole"), homonyms) if homonyms else F.col("whole")
    strong = F.rlike(said, F.when(F.length("part") > bounded, F.concat(F.lit(f"(?<!{_MARK})"), quoted)).otherwise(short))
    met = met.select("h1", "h2", "part", strong.alias("strong"))
    inside = contained(keys, "key", keys, "key").where("part <> whole").select("part", F.col("whole").alias("longer"))
    covered = met.where("strong").select("h1", "h2", F.col("part").alias("longer")).join(inside, "longer").select("h1", "h2", "part").distinct()
    left = met.join(covered, ["h1", "h2", "part"], "left_anti")
    hashed = rows.select(uid, F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"))
    return hashed.join(left, ["h1", "h2"]).select(uid, F.col("part").alias("key"), "strong")


def dictionary_codes(texts: DataFrame, uid: str, text: str, keys: DataFrame, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """(uid, codes, weak): the categories of the terms of each text that has any, sorted. Codes of terms that aren't strong
    are weak, as are those of a tail term whose chapter stays open; codes that are sure elsewhere aren't weak."""
    found = entity_match(texts, uid, text, keys, synonyms).join(keys.select("key", "kind", "categories"), "key")
    found = found.join(texts.select(uid, with_synonyms(F.col(text), synonyms).alias("said")), uid)
    tail, none = split_tail(F.col("categories"), F.col("said")), F.array().cast("array<string>")
    sure = F.when(~F.col("strong"), none).when(F.col("kind") == "tail", tail["sure"]).otherwise(F.col("categories"))
    weak = F.when(~F.col("strong"), F.col("categories")).when(F.col("kind") == "tail", tail["weak"]).otherwise(none)
    rows = found.select(uid, sure.alias("sure"), weak.alias("weak")).groupBy(uid)
    told = rows.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("sure", "weak")])
    return told.select(uid, F.col("sure").alias("codes"), F.array_except("weak", "sure").alias("weak"))
