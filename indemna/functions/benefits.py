"""What a claim's text says of treatments and of their kind of cover: covered by health insurance, or not."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from indemna.functions.money import amounts_in

# Names of items and products, particles, and the wording that tells them.
MUSCULOSKELETAL = "근골격계 이학요법ㆍ체외충격파치료"
INJECTION = "주사료"
MRI = "자기공명영상진단"
NONCOVERED = "비급여"
COVERED = "급여"

SEVERE = "실손의료보험 특별약관1(중증 비급여 실손의료비)"
MILD = "실손의료보험 특별약관2(비중증 비급여 실손의료비)"
BENEFIT = "기본형 실손의료보험(급여 실손의료비)"

#: (product, item, where the product deals with it instead, whether it is not covered at all)
CARVED = (
    (SEVERE, MUSCULOSKELETAL, "(3)3대비급여-근골격계이학요법치료ㆍ체외충격파치료", False),
    (SEVERE, INJECTION, "(3)3대비급여-주사료", False),
    (SEVERE, MRI, "(3)3대비급여-자기공명영상진단", False),
    (MILD, MRI, "(3)비급여 자기공명영상진단", False),
    (MILD, MUSCULOSKELETAL, "제4조", True),
    (MILD, INJECTION, "제4조", True),
    (BENEFIT, NONCOVERED, "제4조의2", True),
    (SEVERE, COVERED, "제3조", True),
    (MILD, COVERED, "제3조", True),
)

PARTICLE = "(?:으로|에서|에게|까지|부터|를|을|이|가|은|는|와|과|도|만|에|의|로)$"

ITEMS = (
    (MUSCULOSKELETAL, "(?i)(?<!빈)도수|충격파(?!\\s*쇄석)|증식\\s*치료|프롤로|인대\\s*강화|이학\\s*요법|(?<![A-Z])F?IMS(?![A-Z])|ESWT|근육\\s*내\\s*자극|신장\\s*분사|무통증\\s*신호"),
    (INJECTION, "주사|수액|[링닝][거겔게]"),
    (MRI, "(?i)자기\\s*공명|MR(?:I|A|CP)|엠\\s*알\\s*아이"),
)

_SIGN = "[\\s\\-·ㆍᆞ・‧()\\[\\]]"
NONCOVERED_WORD = f"비급\\s*여|(?<![가-힣])비{_SIGN}*(?:급{_SIGN}*여|보험)|非\\s*(?:給\\s*與|급\\s*여)"

#: Stands for each character of a non-covered word while covered ones are looked for; no text holds it after cleaning.
MASK = chr(0xE000)
_GAP = "[\\s()\\[\\]:]*"
_LINK = "[\\s()\\[\\]:,/]*(?:(?:의|중|에서|내|해당|에\\s*대한)\\s*)?"
_JOIN = "(?:[·ᆞ・‧•∙、,/+&;~|-]|및|와|과|그리고|또는|이랑|랑|하고|외|에)"
_NEGATED_GAP = "[\\s()\\[\\]:,/=—–―-]*"
_NOT_NEGATED = "(?!\\s*(?:(?:이|가|은|는|에)\\s*)?(?:안|않|아[니닌님닙]|되지|불|제외|외|미|[xX×]|대상\\s*(?:(?:이|가)\\s*)?(?:아|외|제외)))"
_ALONE = f"(?<![가-힣{MASK}])"
_SAID = "급\\s*여"
_PAYER = f"(?:{_ALONE}|(?<=요양|의료|보험)){_SAID}"
_BURDEN = "부담(?!\\s*[률율])"
_AMOUNT = "\\d[\\d,]*\\s*(?:(?:만|천)\\s*)?원"
_NONE = (
    "(?:(?:해당\\s*(?:사항\\s*)?(?:이\\s*)?)?(?:없|無)[가-힣]*|해당\\s*안|아[니닌님닙냐녜닐녀][가-힣]*|0+(?![\\d.,])\\s*원?|₩\\s*0+(?![\\d.,])|영\\s*원"
    "|제외[가-힣]*|미\\s*(?:포함|발생|해당)|불\\s*포함|빼고|뺀|전무|무(?![가-힣])|받지\\s*않[가-힣]*|안\\s*받[가-힣]*|[xX×](?![\\w-]))"
)
COVERED_WORD = "|".join(
    (
        # Covered and the patient's own share; columns of a receipt.
        f"{_PAYER}{_LINK}(?:일부\\s*)?(?:본인|환자){_GAP}(?:일부\\s*)?{_BURDEN}",
        f"본인{_GAP}일부{_GAP}{_BURDEN}",
        f"일부{_GAP}본인{_GAP}{_BURDEN}",
        f"건강\\s*보험{_GAP}(?:본인|환자){_GAP}{_BURDEN}",
        f"(?:건강\\s*보험|건보)(?:{_GAP}(?:이|가))?{_GAP}적용{_NOT_NEGATED}",
        f"(?:(?<![가-힣])|(?<=보험|건보))공단(?:{_GAP}(?:이|에서|측))?{_GAP}(?:\\d+\\s*%{_GAP})?(?:{_BURDEN}|냈|청구|몫)",
        f"(?<![가-힣])보험자{_GAP}{_BURDEN}",
        # Covered and a part of the treatment.
        f"{_PAYER}{_GAP}(?:항목|부분|의료비|진료비?|치료비?|검사|수술|입원|통원|처방|약제|약값|비용|청구|몫)",
        f"{_PAYER}(?:분|만|비(?![가-힣]))",
        f"{_PAYER}(?:(?:으로|로){_GAP})?(?:처리|인정)",
        f"{_ALONE}{_SAID}{_GAP}(?:적용|대상|해당){_NOT_NEGATED}",
        f"{_ALONE}{_SAID}(?:였|이었|이에요|예요|입니다|이다|임)",
        f"(?<![가-힣])(?:전부|모두)\\s*{_SAID}(?!{_GAP}실손)",
        # Covered beside non-covered, or a non-covered part of a whole.
        f"{_ALONE}{_SAID}{_GAP}(?:(?:금액|액){_GAP})?\\d",
        f"{_ALONE}{_SAID}{_GAP}(?:{_JOIN}{_GAP})?{MASK}+",
        f"{_ALONE}{MASK}+{_GAP}(?:{_JOIN}{_GAP})?{_SAID}(?!{_GAP}(?:실손|외|적용|대상|제외))",
        f"(?:(?<=[\\d만천백])원|{_ALONE}그){_GAP}(?:중|가운데){_GAP}{MASK}",
        f"{_ALONE}{MASK}+{_GAP}(?:(?:금액|액){_GAP})?{_AMOUNT}{_GAP}(?:포함|별도)",
        # Nothing non-covered.
        f"{_ALONE}{MASK}+(?:{_GAP}(?:항목|진료비?|의료비|치료비?|비용|청구|부분|분|내역|금액|합계|총액|소계|계|액))?"
        f"(?:{_GAP}(?:은|는|이|가|도|를|을))?(?:{_GAP}(?:전혀|하나도|일절|일체))?{_NEGATED_GAP}{_NONE}",
    )
)
ITEMIZED = f"{_ALONE}{MASK}+{_GAP}(?:(?:금액|액){_GAP})?{_AMOUNT}"
# End of the fixed values.

_WORD = "[\\p{L}\\p{N}]"
#: Hangul fillers, which show nothing.
_FILLERS = (chr(0x115F), chr(0x1160), chr(0x3164))


@F.pandas_udf(StringType())
def clean_markers(texts: pd.Series) -> pd.Series:
    """NFKC, without format, combining and private characters and Hangul fillers, in NFKC again."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        seen = (c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) not in ("Cf", "Mn", "Me", "Co") and c not in _FILLERS)
        return unicodedata.normalize("NFKC", "".join(seen))

    return texts.map(one)


def _hit(text: Column, pattern: str) -> tuple[Column, Column]:
    """Where the first match starts, counted from 0, and the match itself; the match is empty where there is none."""
    flags, rest = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    found = f"{flags}(?U)^(.*?)({rest})"
    return F.length(F.regexp_extract(text, found, 1)), F.regexp_extract(text, found, 2)


def word_around(text: Column, start: Column, length: Column) -> Column:
    """The whole word that holds the match, less a particle at its end that lies behind the match."""
    left = F.regexp_extract(F.substring(text, F.lit(1), start), f"(?<!{_WORD}){_WORD}*\\z", 0)
    right = F.regexp_extract(F.substring(text, start + length + 1, F.length(text)), f"^{_WORD}*", 0)
    word = F.concat(left, F.substring(text, start + 1, length), right)
    particle = F.length(F.regexp_extract(word, PARTICLE, 0))
    return F.when(particle <= F.length(right), F.substring(word, F.lit(1), F.length(word) - particle)).otherwise(word)


def _found(text: Column, pattern: str) -> Column:
    start, hit = _hit(text, pattern)
    return F.when(hit != "", word_around(text, start, F.length(hit)))


def noncovered_word(text: Column) -> Column:
    """The word that says "not covered" in a cleaned text, without signs inside it; else null."""
    said = F.regexp_extract(text, f"(?U){NONCOVERED_WORD}", 0)
    return F.when(said != "", F.regexp_replace(said, f"(?U){_SIGN}", ""))


def masked_noncovered(text: Column) -> Column:
    """The text with a mark for each character of its non-covered words."""
    words = F.regexp_extract_all(text, F.lit(f"(?U)({NONCOVERED_WORD})"), F.lit(1))
    around = F.split(text, f"(?U){NONCOVERED_WORD}")
    return F.array_join(F.zip_with(around, words, lambda a, w: F.concat(a, F.repeat(F.lit(MASK), F.coalesce(F.length(w), F.lit(0))))), "")


def covered_word(text: Column, masked: Column) -> Column:
    """The words that say that something is covered in a cleaned text, given its ``masked_noncovered`` form; else null.

    A non-covered amount beside a different amount says so too, since the rest is covered."""
    start, hit = _hit(masked, COVERED_WORD)
    at, part = _hit(masked, ITEMIZED)
    others = F.size(F.array_except(amounts_in(text), amounts_in(part))) > 0
    word = F.when(hit != "", word_around(text, start, F.length(hit))).when((part != "") & others, word_around(text, at, F.length(part)))
    return F.replace(F.trim(F.regexp_replace(word, "(?U)\\s+", " ")), F.lit("ᆞ"), F.lit("ㆍ"))


def treatment_items(rows: DataFrame, text: str, to: str = "items") -> DataFrame:
    """Adds ``to``, an array of (item, word): treatments that ``text`` names, and what it says of their cover.

    Null and empty texts name none. A text is cleaned once; all else are column functions."""
    clean, masked = f"{to}_clean", f"{to}_masked"
    rows = rows.withColumn(clean, clean_markers(text)).withColumn(masked, masked_noncovered(F.col(clean)))
    said = F.col(clean)
    words = [(item, _found(said, pattern)) for item, pattern in ITEMS]
    words += [(NONCOVERED, noncovered_word(said)), (COVERED, covered_word(said, F.col(masked)))]
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("item"), w.alias("word")) for i, w in words]), lambda x: x["word"].isNotNull())
    return rows.withColumn(to, found).drop(clean, masked)


def told_treatments(rows: DataFrame, text: str, to: str = "items", parts: int = 16) -> DataFrame:
    """``treatment_items``, found once for all rows that say the same: distinct texts are read and joined back.

    A text that very many rows say is dealt to ``parts`` and meets a copy of what it says in each."""
    distinct = rows.select(text).where(F.col(text).isNotNull()).distinct()
    # The grouping keeps filters on what was found above it: below, each would find it all again.
    told = treatment_items(distinct, text, to).groupBy(text).agg(F.first(to).alias(to)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(parts)).cast("int"))
    return dealt.join(told, [text, "part"], "left").withColumn(to, F.coalesce(to, F.array().cast(told.schema[to].dataType))).select(*rows.columns, to)


def carved_out(rows: DataFrame, product: str = "product", items: str = "items") -> DataFrame:
    """(columns of ``rows`` but ``items``, item, word, place, excluded): items that the row's product deals with elsewhere
    than in its main cover, or not at all. Items that it leaves where they are give no row."""
    rules = rows.sparkSession.createDataFrame(list(CARVED), f"{product} string, item string, place string, excluded boolean")
    named = rows.withColumn("named", F.explode(items)).drop(items)
    named = named.withColumn("item", F.col("named.item")).withColumn("word", F.col("named.word")).drop("named")
    return named.join(F.broadcast(rules), [product, "item"])
