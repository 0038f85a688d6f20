"""Codes in clause texts and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms of a range and of a single code, and the reasons that codes state by themselves
#: (letter, first, last, name, words of the clause).
RANGE = "([A-Z])([0-9]{2})(?:[.][0-9]{1,2})?\\s*[∼~～-]\\s*([A-Z])([0-9]{2})(?:[.][0-9]{1,2})?"
SINGLE = "(?U)\\b([A-Z])([0-9]{2})(?:[.]([0-9]{1,2}))?\\b"
INJURY_LETTERS = "ST"
EXTERNAL_LETTERS = "VWXY"
REASONS = (
    ("X", 60, 84, "intentional self-harm", ("자신을 해친",)),
    ("Y", 36, 36, "war", ("전쟁",)),
    ("Z", 0, 13, "check-up", ("건강검진",)),
    ("Z", 23, 27, "vaccination", ("예방접종",)),
    ("Z", 31, 31, "reproduction", ("불임",)),
    ("Z", 41, 41, "appearance", ("외모개선",)),
)

_RANGE_TYPE = "array<struct<letter:string,lo:int,hi:int,subdivision:string>>"


def code_ranges(text: str | Column) -> Column:
    """The code ranges of a text: ranges of one letter, then single codes outside them, with their subdivision.

    A range between two letters is no range; its ends count as single codes.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = [F.regexp_extract_all(text, F.lit(RANGE), F.lit(i)) for i in range(1, 5)]
    found = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abcd", strict=True)]), lambda r: F.struct(r["a"].alias("letter"), r["b"].cast("int").alias("lo"), r["d"].cast("int").alias("hi"), F.lit(None).cast("string").alias("subdivision"), (r["a"] == r["c"]).alias("same")))
    ranges = F.transform(F.filter(found, lambda r: r["same"]), lambda r: F.struct(r["letter"], r["lo"], r["hi"], r["subdivision"]))
    rest = F.regexp_replace(text, F.lit("([A-Z])([0-9]{2})(?:[.][0-9]{1,2})?\\s*[∼~～-]\\s*\\1([0-9]{2})(?:[.][0-9]{1,2})?"), F.lit(" "))
    ones = [F.regexp_extract_all(rest, F.lit(SINGLE), F.lit(i)) for i in range(1, 4)]
    singles = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(ones, "abc", strict=True)]), lambda r: F.struct(r["a"].alias("letter"), r["b"].cast("int").alias("lo"), r["b"].cast("int").alias("hi"), F.nullif(r["c"], F.lit("")).alias("subdivision")))
    return F.concat(ranges.cast(_RANGE_TYPE), singles.cast(_RANGE_TYPE))


def in_range(code: Column, r: Column) -> Column:
    """True if a code such as N39.4 is in a range; a pinned subdivision must begin that of the code."""
    number = F.substring(code, 2, 2).try_cast("int")
    below = F.nullif(F.substring(code, 5, 2), F.lit(""))
    pinned = r["subdivision"].isNull() | F.coalesce(F.startswith(below, r["subdivision"]), F.lit(False))
    return (F.substring(code, 1, 1) == r["letter"]) & number.between(r["lo"], r["hi"]) & pinned


def coverage_kind(codes: str | Column) -> Column:
    """injury if a code is of chapter S or T; null without codes or with external causes only; else disease."""
    codes = F.col(codes) if isinstance(codes, str) else codes
    letter = lambda c: F.upper(F.substring(F.trim(c), 1, 1))
    injury = F.exists(codes, lambda c: letter(c).isin(*INJURY_LETTERS))
    other = F.exists(codes, lambda c: ~letter(c).isin(*EXTERNAL_LETTERS))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, None).when(injury, "injury").when(other, "disease")


def codes_in(text: Column) -> Column:
    """Codes written in a text, particles may follow at once, dots may be left out; distinct, in order, with two
    digits of the subdivision at most. The text should be in NFKC (see ``functions.text.clean``)."""
    pattern = "(?<![A-Za-z0-9])([A-Za-z])([0-9]{2})(?:[.]?([0-9]{1,3}))?(?![0-9])"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.array_distinct(F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)]), lambda r: _joined(r["a"], r["b"], r["c"])))


def _joined(letter: Column, category: Column, below: Column) -> Column:
    return F.concat(F.upper(letter), category, F.when(below == "", "").otherwise(F.concat(F.lit("."), F.substring(below, 1, 2))))


def codes_strict(raw: Column) -> Column:
    """struct(codes, invalid): a list of codes in one text, split on all usual delimiters; any token that is no
    code makes the row invalid and leaves it without codes."""
    tokens = F.filter(F.split(F.upper(F.trim(raw)), "[\\s,;，、·ㆍ・‧/|\\[\\]\"']+"), lambda x: x != "")
    form = "^([A-Z])([0-9]{2})(?:[.]?([0-9]{1,4}))?$"
    bad = F.filter(tokens, lambda x: ~F.rlike(x, F.lit(form)))
    good = F.array_distinct(F.transform(tokens, lambda x: _joined(F.regexp_extract(x, form, 1), F.regexp_extract(x, form, 2), F.regexp_extract(x, form, 3))))
    return F.struct(F.when(F.size(bad) > 0, F.array().cast("array<string>")).otherwise(good).alias("codes"), bad.alias("invalid"))


def reason_of(code: Column, clause: Column) -> Column:
    """The name of the reason that a code states by itself and the clause words, else null."""
    number = F.substring(code, 2, 2).try_cast("int")
    out = F.lit(None).cast("string")
    for letter, lo, hi, name, words in reversed(REASONS):
        said = F.lit(False)
        for w in words:
            said = said | F.contains(clause, F.lit(w))
        out = F.when((F.substring(code, 1, 1) == letter) & number.between(lo, hi) & said, name).otherwise(out)
    return out


def range_cells(clauses: DataFrame, on: list[str]) -> DataFrame:
    """(on, clause_uid, r, letter, number): a row for each number of each range of the clauses; a range of one letter has
    100 numbers at most."""
    cells = clauses.select(*on, "clause_uid", F.explode(code_ranges("content")).alias("r"))
    return cells.select(*on, "clause_uid", "r", F.col("r.letter").alias("letter"), F.explode(F.sequence("r.lo", F.greatest("r.lo", "r.hi"))).alias("number"))


def stated_reasons(content: Column) -> Column:
    """The codes (letter, lo, hi) that state by themselves a reason of which a text has words."""
    reasons = F.array(*[F.struct(F.lit(letter).alias("letter"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, words)).alias("words")) for letter, lo, hi, _, words in REASONS])
    said = F.filter(reasons, lambda r: F.exists(r["words"], lambda w: F.contains(content, w)))
    return F.transform(said, lambda r: F.struct(r["letter"].alias("letter"), r["lo"].alias("lo"), r["hi"].alias("hi")))


def reason_cells(clauses: DataFrame, on: list[str]) -> DataFrame:
    """(on, clause_uid, letter, number): a row for each code that states by itself a reason of which a clause has words."""
    reasons = F.array(*[F.struct(F.lit(letter).alias("letter"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, words)).alias("words")) for letter, lo, hi, _, words in REASONS])
    said = F.filter(reasons, lambda r: F.exists(r["words"], lambda w: F.contains(F.col("content"), w)))
    cells = clauses.select(*on, "clause_uid", F.explode(said).alias("r"))
    return cells.select(*on, "clause_uid", F.col("r.letter").alias("letter"), F.explode(F.sequence("r.lo", "r.hi")).alias("number"))


def code_range_join(claims: DataFrame, clauses: DataFrame, codes: str, on: list[str], key: str = "claim_id") -> DataFrame:
    """(key, clause_uid, matched): the clauses of the claim's ``on`` whose ranges hold one of its codes.

    Ranges are cut into single (letter, number) rows, so the theta join is an equi join of keys and codes alone. The pinned subdivision is
    checked on what has met.
    """
    cells = range_cells(clauses, on)
    asked = claims.select(key, *on, F.explode(F.array_distinct(codes)).alias("matched"))
    asked = asked.withColumn("letter", F.substring("matched", 1, 1)).withColumn("number", F.substring("matched", 2, 2).try_cast("int"))
    met = asked.join(cells, [*on, "letter", "number"]).where(in_range(F.col("matched"), F.col("r")))
    return met.select(key, "clause_uid", "matched").distinct()
