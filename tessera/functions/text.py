"""Scalar functions on texts: rules, dates, figures, questions, grades, prompts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule (substring, value) whose substring the lower-cased text has."""
    out = None
    for needle, value in rules:
        hit = F.lower(text).contains(needle)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def document_date(created: Column, modified: Column, name: Column) -> Column:
    """YYYY-MM-DD of metadata like D:20240131..., else a year 20xx of the file name, else 'unknown'. Days aren't validated."""
    raw = F.coalesce(F.nullif(created, F.lit("")), modified)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    year = F.regexp_extract(name, r"(20\d{2})", 1)
    return F.when((F.length(raw) >= 10) & (F.length(digits) >= 8), day).when(year != "", year).otherwise("unknown")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(x: Column, also: str = "") -> Column:
    """x without white space (and the characters in `also`) at its ends."""
    return F.regexp_replace(x, rf"(?U)\A[\s{also}]+|[\s{also}]+\z", "")


def clean_question(raw: Column) -> Column:
    """The first line with text: without thoughts before it, one number or label ('2.', 'Q:', 'Question -'), and quotes; null unless it ends with '?'."""
    lines = F.split(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")
    bare = lambda x: stripped(F.regexp_replace(stripped(stripped(F.regexp_replace(stripped(x), r"(?iU)\A(?:\d+[.)]\s*|q(?:uestion)?\s*[:.-]\s*)", ""))), "(?U)\\A[\"']+|[\"']+\\z", ""))
    line = F.get(F.filter(F.transform(lines, bare), lambda x: x != ""), F.lit(0))
    return F.when(line.endswith("?"), line)


def article(raw: Column) -> Column:
    """'Article 6', 8 or 9: the first of these numbers, in this order, that the text has."""
    return F.when(raw.contains("6"), "Article 6").when(raw.contains("8"), "Article 8").when(raw.contains("9"), "Article 9")


# The number of each letter grade.
GRADES = {"A": 4.0, "A-": 3.7, "B": 3.0, "B-": 2.7, "C": 2.0, "D": 1.0, "E": 0.5, "F": 0.0}


def grade_score(grade: Column) -> Column:
    """The number of a letter grade (capitals), else the value itself if it is a number."""
    table = F.create_map(*[x for k, v in GRADES.items() for x in (F.lit(k), F.lit(v))])
    own = stripped(grade)
    number = own.try_cast("double")
    return F.coalesce(F.try_element_at(table, own), F.when(~F.isnan(number), number))


def percent(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "N/A").otherwise(F.concat(F.format_number(x * 100, "0.0"), F.lit("%")))


def period_start(period: Column) -> Column:
    """The first day of 2024, 2024-03, 2024-Q1 or 2024-03-05."""
    year, quarter = F.substring(period, 1, 4), F.regexp_extract(period, r"^\d{4}-?Q([1-4])$", 1)
    return F.coalesce(F.try_to_date(period, "yyyy-MM-dd"), F.try_to_date(period, "yyyy-MM"), F.when(quarter != "", F.make_date(year.try_cast("int"), (quarter.try_cast("int") - 1) * 3 + 1, F.lit(1))), F.when(period.rlike(r"^\d{4}$"), F.try_to_date(period, "yyyy")))


def prompt(question: Column, hits: Column, limit: int = 500) -> Column:
    """A numbered context of ordered hits (source, page, content) and the question."""
    parts = F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["source"].cast("string"), F.lit(" p."), h["page"].cast("string"), F.lit("\n"), F.substring(h["content"], 1, limit)))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n\nQuestion: "), question)


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\n", " ")


def page_list(pages: Column) -> Column:
    """'source p1, source p2' of structs (source, page), or '(none)'."""
    joined = F.array_join(F.transform(pages, lambda p: F.concat(p["source"].cast("string"), F.lit(" p"), p["page"].cast("string"))), ", ")
    return F.when(F.coalesce(F.size(pages), F.lit(0)) == 0, "(none)").otherwise(joined)


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd'T'HHmmss")


def question_prompt(passage: Column) -> Column:
    """Asks for one question that a passage answers."""
    return F.concat(F.lit("Write one specific question that only the passage below answers. Name its subject, don't copy a sentence of it, and reply with the question alone, on one line.\n\nPassage:\n"), passage)


def citations(hits: Column) -> Column:
    """A line for each of the ordered hits: 'Source: name, Page n (similarity: 0.00)'."""
    return F.array_join(F.transform(hits, lambda h: F.format_string("Source: %s, Page %s (similarity: %.2f)", h["source"].cast("string"), h["page"].cast("string"), h["similarity"].cast("double"))), "\n")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


# Month names in English and French, with and without accents, by number.
MONTHS = {m: i for names in ("january february march april may june july august september october november december", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre") for i, m in enumerate(names.split(), 1)}
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
_YEAR = r"(?U)\b(\d{4})\b"
_BEFORE_YEAR = rf"(?iuU)\b(?:(?:{_NAMES})\s+\d{{1,2}}(?:st|nd|rd|th)?,?|\d{{1,2}}(?:er|st|nd|rd|th)?\s+(?:{_NAMES}))\s+\z"


def between(text: Column, pattern: str) -> Column:
    """A struct of the matches of a pattern's first group, found, and the texts around them, around, one more."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("found"), F.split(text, pattern).alias("around"))


def exact_dates(text: Column) -> Column:
    """Full dates (day, month and year) in order of position, each once; impossible ones are skipped. Null: null.

    Every date has a year of four digits, before which stand a month and a day, or after which these do; so only texts
    around such numbers are looked at. Where the text before a year begins after another, a digit stands for that.
    """
    months = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])

    def named(before: Column, year: Column) -> Column:
        found = F.regexp_extract(before, f"({_BEFORE_YEAR})", 1)
        month = F.try_element_at(months, F.lower(F.regexp_extract(found, rf"(?iu)({_NAMES})", 1)))
        return F.try_to_date(F.concat_ws("-", year, month.cast("string"), F.regexp_extract(found, r"(?U)(\d{1,2})", 1)), "yyyy-M-d")

    def dates(x: Column) -> Column:
        def both(year: Column, i: Column) -> Column:
            before = F.concat(F.when(i > 0, "0").otherwise(""), F.get(x["around"], i))
            after = F.regexp_extract(F.get(x["around"], i + 1), r"(?U)\A(-\d{2}-\d{2})\b", 1)
            return F.array(named(before, year), F.when(after != "", F.try_to_date(F.concat(year, after), "yyyy-MM-dd")))

        return F.array_distinct(F.filter(F.flatten(F.transform(x["found"], both)), lambda d: d.isNotNull() & (F.year(d) >= 1)))

    return F.when(text.isNull(), None).when(text.rlike(_YEAR), let(between(text, _YEAR), dates)).otherwise(F.array().cast("array<date>"))


def covers(dates: Column, start: Column, end: Column) -> Column:
    """Whether any of the dates lies in [start, end]; false without bounds."""
    return F.coalesce(F.exists(dates, lambda d: (d >= start) & (d <= end)), F.lit(False))


# Characters that group digits, the forms of a number, and words and signs that make a figure of a single digit.
_SPACES = " \u00a0\u202f\u2009"
_MAGNITUDES = "thousand|million|billion|trillion|bn|mn|mille|milliers?|millions?|milliards?"
_CURRENCIES = r"€|\$|£|\bUSD|\bEUR|\bGBP"
_NUMBER = rf"(?U)(?<![\w.,])(\d{{1,3}}(?:[{_SPACES}]\d{{3}})+(?:[.,]\d+)?|\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d{{1,3}}(?:\.\d{{3}})+(?:,\d+)?|\d+(?:[.,]\d+)?)(?!\d)"


def readings(raw: Column) -> Column:
    """The plain decimal numbers that a written number can mean, if '.' or ',' is the decimal mark and the other, or a space, groups thousands."""
    bare = F.regexp_replace(raw, f"[{_SPACES}]", "")
    out = []
    for mark, group in ((".", ","), (",", ".")):
        plain = F.translate(bare, f"{mark}{group}", ".")
        plain = F.regexp_replace(F.regexp_replace(plain, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
        out.append(F.when(bare.rlike(rf"^\d+(?:\{group}\d{{3}})*(?:\{mark}\d+)?$"), F.regexp_replace(plain, r"\.$", "")))
    return F.array_distinct(F.array_compact(F.array(*out)))


def numbers(text: Column) -> Column:
    """All numbers of a text as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), F.lit(1))


def figures(text: Column) -> Column:
    """The figures of an answer, each meaning once, as structs (text, readings). [n] marks are none, nor are single digits without percent sign, magnitude or currency.

    What stands around a number is looked for in the texts between numbers, so each is read once.
    """

    def kept(x: Column) -> Column:
        def about(number: Column, i: Column) -> Column:
            before, after = F.concat(F.when(i > 0, "0").otherwise(""), F.get(x["around"], i)), F.get(x["around"], i + 1)
            return F.struct(
                number.alias("number"),
                F.regexp_extract(after, r"\A([ \u00a0\u202f]?%)", 1).alias("percent"),
                (before.endswith("[") & after.startswith("]")).alias("mark"),
                (before.rlike(rf"(?U)(?:{_CURRENCIES})\s*\z") | after.rlike(rf"(?U)\A\s*(?i:{_MAGNITUDES})\b")).alias("sized"),
            )

        told = lambda y: (F.length(y["number"]) > 1) | (y["percent"] != "") | y["sized"]
        return F.filter(F.transform(x["found"], about), lambda y: ~y["mark"] & told(y))

    all_kept = let(between(F.coalesce(text, F.lit("")), _NUMBER), kept)
    read = F.transform(all_kept, lambda x: F.struct(F.concat(x["number"], x["percent"]).alias("text"), F.array_sort(readings(x["number"])).alias("readings")))
    return let(read, lambda all_: let(F.transform(all_, lambda x: x["readings"]), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, x["readings"]) == i + 1)))


def grounding(answer: Column, sources: Column) -> Column:
    """(checked, unsupported): how many distinct figures the answer has, and those, as written, of which no reading is in the sources. Null texts are empty."""
    known = F.flatten(F.transform(numbers(sources), readings))
    both = F.struct(figures(answer).alias("own"), F.array_distinct(known).alias("known"))
    lost = lambda x: F.transform(F.filter(x["own"], lambda f: ~F.arrays_overlap(f["readings"], x["known"])), lambda f: f["text"])
    return let(both, lambda x: F.struct(F.size(x["own"]).alias("checked"), lost(x).alias("unsupported")))


_WORD = re.compile(r"\w+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(1 << 16)
def _bare(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", run) if not unicodedata.combining(c))


def tokens_of(text: str | None) -> list[str]:
    """Lower-case words without accents: compatibility forms are taken apart and combining marks dropped."""
    low = (text or "").lower()
    if not low.isascii():  # forms are taken apart character by character, and only marks, which go, change places
        low = _NOT_ASCII.sub(lambda m: _bare(m[0]) if len(m[0]) < 8 else _bare.__wrapped__(m[0]), low)
    return _WORD.findall(low)
