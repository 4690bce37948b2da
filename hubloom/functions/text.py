"""Text expressions: list texts, line names, Hebrew checks, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubloom.functions import settings as S


def split_list(c: Column) -> Column:
    """Brackets and quotes removed, split at commas, empty items left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"""[\[\]'"]""", ""), ","), F.trim), lambda x: x != "")


def first_of_list(c: Column) -> Column:
    return F.get(split_list(c), 0)


def parse_lines(c: Column) -> Column:
    """The distinct names of a nested list text, in order; blanks separate as commas do."""
    items = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"""[\[\]'"\r]""", ""), r"[,\s]+")
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def node_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))


def clean_line_name(c: Column) -> Column:
    """Carriage returns and line feeds, real or written as escapes, removed; blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\\r|\\n|\r|\n", ""), r"[\t ]+", " "))


def hebrew_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\u0590-\u05FF]", ""))


def hebrew_ratio(c: Column) -> Column:
    """Share of Hebrew among the characters that are no blanks; null where there are none."""
    return F.try_divide(hebrew_letters(c).cast("double"), F.length(F.regexp_replace(c, r"\s", "")))


def is_valid_hebrew(c: Column, least: float = 0.3) -> Column:
    """True for text of enough Hebrew, and for text of no characters but blanks or null."""
    blank = c.isNull() | (F.length(F.regexp_replace(c, r"\s", "")) == 0)
    return blank | F.coalesce(hebrew_ratio(c) >= least, F.lit(False))


def fix_truncated(c: Column) -> Column:
    """Words an export cut short completed: the whole text first, else word by word, in the table's order."""
    whole = F.create_map(*(F.lit(x) for kv in S.TRUNCATED.items() for x in kv))
    words = c
    for cut, full in S.TRUNCATED.items():
        words = F.regexp_replace(words, rf"(?U)\b{cut}\b", full)
    return F.coalesce(F.try_element_at(whole, c), words)


def correct_area(c: Column) -> Column:
    """The whole name of an area of which only the first word is left; any other stays."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in S.AREAS_BY_FIRST_WORD.items() for x in kv)), c), c)


def fix_mojibake(c: Column) -> Column:
    """windows-1255 text that was read as latin-1; anything else stays. Needs spark.sql.legacy.javaCharsets."""
    raw = F.when(c.rlike(r"^[\x00-\xFF]*$") & c.rlike(r"[\xE0-\xFA]"), c)
    return F.coalesce(F.decode(F.encode(raw, "ISO-8859-1"), "windows-1255"), c)


def wkt_point(c: Column) -> tuple[Column, Column]:
    """x and y of a POINT text; null for anything else."""
    p = r"POINT\s*\(([\d.-]+)\s+([\d.-]+)\)"
    return F.regexp_extract(c, p, 1).try_cast("double"), F.regexp_extract(c, p, 2).try_cast("double")


def hub_name(name: Column, address: Column, group: Column) -> Column:
    first = F.nullif(F.trim(F.get(F.split(address, ","), 0)), F.lit(""))
    return F.coalesce(name, first, F.concat(F.lit("Hub "), group.cast("string")))


def safe_file_name(c: Column) -> Column:
    return F.translate(c, "/\\ ", "___")
