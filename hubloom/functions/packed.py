"""Several values packed in one text: split into one item per row, position kept.

The text is taken apart in the JVM, by expressions alone:

1. wrappers such as ``np.int64(7)`` and quotes around a whole inner list are removed;
2. every quoted span is exchanged for a placeholder that holds its index, so that
   delimiters inside quotes no longer count. The characters that placeholders use are
   themselves written as such where the text holds them already: nothing can collide;
3. brackets and the remaining delimiters are split;
4. each placeholder is looked up in the array of spans, and unquoted and unescaped;
5. the items are exploded with their positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"
#: Escaped characters while the text is taken apart.
ESCAPED = (("\\\\", "\ue004", "\\"), ('\\"', "\ue002", '"'), ("\\'", "\ue003", "'"))
#: A quoted span that begins an item or another span, and ends one. Escapes are out of the
#: way by then, and a doubled quote is two spans side by side, so this has no inner loops:
#: Java's matcher would need stack for each of their turns, and texts may be very long.
SPAN = r"""(?<![^\s,;|/\[{("])"[^"]*+"(?=[\s,;|/\]})"]|$)|(?<![^\s,;|/\[{(])'[^']*+'(?=[\s,;|/\]})]|$)"""
#: Values that stand for no value.
EMPTY = ("", "nan", "none")


def _reserved() -> list[tuple[str, str]]:
    """The characters with a meaning here, and what stands for them where the text holds them."""
    return [(c, f"{OPEN}-{name}{CLOSE}") for c, name in zip((OPEN, *(e[1] for e in ESCAPED)), "abcd")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _with_placeholders(gaps: Column, spans: Column) -> Column:
    marks = F.concat(F.transform(spans, lambda s, i: F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    # blanks beside a span always separate
    return F.regexp_replace(whole, rf"(?<=\d{CLOSE})\s+|\s+(?={OPEN}\d)", ",")


def _body(span: Column) -> Column:
    """A span without its quotes; a protected phrase as it is."""
    return F.when(span.rlike(r"""^["']"""), span.substr(F.lit(2), F.length(span) - 2)).otherwise(span)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def packed_items(text: Column, blanks: str = "codes", phrases: tuple[str, ...] = ()) -> Column:
    """The items of a packed text in the order written, as an array of strings.

    blanks: "always" — every blank separates; "codes" — a blank separates only where
    all words around it are codes, that is hold a letter and a digit, so that names
    such as ``Nenet Line 7`` stay whole. phrases: items known to hold blanks, kept whole.
    Repeated items stay; empty ones, nan and None are left out. A null text gives null,
    an empty one no items. A quote within a word, or never closed, is an ordinary character.
    """
    t = _replaced(text, _reserved())
    t = _replaced(t, [(written, kept) for written, kept, _ in ESCAPED])
    t = F.regexp_replace(t, r"\bnp\.\w+\(([^()]*)\)", "$1")
    t = F.regexp_replace(t, r"""(?<![^\s,\[{])["'](?=\s*\[)|(?<=\])\s*["'](?=\s*[,\]}]|\s*$)""", " ")
    span = SPAN
    if phrases:
        words = "|".join(rf"\Q{p}\E" for p in sorted(phrases, key=len, reverse=True))
        span += rf"|(?<![^\s,;|/\[{{(])(?:{words})(?=[\s,;|/\]}})]|$)"

    def words(c: Column) -> Column:
        parts = F.split(c, r"\s+")
        if blanks == "always":
            return parts
        codes = F.forall(parts, lambda w: w.rlike(r"\d") & w.rlike(r"\p{L}"))
        return F.when((F.size(parts) > 1) & codes, parts).otherwise(F.array(c))

    def items(taken: Column) -> Column:
        spans = taken["spans"]
        chunks = F.transform(F.split(F.regexp_replace(_with_placeholders(taken["gaps"], spans), r"[\[\]{}]", ","), r"[,;|/\t\r\n]+"), _trimmed)

        def restored(p: Column) -> Column:
            numbers = F.regexp_extract_all(p, F.lit(rf"{OPEN}(\d+){CLOSE}"), F.lit(1))
            bodies = F.transform(numbers, lambda i: _body(F.get(spans, i.try_cast("int"))))
            return F.when(p.rlike(rf"^{OPEN}\d") & p.rlike(rf"\d{CLOSE}$"), F.array_join(bodies, '"')).otherwise(p)

        back = [(kept, c) for _, kept, c in ESCAPED] + [(n, o) for o, n in _reserved()]
        all_items = F.transform(F.flatten(F.transform(chunks, words)), restored)
        return F.transform(all_items, lambda p: _trimmed(_replaced(F.regexp_replace(p, r"\\(.)", "$1"), back)))

    taken = _let(t, lambda x: F.struct(F.regexp_extract_all(x, F.lit(span), F.lit(0)).alias("spans"), F.split(x, span, -1).alias("gaps")))
    return F.filter(_let(taken, items), lambda p: ~F.lower(p).isin(*EMPTY))


def whole_number(item: Column) -> Column:
    """An item as a whole number, digits only; null if it isn't one."""
    digits = F.regexp_extract(item, r"^\+?0*(\d+?)(?:\.0*)?$", 1)
    return F.when(digits != "", digits).otherwise(
        F.when(item.rlike(r"^\d+(?:\.\d+)?[eE]\+?\d+$"), item.try_cast("double").try_cast("bigint").cast("string"))
    )


def explode_packed(df: DataFrame, items: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per item: the kept columns, field, pos from 1, item.

    items: by field, an array of strings. Every row is read once; nothing is shuffled.
    """
    fields = F.array(
        *(F.struct(F.lit(name).alias("field"), array.alias("items")) for name, array in items.items())
    )
    return (
        df.select(*keep, F.explode(fields).alias("_f"))
        .select(*keep, F.col("_f.field").alias("field"), F.posexplode("_f.items").alias("pos", "item"))
        .withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    )
