"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width marks, soft hyphen and controls, which a clean text drops.
INVISIBLE = r"[\u0000-\u0008\u000e-\u001f\u007f­​-‏⁠﻿]"
SUPER, SUB = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₙ"
PLAIN = "0123456789+-=()n"


def clean(c: Column) -> Column:
    """Invisible characters dropped, white space of any kind as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), r"[\s   -     　]+", " "))


def key(c: Column) -> Column:
    """What repeated lines have in common: lower case, single spaces, runs of digits as #."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), "[0-9]+", "#")


def _mapped(c: Column, to: str) -> Column:
    return F.when(F.length(F.translate(c, PLAIN, "")) == 0, F.translate(c, PLAIN, to)).otherwise(c)


def superscript(c: Column) -> Column:
    """c in raised characters if all of it has them, else as it is."""
    return _mapped(c, SUPER)


def subscript(c: Column) -> Column:
    return _mapped(c, SUB)


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_csv(c: Column) -> Column:
    """Quoted where a comma, quote or line break asks for it."""
    return F.when(F.regexp_count(c, F.lit('[",\n\r]')) > 0, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def escape_cell(c: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.replace(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def escape_pdf(c: Column) -> Column:
    for a in ("\\", "(", ")"):
        c = F.replace(c, F.lit(a), F.lit(f"\\{a}"))
    return c


def roman(n: Column) -> Column:
    """1 to 3999 in Roman numerals, else the digits."""
    places = ((1000, ("", "M", "MM", "MMM")), (100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    parts = [F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor(n / size), F.lit(10)) + 1).cast("int")) for size, names in places[1:]]
    thousands = F.element_at(F.array(*map(F.lit, places[0][1])), (F.floor(n / 1000) + 1).cast("int"))
    return F.when(n.between(1, 3999), F.concat(thousands, *parts)).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """1 is a, 26 z, 27 aa, 28 bb: the letter repeats once more for each round."""
    letter = F.char((F.lit(97) + F.pmod(n - 1, F.lit(26))).cast("int"))
    return F.when(n >= 1, F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise(n.cast("string"))


def number(c: Column) -> Column:
    """A number's text without float noise: whole numbers up to 2^53 without a point, others to 15 digits."""
    x = c.try_cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) <= float(1 << 53))
    return F.when(x.isNull() | F.isnan(x), c).when(whole, x.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.round(x, 12).cast("string"), r"\.?0+$", ""))


def excel_date(serial: Column, base_1904: bool = False) -> Column:
    """A spreadsheet's day number as a timestamp in UTC, to the second; the 1900 system's 29 February is skipped, days before 1 give null."""
    shift = F.lit(1462.0) if base_1904 else F.when(serial < 61, F.lit(1.0)).otherwise(F.lit(0.0))
    seconds = F.floor((serial + shift - 25569.0) * 86400 + 0.5).cast("bigint")
    return F.when(serial >= 1, F.timestamp_seconds(seconds)) if not base_1904 else F.when(serial >= 0, F.timestamp_seconds(seconds))


def duration(serial: Column) -> Column:
    """[h]:mm:ss of a number of days."""
    s = F.floor(serial * 86400 + 0.5).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def cell_place(c: Column) -> Column:
    """Row and column, from 0, of a cell's name like $A$1."""
    name = F.upper(F.regexp_extract(c, r"^\$?([A-Za-z]+)\$?([0-9]+)$", 1))
    column = F.aggregate(F.split(name, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    row = F.regexp_extract(c, r"^\$?([A-Za-z]+)\$?([0-9]+)$", 2).try_cast("int")
    return F.when(row.isNotNull(), F.struct((row - 1).alias("row"), (column - 1).alias("column")))


def date(c: Column) -> Column:
    """An ISO 8601 date or time, in UTC; fractions of a second are dropped; null for anything else."""
    day = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    time = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(day | time, F.regexp_replace(c, r"\.\d+", "").try_cast("timestamp"))


def yaml(c: Column) -> Column:
    """A string as a YAML scalar: quoted as in JSON."""
    made = F.to_json(F.struct(c.alias("v")))
    return F.substring(made, 6, F.length(made) - 6)


def size_text(n: Column) -> Column:
    """Bytes for people: B, kB, MB, GB in thousands."""
    return F.when(n < 1000, F.format_string("%d B", n.cast("bigint"))).when(n < 1e6, F.format_string("%.1f kB", F.round(n / 1e3, 1))).when(n < 1e9, F.format_string("%.1f MB", F.round(n / 1e6, 1))).otherwise(F.format_string("%.1f GB", F.round(n / 1e9, 1)))


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%d ms", ms.cast("bigint"))).when(ms < 60_000, F.format_string("%.1f s", ms / 1e3)).otherwise(F.format_string("%d min %d s", F.floor(ms / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000)))


def count_text(n: Column, one: str, more: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more or one + 's'}"))


def page_ranges(pages: Column) -> Column:
    """p. 3 or pp. 1-3, 5: distinct pages in order; three or more in a row are a range, two are listed."""
    p = F.array_sort(F.array_distinct(pages))
    starts = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
    ends = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).when(b == a + 1, F.concat(a.cast("string"), F.lit(", "), b.cast("string"))).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))
    return F.when(F.size(p) == 0, "").when(F.size(p) == 1, F.concat(F.lit("p. "), p[0].cast("string"))).otherwise(F.concat(F.lit("pp. "), F.array_join(runs, ", ")))


def shard(path: Column, k: int, n: int) -> Column:
    """Whether the path belongs to shard k of n."""
    return F.pmod(F.crc32(path.cast("binary")), F.lit(n)) == k - 1


def is_unspaced(c: Column) -> Column:
    """Scripts that are written without spaces."""
    return c.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}]")


def is_right_to_left(c: Column) -> Column:
    return c.rlike(r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}]")


def is_figure(c: Column) -> Column:
    """Amounts, percentages and other numbers."""
    return F.trim(c).rlike(r"^[+\-−(]?\s*[€$£¥]?\s*\d[\d.,'  ]*\s*(%|€|\$|£|¥|EUR|USD|CHF|GBP)?\)?$")


def data_uri(c: Column) -> Column:
    """mime and content of a data: address in base 64; null for others."""
    head = r"^data:([^;,]*)(?:;[^;,]*)*;base64,(.*)$"
    return F.when(c.rlike(head), F.struct(F.regexp_extract(c, head, 1).alias("mime"), F.try_to_binary(F.regexp_extract(c, head, 2), F.lit("base64")).alias("content")))


def suffix(path: Column) -> Column:
    """The file's suffix in lower case with its point, empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[A-Za-z0-9]+)$", 1))


def safe_name(c: Column, most: int = 200, kept: int = 188) -> Column:
    """A name of at most `most` bytes: a longer one keeps its start and ten digits of its hash."""
    raw = c.cast("binary")
    start = F.regexp_replace(F.try_validate_utf8(F.substring(raw, 1, kept).cast("string")), "�+$", "")
    start = F.coalesce(start, F.try_validate_utf8(F.substring(raw, 1, kept - 1).cast("string")), F.try_validate_utf8(F.substring(raw, 1, kept - 2).cast("string")), F.try_validate_utf8(F.substring(raw, 1, kept - 3).cast("string")))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(start, F.lit("~"), F.substring(F.sha1(raw), 1, 10)))
