"""Boxes of characters and stamps: words from characters, spaces that recognition left out, stamps that weren't read yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.geometry import box, iou

#: Widths of a character from which a gap is a space, and share of a box from which two are the same.
WIDE, SAME = 2.0, 0.5


def words_of(chars: Column) -> Column:
    """Words (text, x0, x1) of a line's characters (ch, x0, x1) in order, which spaces part."""
    none = F.lit(None).cast("struct<text:string,x0:double,x1:double>")
    start = F.struct(F.array().cast("array<struct<text:string,x0:double,x1:double>>").alias("done"), none.alias("now"))
    word = lambda text, a, b: F.struct(text.alias("text"), a.cast("double").alias("x0"), b.cast("double").alias("x1"))
    ended = lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"]))

    def step(s: Column, c: Column) -> Column:
        more = F.when(s["now"].isNull(), word(c["ch"], c["x0"], c["x1"])).otherwise(word(F.concat(s["now"]["text"], c["ch"]), F.least(s["now"]["x0"], c["x0"]), F.greatest(s["now"]["x1"], c["x1"])))
        return F.when(F.trim(c["ch"]) == "", F.struct(ended(s).alias("done"), none.alias("now"))).otherwise(F.struct(s["done"].alias("done"), more.alias("now")))

    return F.aggregate(chars, start, step, ended)


def restored_spaces(chars: Column) -> Column:
    """The characters' text (ch, x0, x1) with a space in each gap of WIDE usual widths or more between letters or figures; the usual width is the upper median."""
    widths = F.array_sort(F.transform(F.filter(chars, lambda c: F.trim(c["ch"]) != ""), lambda c: (c["x1"] - c["x0"]).cast("double")))
    usual = F.get(widths, F.floor(F.size(widths) / 2).cast("int"))
    shown = F.transform(chars, lambda c, k: F.concat(F.when(_parted(chars, c, k, usual), " ").otherwise(""), c["ch"]))
    return F.array_join(shown, "")


def _parted(chars: Column, c: Column, k: Column, usual: Column) -> Column:
    before = F.get(chars, k - 1)
    letters = r"[\p{L}\p{N}]"
    return F.coalesce((k > 0) & (c["x0"] - before["x1"] >= WIDE * usual) & c["ch"].rlike(letters) & before["ch"].rlike(letters), F.lit(False))


def unread(stamps: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Stamps of which no line of the same keys has the same letters, white space and case aside, in the same place. Both: keys, text and a box."""
    letters = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    own = lines.select(*(F.col(k).alias(f"line_{k}") for k in keys), letters(F.col("text")).alias("line_letters"), *(F.col(c).alias(f"line_{c}") for c in ("x0", "y0", "x1", "y1")))
    same = [stamps[k].eqNullSafe(own[f"line_{k}"]) for k in keys]
    meets = (letters(stamps["text"]) == own["line_letters"]) & (iou(box(), box("line_")) > SAME)
    for s in same:
        meets = meets & s
    return stamps.join(own, meets, "left_anti")
