"""From pages to a running text: what repeats in margins, levels of headings, lines and pages that go on, nested lists.

Lines and blocks come as rows with the number of their page. Each operator is an aggregation by document,
or works within a row's array; nothing is gathered beyond a document's headings or a list's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.functions.text import key

#: Share of a level's size below which a heading is a level deeper, levels at most, share of pages that make a repetition.
STEP, LEVELS, SHARE = 0.88, 6, 0.5
#: A page number, by itself or with a word and the number of pages.
PAGE_NUMBER = r"^(?:(?i:page|seite|página|pagina|p\.|s\.)\s*)?[-–—\[(]?\s*\d{1,4}\s*[-–—\])]?(?:\s*(?:/|(?i:of|von|de|sur|di|aus))\s*\d{1,4})?$"
#: Room beside the next word, in heights of a line, from which a break was meant.
ROOM = 0.35


def needed(n_pages: Column) -> Column:
    """Pages on which a line must stand to count as repeated: half of them and three, both of two, none of a single one."""
    return F.when(n_pages >= 3, F.greatest(F.lit(3.0), SHARE * n_pages)).when(n_pages == 2, F.lit(2.0))


def boilerplate(lines: DataFrame, doc: str) -> DataFrame:
    """doc and key of the lines in header or footer bands that repeat over a document's pages. lines: doc, page, zone and text."""
    n_pages = lines.groupBy(doc).agg(F.countDistinct("page").alias("n_pages"))
    margins = lines.where("zone != 'body'").select(doc, "page", key(F.col("text")).alias("key")).distinct()
    repeated = margins.groupBy(doc, "key").agg(F.count("*").alias("n"))
    own = n_pages.withColumnRenamed(doc, "own")
    return repeated.join(own, repeated[doc].eqNullSafe(own["own"])).where(F.col("n") >= needed(F.col("n_pages"))).select(doc, "key")


def without_boilerplate(lines: DataFrame, doc: str) -> DataFrame:
    """lines without repeated margins and without page numbers in margins; a document of one page keeps all."""
    margin = F.col("zone") != "body"
    several = F.max("page").over(Window.partitionBy(doc)) != F.min("page").over(Window.partitionBy(doc))
    kept = lines.withColumn("key_", F.when(margin, key(F.col("text")))).withColumn("number_", margin & F.trim("text").rlike(PAGE_NUMBER) & several)
    gone = boilerplate(lines, doc).select(F.col(doc).alias("own"), F.col("key").alias("gone"))
    kept = kept.join(gone, kept[doc].eqNullSafe(gone["own"]) & (kept["key_"] == gone["gone"]), "left_anti")
    return kept.where("not number_").drop("key_", "number_")


def repeated_headings(blocks: DataFrame, doc: str) -> DataFrame:
    """doc and key of headings at the edge of a page (first or last block) that stand on half of the pages, three at least. blocks: doc, page, ord, kind, text."""
    page = Window.partitionBy(doc, "page")
    edge = (F.col("ord") == F.min("ord").over(page)) | (F.col("ord") == F.max("ord").over(page))
    n_pages = blocks.groupBy(doc).agg(F.countDistinct("page").alias("n_pages"))
    found = blocks.withColumn("edge", edge).where("edge and kind = 'heading'").select(doc, "page", key(F.col("text")).alias("key")).distinct()
    return found.groupBy(doc, "key").agg(F.count("*").alias("n")).join(n_pages, doc).where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("n_pages") * SHARE))).select(doc, "key")


def heading_levels(headings: DataFrame, doc: str, size: str) -> DataFrame:
    """doc, size and level of a document's heading sizes: a size below STEP of its level's largest opens a deeper one."""
    sizes = headings.groupBy(doc).agg(F.sort_array(F.collect_set(size), asc=False).alias("sizes"))
    start = F.struct(F.lit(0.0).alias("anchor"), F.lit(0).alias("level"), F.array().cast("array<struct<size:double,level:int>>").alias("made"))

    def step(s: Column, x: Column) -> Column:
        deeper = (s["level"] == 0) | (x < STEP * s["anchor"])
        level = F.when(deeper & (s["level"] < LEVELS), s["level"] + 1).otherwise(s["level"])
        return F.struct(F.when(deeper, x).otherwise(s["anchor"]).alias("anchor"), level.alias("level"), F.array_append(s["made"], F.struct(x.alias("size"), level.alias("level"))).alias("made"))

    made = F.aggregate(F.transform("sizes", lambda x: x.cast("double")), start, step)["made"]
    return sizes.select(doc, F.explode(made).alias("m")).select(doc, F.col("m.size").alias(size), F.col("m.level").alias("level"))


def joined_lines(lines: Column, right: Column) -> Column:
    """Text of a paragraph's lines (structs of text, x1, height and char, the width of a character) up to the edge right.

    A break stays where the next line's first word had fitted beside the line with room to spare, unless the
    next line goes on in small letters and there wasn't twice that room.
    """

    def joined(s: Column, x: Column) -> Column:
        word = F.length(F.regexp_extract(x["text"], r"^\S*", 0)) * x["char"]
        least = word + ROOM * s["last"]["height"]
        room = right - s["last"]["x1"]
        kept = (room > least) & ~(x["text"].rlike(r"^\p{Ll}") & (room <= 2 * least))
        text = F.when(s["last"].isNull(), x["text"]).otherwise(F.concat(s["text"], F.when(kept, "\n").otherwise(" "), x["text"]))
        return F.struct(text.alias("text"), x.alias("last"))

    kind = "struct<text:string,x1:double,height:double,char:double>"
    same = F.transform(lines, lambda x: F.struct(x["text"].alias("text"), x["x1"].cast("double").alias("x1"), x["height"].cast("double").alias("height"), x["char"].cast("double").alias("char")))
    return F.aggregate(same, F.struct(F.lit("").alias("text"), F.lit(None).cast(kind).alias("last")), joined)["text"]


def goes_on(text: Column, after: Column) -> Column:
    """Whether a paragraph that ends a page goes on in the one that begins the next: no sentence has ended, and it goes on in small letters or behind a hyphen or comma."""
    return ~text.rlike(r"[.!?:;…][\"'»”)\]]*\s*$") & (after.rlike(r"^\s*\p{Ll}") | text.rlike(r"(\p{L}-|,)\s*$"))


def joined_pages(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks (doc, page, ord, kind, text) with paragraphs that go on over pages as one, at the place of the first."""
    order = Window.partitionBy(doc).orderBy("page", "ord")
    same = (F.lag("kind").over(order) == "paragraph") & (F.col("kind") == "paragraph") & (F.lag("page").over(order) < F.col("page"))
    rows = blocks.withColumn("on", F.coalesce(same & goes_on(F.lag("text").over(order), F.col("text")), F.lit(False)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("page", "ord", "text", "kind")))
    made = rows.groupBy(doc, "part").agg(parts.alias("p"))
    text = F.aggregate(
        F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0]["text"],
        lambda a, x: F.when(a.rlike(r"\p{L}-$") & x["text"].rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), x["text"])).otherwise(F.concat(a, F.lit(" "), x["text"])),
    )
    return made.select(doc, F.col("p")[0]["page"].alias("page"), F.col("p")[0]["ord"].alias("ord"), F.col("p")[0]["kind"].alias("kind"), text.alias("text"))


def nested(indents: Column, tolerance: float) -> Column:
    """Depth of each item of a list from its left edge, 0 outermost: an item stands under the nearest one before it that begins further left."""
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("open"), F.array().cast("array<int>").alias("depths"))

    def step(s: Column, x: Column) -> Column:
        left = F.filter(s["open"], lambda e: e < x - tolerance)
        return F.struct(F.array_append(left, x).alias("open"), F.array_append(s["depths"], F.size(left)).alias("depths"))

    return F.aggregate(F.transform(indents, lambda x: x.cast("double")), start, step)["depths"]


def is_listing(lines: Column) -> Column:
    """Whether lines read as code: most end in signs of code, are indented in steps, or assign or call."""
    sign = lambda x: x.rlike(r"[;{}]\s*$|^\s*(?:def|class|return|import|from|if|for|while|else|function|var|let|const|public|private|#include|SELECT|INSERT)\b|^\s*[\w.]+\s*(?:=|\+=|:=)\s*\S|\w\([^)]*\)\s*[;:{]?\s*$|^\s*(?:\"[^\"]+\"\s*:|\[[\w.]+\]\s*$|</?\w)")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    return (F.size(full) >= 2) & (F.size(F.filter(full, sign)) >= 0.6 * F.size(full))
