"""Queries against their SQL twins on small tables of rows that the test tables lack at the small sizes."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkfolio import queries as core
from sparkfolio.operators import metrics
from sparkfolio.sources import html_reader


def both(spark, folder, name, **tables):
    """The sorted rows of a query and of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = core.QUERIES[name](spark, str(folder)), con.sql(core.ORACLES[name])
    assert got.columns == want.columns
    return sorted(tuple(r) for r in got.collect()), sorted(want.fetchall())


def test_closest_lines_of_other_letters(spark, tmp_path):
    texts = ["De aieaulement, aipa re reai aich treelle échleeau. Évian. Elle.\nthe licence", "é\nthe lïcense\n日本 語 のライセンス", "the license"]
    got, want = both(spark, tmp_path, "closest_three", documents=[{"doc_id": k, "text": t, "lang": "en", "source": "s"} for k, t in enumerate(texts)])
    assert got == want and (2, "the license", 1.0) in got


def test_titles_are_as_written_but_for_ampersands(spark, tmp_path):
    titles = ["token = &quot;7702344ead3", "ver&amp", "A &amp; B", "&amp;quot; &lt;b&gt;", "&amp;amp;", "", "  a\n b ", "x&#228;y &nbsp;z &"]
    got, want = both(spark, tmp_path, "html_metadata", pages=[{"page_id": k, "html": f'<html lang="de"><head><title>{t}</title></head><body><p>x</p></body></html>'} for k, t in enumerate(titles)])
    assert got == want and got[0] == (0, "de", titles[0])
    notes = [html_reader.html_note(f"<title>{t}</title>").meta.get("title") for t in titles]
    assert notes[0] == 'token = "7702344ead3' and notes[1] == "ver&"


def test_word_errors_of_pairs_with_many_distinct_words(spark):
    """By counting words: more than 95 of them are distinct, where the SQL's symbols begin to take two bytes."""
    a = [f"a{k}" for k in range(60)]
    b = [w if k % 2 else f"b{k}" for k, w in enumerate(a)] + [f"c{k}" for k in range(20)]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert len({*a, *b}) > 95
    rows = spark.createDataFrame([(" ".join(a), " ".join(b))], "expected string, found string")
    assert rows.select(metrics.wer(F.col("expected"), F.col("found")).alias("wer")).head()["wer"] == pytest.approx(row[-1] / len(a))
