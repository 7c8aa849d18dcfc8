"""Line rules on lines of any length."""

import duckdb
import oracle
from pyspark.sql import functions as F

from tarnspark.llm import line_cleaning, registry


def test_navigation_of_any_length_is_caught(spark):
    label = "Encyclopaedia internationally. "
    fails = {
        " » ".join([label.strip()] * 102): True,
        " » ".join([label.strip()] * 5000): True,
        " ".join(["home", "about", "Contact"] * 500): True,
        " ".join(["home", "about", "Contact"] * 500) + " sentence ends here.": False,
        "one two three. » four five six » seven": True,
        "one two three four. » five » six": False,
        "one. » two": False,
        "one two » three. » four five»": False,
        "one. » two » three » ": False,
        "one. » two » three\t": False,
        "home. | | | b": True,
        "A sentence of some words that goes on, and ends. " * 400: False,
    }
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(fails)], "k long, x string")
    got = {r.k: r.f for r in rows.select("k", line_cleaning.line_fails(F.col("x")).alias("f")).collect()}
    assert [got[k] for k in range(len(fails))] == list(fails.values())
    menu = spark.createDataFrame([(1, " » ".join([label.strip()] * 300))], "doc_id long, text string")
    assert not line_cleaning.clean_lines(menu).first().kept


def test_sql_and_operator_agree_on_lines_of_any_length(spark, tmp_path):
    label, good = "Encyclopaedia internationally.", "This is a sentence with enough words to stand on its own, and it ends well."
    lines = [
        " ".join(["home"] * 50),
        " ".join(["home"] * 51),
        " ".join(["home", "about"] * 250),
        "home     about     contact      cart",
        "\thome about",
        "home about \t",
        "home about\r",
        " » ".join([label] * 101),
        " » ".join([label] * 102),
        " » ".join([label] * 150),
        " » ".join([label] * 3) + "\r",
        " » ".join([label] * 3) + " \r",
        "one. | | | b",
        "one.   »  two\t»\ttwo three four five",
    ]
    rows = [(k, f"{x}\n{good}\n{good} More.") for k, x in enumerate(lines)] + [(100 + k, x) for k, x in enumerate(lines)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op10_line_cleaning"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        found = db.execute(registry.ORACLES["op10_line_cleaning"])
        want = oracle.rows_of([c[0] for c in found.description], found.fetchall())
    assert oracle.rows_of(got.columns, got.collect()) == want


def test_stage_keeps_columns_of_any_name(spark):
    good = "This is a sentence with enough words to stand on its own, and it ends well."
    names = [*line_cleaning.FIELDS, "_counts", "_judged", "Verdict", "_VERDICT", "words", "lines"]
    rows = [(1, good, *(f"own {c}" for c in names)), (1, good, *(f"own {c}" for c in names)), (2, "Home | About | Cart", *(f"own {c}" for c in names)), (None, f"{good}\nhome", *(f"own {c}" for c in names)), (3, None, *(f"own {c}" for c in names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names)]))
    out = line_cleaning.quality_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(1, good), (1, good), (None, good)]))
    assert all([r[c] for c in names] == [f"own {c}" for c in names] for r in got)
    assert line_cleaning.quality_stage(spark, docs.filter("doc_id = 9"), "").count() == 0
