"""Fixtures as rows: nulls, empty and very long texts, ties, repeated rows, columns whose names clash."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ROWS = [
    (1, "The quick brown fox.\nIt jumps over.\nThe lazy dog sleeps.\nAgain.", "a"), (2, "The quick  brown fox. It jumps over. The lazy dog sleeps. Again.", "a"),
    (3, None, None), (4, "", "b"), (5, " \t\n", "b"), (6, LONG, "c"), (6, LONG, "c"), (7, LONG + " end", None), (8, "ÄÖ ß 你好 🙂 'tis <|endoftext|> DON'T", "ä"),
    (9, "a" * 3000, "c"), (10, "one", "z"), (10, "two", "z"), (None, "one", "z"), (11, "x\ny\nx\ny\nx\ny", "q"),
]
SCHEMA = ("doc_id long, text string, source string, size string, block string, row string, kept string, fp string, weight string, "
          "score string, _h string, _n string, _part string, _hash string, doc string, rest string, nth string, hash string, id string")


def fixture(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *"sbrkfw", *"0123456789") for r in rows], SCHEMA)


def empty(spark):
    return fixture(spark, [])


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(spark, sf_dir, df):
    """Rows (doc_id, text) of a table and of the fixture."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
