"""Rows leave by row, also where rows of unequal texts share an id."""

from waymark.llm import decontaminate, near_copies

SCHEMA = "doc_id long, text string, id string, fp string, component string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def test_near_duplicates_leave_by_row(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "rot grün blau gelb", "uno dos tres cuatro")
    rows = [(3, a), (5, a), (5, b), (6, c), (6, d), (6, d.upper()), (7, b), (8, c), (None, a), (9, None), (9, d)]
    kept = near_copies.representatives(rows_of(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(3, a), (5, b), (6, c), (9, None)]
    assert got in (sorted([*want, (6, d)], key=str), sorted([*want, (6, d.upper())], key=str))


def test_contaminated_rows_leave_by_row(spark):
    item = " ".join(f"question{k}" for k in range(40))
    clean = " ".join(f"prose{k}" for k in range(40))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, clean), (1, clean), (2, clean), (3, item), (3, item), (4, None), (4, item), (None, item)]
    kept = decontaminate.decontaminated(rows_of(spark, rows), items)
    assert kept.columns == rows_of(spark, []).columns
    want = [(1, clean), (1, clean), (2, clean), (4, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
