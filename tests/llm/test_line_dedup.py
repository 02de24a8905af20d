import pytest

from tests.llm.brute import SPACE, brute_lines, lines_gone
from waymark.llm import line_dedup


def run(spark, rows, **how):
    df = spark.createDataFrame(
        [(i, t, 1, "h", "k", 2, "x") for i, t in rows], "doc_id long, text string, id int, h string, k string, __row int, `row` string"
    )
    out = line_dedup.deduplicated(df, **how)
    assert out.columns[:7] == df.columns
    return out.collect()


def test_documents_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_lines(dict(rows))
    assert want != dict(rows) and {r.doc_id: r.text for r in run(spark, rows)} == want


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 30])
def test_passage_goes_whole_whatever_stands_around_it(spark, size):
    for salt in range(3):
        passage = "\n".join(f"{salt} {k} " + " ".join(f"w{x}" for x in range(max(3, 60 // size))) for k in range(size))
        rows = [(1, "head\n" + passage), (2, "other head\nand more\n" + passage + "\n\ntail"), (3, passage)]
        got = {r.doc_id: (r.text, r.lines_before - r.lines_after) for r in run(spark, rows, report=True)}
        assert got == {1: ("head\n" + passage, 0), 2: ("other head\nand more\n\ntail", size), 3: ("", size)}


def test_every_repeated_run_is_covered(spark, sf_dir):
    """All pairs of lines: whatever run of over 50 words stands at an earlier place, its lines go."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 3 = 0").collect()}
    lines = {i: [x for x in t.split("\n") if SPACE.search(x)] for i, t in rows.items()}
    kept = {r.doc_id: [x for x in r.text.split("\n") if SPACE.search(x)] for r in run(spark, [(i, "\n".join(t)) for i, t in lines.items()])}
    places, long = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))], {}
    for n, (i, k) in enumerate(places):
        for j, m in places[:n]:
            size = 0
            while k + size < len(lines[i]) and m + size < len(lines[j]) and lines[i][k + size] == lines[j][m + size]:
                size += 1
            if len(SPACE.findall(" ".join(lines[i][k : k + size]))) > 50:
                long.setdefault(i, set()).update(range(k, k + size))
    gone = lines_gone({i: "\n".join(t) for i, t in lines.items()})
    assert long and all(found <= gone[i] for i, found in long.items())
    assert kept == {i: [x for k, x in enumerate(t) if k not in gone[i]] for i, t in lines.items()}


def test_odd_rows(spark):
    block = "one line\nand two\nand three\nand four\nand five"
    long = "ein Wort " * 40
    rows = [
        (1, None), (2, ""), (3, "\n\n\n\n\n\n"), (4, "\n\n\n\n\n\n"), (5, long + "\n" + block), (5, long + "\n" + block), (None, long), (None, long + "\nelse"),
        (7, "x" * 2_000_000 + "\n" + long), (8, "single"), (9, "single"),
    ]
    by = {}
    for r in run(spark, rows, report=True):
        by.setdefault(r.doc_id, []).append((r.text, r.lines_before, r.lines_after))
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 1, 1)] and by[8] == by[9] == [("single", 1, 1)]
    assert by[7] == [("x" * 2_000_000, 2, 1)]
    first, again = sorted(by[5], key=lambda x: -x[2])
    assert first == (long + "\n" + block, 6, 6) and again[2] < 6 and long not in again[0]
    assert sorted(by[None]) == [("", 1, 0), ("else", 2, 1)]  # rows without an id are rows of their own, after all others
    assert run(spark, []) == []


def test_rows_without_ids_against_brute_force(spark):
    head = "\n".join(f"line {k} of " + "many words " * 6 for k in range(8))
    rows = [head, head, head + "\nand a last line of its own"]
    got = sorted((r.text for r in run(spark, [(None, t) for t in rows])), key=len)
    assert got == ["", "and a last line of its own", head] or got == ["", "", head + "\nand a last line of its own"]


def test_work_grows_with_the_lines(spark):
    import time

    def seconds(n):
        text = "\n".join(f"line {k} {k * k}" for k in range(n))
        began = time.perf_counter()
        got = run(spark, [(1, text), (2, text)])
        assert {r.doc_id: r.text for r in got} == {1: text, 2: ""}
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(16_000), seconds(64_000)
    assert large < 4 * small + 4  # the quadratic way took half a minute


def test_unequal_bytes_of_one_hash_stay(spark, monkeypatch):
    """With a hash under which everything is equal, only equal bytes may go."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: line_dedup.F.length(c[0]).cast("long") * 0)
    rows = [(1, "a\nb\nc\nd\ne\nf\ng\nh"), (2, "p\nq\nr\ns\nt\nu\nv\nw")]
    assert {r.doc_id: r.text for r in run(spark, rows)} == dict(rows)
