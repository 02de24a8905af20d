"""Deduplication of repeated passages by content-defined line chunks, in DataFrame expressions only.

A text is its lines. A rolling hash over the hashes of ``window`` successive lines ends a chunk after every line
where it is divisible by ``divisor``; the choice looks at those lines alone, so inserted or lost lines move no
later boundary. Chunks at the edges of a shared passage hold foreign lines too, so chunks alone miss its head and
tail, and short passages whole. Each text therefore also gives its least passages: the shortest run of lines of over
``words`` words from each line on, and up to each line. Every repeated run of over ``words`` words is covered by them.

A chunk of at least ``min_lines`` lines, or a least passage, that stands at more than one place of the corpus is kept
at the first place (smallest id, then position) and its lines go elsewhere, once equal hashes are equal bytes. So a
shared passage goes whole, whatever stands around it, and each line that goes stands in an equal passage before it.

Hashes and places are shuffled first, without texts. Texts are shuffled once, to meet the removals of their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import discard, numbered, staged

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
FACTOR = 31
WORDS = 50
NEAR_LINES = 4
REPORT = ("lines_before", "lines_after", "passages_removed")
WORD = r"[^\x20\x09-\x0D]+"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rolling(hashes: Column, i: Column, window: int) -> Column:
    out = F.get(hashes, i)
    for back in range(1, window):
        out = out + F.coalesce(F.get(hashes, i - back), F.lit(0).cast("long")) * (FACTOR**back)
    return out


def _span(first: Column, after: Column) -> Column:
    return F.struct(first.cast("int").alias("i"), after.cast("int").alias("j"))


def chunk_spans(lines: Column, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> Column:
    """The chunks of at least ``min_lines`` lines, each as (first line, line after the last)."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)

    def ends_of(h: Column) -> Column:
        return F.filter(numbers, lambda i: (_rolling(h, i, window) % divisor == 0) | (i == F.size(lines) - 1))

    def of(ends: Column) -> Column:
        begin = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
        return F.filter(F.transform(ends, lambda e, k: _span(begin(k), e + 1)), lambda s: s["j"] - s["i"] >= min_lines)

    return _bound(_bound(hashes, ends_of), of)


def passage_spans(lines: Column, words: int = WORDS) -> Column:
    """The least passages of over ``words`` words from every line that has words on, and up to it, as (first line, line
    after the last). A line with words has one at least, so that ``words + 1`` such lines are enough to look at."""
    counted = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("w")))

    def of(full: Column) -> Column:
        def reach(k: Column, step: int, most: int = NEAR_LINES) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
            word = lambda d: F.coalesce(F.get(full, k + step * d)["w"], F.lit(0))
            add = lambda a, d: F.when(a["sum"] > words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + word(d)).alias("sum")))
            found = F.aggregate(F.array(*map(F.lit, range(most))), start, add, lambda a: F.when(a["sum"] > words, a["n"]))
            return found if most > words else F.coalesce(found, reach(k, step, words + 1))  # few lines are enough as a rule

        line = lambda k: F.get(full, k)["i"]
        numbers = F.when(F.size(full) > 0, F.sequence(F.lit(0), F.size(full) - 1)).otherwise(F.array().cast("array<int>"))
        on = F.transform(numbers, lambda k: _bound(reach(k, 1), lambda n: F.when(n.isNotNull(), _span(line(k), line(k + n - 1) + 1))))
        back = F.transform(numbers, lambda k: _bound(reach(k, -1), lambda n: F.when(n.isNotNull(), _span(line(k - n + 1), line(k) + 1))))
        return F.filter(F.concat(on, back), lambda s: s.isNotNull())

    return _bound(F.filter(counted, lambda x: x["w"] > 0), of)


def _distinct(spans: Column) -> Column:
    """Each span once. They are compared as numbers (line and length, whose halves differ, as hashes fold them together):
    distinct structs would be found by comparing all with all."""
    numbers = F.array_distinct(F.transform(spans, lambda s: F.shiftleft(s["i"].cast("long"), 32) + s["j"] - s["i"]))
    return F.transform(numbers, lambda n: _span(F.shiftright(n, 32), F.shiftright(n, 32) + n.bitwiseAND(F.lit((1 << 32) - 1))))


def _text_of(lines: Column, span: Column) -> Column:
    """The lines of a span; taken one by one, as ``slice`` would copy the whole array for each."""
    return F.array_join(F.transform(F.sequence(span["i"], span["j"] - 1), lambda t: F.get(lines, t)), "\n")


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    divisor: int = DIVISOR,
    min_lines: int = MIN_LINES,
    words: int = WORDS,
    report: bool = False,
) -> DataFrame:
    """``docs`` with repeated passages removed from its texts; other columns and all rows stay.

    ``report`` adds the columns ``REPORT``, to which others of those names give way. A null text stays null; a text of which
    all is repeated becomes empty. Rows are judged each, in the order of their ids, null ids last, and rows of one id
    in that of a hash of their texts; so the first of exactly repeated rows keeps what the others lose.
    """
    held, row_col = numbered(docs, "line-rows")
    texts = held.select(F.col(f"`{row_col}`").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = F.split("text", "\n", -1)
    spans = lambda x: _distinct(F.concat(chunk_spans(x, window, divisor, min_lines), passage_spans(x, words)))
    hashed = _bound(lines, lambda x: F.transform(spans(x), lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"), F.xxhash64(_text_of(x, s)).alias("h"))))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.xxhash64("text").alias("tie"), F.col("row"))
    each = texts.filter("text is not null").select("row", order.alias("at"), hashed.alias("all"))
    each = staged(each.select("row", "at", F.explode("all").alias("c")).select("row", "at", "c.*"), "line-spans")
    place = F.struct("at", "i")
    # Partial aggregation leaves a row for each hash and task, however often a passage is repeated.
    firsts = each.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = staged(firsts.select("h", F.col("first.at.row").alias("row0"), F.col("first.i").alias("i0")), "line-firsts")  # a join of two shuffles, of which AQE splits hot hashes
    again = each.join(firsts, "h").select("row", F.struct("i", "j", "h", ((F.col("row") == F.col("row0")) & (F.col("i") == F.col("i0"))).alias("stays")).alias("a"))
    met = texts.select("row", "text").join(again.groupBy("row").agg(F.collect_list("a").alias("again")), "row")
    met = staged(met, "line-again")
    discard(each, firsts)

    differing = staged(_differing(met), "line-differing")
    if not differing.isEmpty():  # equal hashes of unequal bytes: those hashes remove nothing
        left = met.select("row", F.explode("again").alias("a")).join(differing, F.col("a.h") == F.col("h"), "left_anti")
        met = met.select("row", "text").join(left.groupBy("row").agg(F.collect_list("a").alias("again")), "row")
    gone = F.filter("again", lambda a: ~a["stays"])
    met = met.select("row", "text", gone.alias("gone")).filter("size(gone) > 0")

    def without(x: Column) -> Column:
        lost = F.flatten(F.transform("gone", lambda a: F.sequence(a["i"], a["j"] - 1)))
        stays = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), lost)
        return F.transform(stays, lambda i: F.get(x, i))

    kept = _bound(_bound(lines, without), lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(x).alias("lines")))
    kept = met.select(F.col("row").alias(row_col), F.struct(kept.alias("kept"), F.size("gone").alias("n")).alias("found"))
    met_name = f"{row_col}_found"
    out = held.join(kept.withColumnRenamed("found", met_name), row_col, "left")
    row, found = F.col(f"`{text_col}`"), F.col(met_name)
    told = REPORT if report else ()
    columns = [F.when(found.isNull(), row).otherwise(found["kept"]["text"]).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in told]
    if report:
        before = F.when(row.isNull(), 0).otherwise(F.size(F.split(row, "\n", -1)))
        columns += [
            before.cast("long").alias(REPORT[0]),
            F.when(found.isNull(), before).otherwise(found["kept"]["lines"]).cast("long").alias(REPORT[1]),
            F.coalesce(found["n"], F.lit(0)).cast("long").alias(REPORT[2]),
        ]
    return out.select(*columns)


def _differing(met: DataFrame) -> DataFrame:
    """Hashes of more than one text, by comparison of the bytes of all repeated passages."""
    lines = F.split("text", "\n", -1)
    of = lambda x: F.transform("again", lambda a: F.struct(a["h"].alias("h"), _text_of(x, a).alias("text")))
    found = met.select(F.explode(_bound(lines, of)).alias("c")).select("c.h", "c.text")
    return found.groupBy("h", "text").agg(F.lit(1).alias("one")).groupBy("h").count().filter("count > 1").select("h")
