"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own text. A text's letters are encoded, in blocks,
with every dictionary; the smallest total names the language, unless the margin to the next is too narrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import id_and_text, text_slices

DICTIONARY_BYTES = 1 << 18
SAMPLE_ROWS = 400
SPANS = 8
ROW_BYTES = 1 << 13
BLOCK = 1 << 12
LEVEL = 9
MARGIN = 0.01
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased runs of letters with single spaces around: what is compressed."""
    return f" {' '.join(_WORDS.findall(text.lower()))} ".encode()


class LanguageModel:
    """A dictionary for each language, most frequent language first."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK) -> None:
        self.dictionaries, self.level, self.block = dictionaries, level, block
        self.coders: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"coders": None}

    def sizes(self, text: str) -> list[int]:
        """Bytes that each language needs for the whole text."""
        if self.coders is None:
            self.coders = []
            for data in self.dictionaries.values():
                held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.level)
                self.coders.append(
                    zstandard.ZstdCompressor(dict_data=held, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
                )
        data = letters(text)
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(coder.compress(p)) for p in parts) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score in 0 to 1, and margin: the share by which the next language is larger.

        Text that is null or has no letter is undetermined; ties go to the language with more training rows.
        """
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        names = list(self.dictionaries)
        if len(sizes) == 1:
            return names[0], 1.0, 1.0
        margin = min(s for k, s in enumerate(sizes) if k != best) / sizes[best] - 1
        return names[best], 1 - 0.5 * float(np.exp(-20 * margin)), margin


def _spread(text: Column, most: int, spans: int = SPANS) -> Column:
    """A text of at most ``most`` characters whole; of a longer one ``spans`` equal parts, from its beginning to its end."""
    size = max(1, most // spans)
    begin = lambda k: F.floor(k * (F.length(text) - size) / (spans - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(spans - 1)), lambda k: F.substr(text, begin(k), F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(parts, " "))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    row_bytes: int = ROW_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """A model of the languages of ``docs``, from a bounded sample of its rows.

    Of each language about ``sample_rows`` rows by hash of id and text, each giving ``row_bytes`` characters at most, in
    spans spread over the whole text, to a dictionary of ``dictionary_bytes``; so the model grows with the number of
    languages only. Rows without a language or text don't count; a language's rows are sampled alike at every size.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter("lang is not null and text is not null and text <> ''")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel({})
    order = F.xxhash64("id", "text")
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_rows / n))))
    near = rows.filter(F.pmod(order, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    picked = near.select("lang", order.alias("order"), _spread(F.col("text"), row_bytes).alias("text"))  # about sample_rows a language
    held: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.order, r.text)):
        held.setdefault(r.lang, []).append(r.text)
    order_of = sorted(held, key=lambda x: (-counts[x], x))
    return LanguageModel({x: _dictionary(held[x], dictionary_bytes) for x in order_of})


def _dictionary(texts: list[str], size: int) -> bytes:
    """The letters of all texts; if they are more than fits, of each an equal share, spread over it."""
    parts = [letters(t) for t in texts]
    if sum(map(len, parts)) <= size:
        return b"".join(parts)
    share, out = size // len(parts), []
    for part in parts:
        step = max(1, len(part) // max(1, share))
        out += [part[k * 64 * step : k * 64 * step + 64] for k in range(-(-len(part) // (64 * step)))] if len(part) > share else [part]
    return b"".join(out)[:size]


def identified(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN
) -> DataFrame:
    """``(id, lang, score, margin, rejected)`` for every row, from the whole text.

    ``rejected`` says that the margin is under ``margin`` or that there is nothing to tell from; the nearest
    language is given all the same. Repeated rows get equal answers, a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            found = [model.predict(t.decode("utf-8", "replace")) for t in texts]
            langs, scores, margins = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(langs), pa.array(scores), pa.array(margins), pa.array([m < margin for m in margins])],
                names=["id", "lang", "score", "margin", "rejected"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, lang string, score double, margin double, rejected boolean")
