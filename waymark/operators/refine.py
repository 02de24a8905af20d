"""Batched calls to a text service with per-row fallback, as an operator with an injectable client."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Client = Callable[[Sequence[str]], Sequence[str | None]]


def same(texts: Sequence[str]) -> Sequence[str]:
    """The client where there is no service: texts as they are."""
    return texts


def answers(client: Client, texts: Sequence[str], size: int, fallback: bool = True) -> list[str | None]:
    """One answer for each text: by batches; where a batch fails or returns another number, one by one; where that
    fails too, the text itself, or null without ``fallback``."""
    out: list[str | None] = []
    for at in range(0, len(texts), size):
        part = list(texts[at : at + size])
        found = _tried(client, part)
        if found is None or len(found) != len(part):
            found = [(_tried(client, [t]) or [None])[0] for t in part]
        out += [a if a else (t if fallback else None) for a, t in zip(found, part, strict=True)]
    return out


def _tried(client: Client, texts: Sequence[str]) -> list[str | None] | None:
    try:
        return list(client(texts))
    except (OSError, ValueError):
        return None


def refined(df: DataFrame, text_col: str, out_col: str, client: Client = same, size: int = 30, fallback: bool = True, when: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: answers where ``when`` (a boolean column) holds, else the text. Null texts stay null.

    Answers aren't repeatable, so write the result before it is used twice.
    """
    names = df.columns
    at, flag = names.index(text_col), names.index(when) if when else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            flags = batch.column(flag).to_pylist() if flag is not None else [True] * len(texts)
            asked = [k for k, (t, f) in enumerate(zip(texts, flags, strict=True)) if t and f]
            out = list(texts)
            for k, a in zip(asked, answers(client, [texts[k] for k in asked], size, fallback), strict=True):
                out[k] = a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, out_col])

    from pyspark.sql import functions as F

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("string").alias(out_col)).schema)
