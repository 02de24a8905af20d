"""Word lists, templates, code lists and maps: small inputs read on the driver, with own small defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_WIDTH = 4.0
# The penalty factors of the three facility levels.
PENALTY_FACTORS = {"high": 0.15, "medium": 0.30, "low": 0.50}


def read_json(path: str) -> object:
    with open(path, encoding="utf-8") as source:
        return json.load(source)


def prefixes(data: Mapping) -> list[str]:
    return sorted(data["stopwords"], key=lambda w: (-len(w), w))


def suffixes(data: Mapping) -> list[str]:
    """Distinct suffixes of all groups and levels, longest first."""
    found = {w for group in data["suffixes"] for level in ("level_1", "level_2", "level_3") for w in group.get(level, [])}
    return sorted(found, key=lambda w: (-len(w), w))


def proper_nouns(data: Mapping) -> dict[str, float]:
    return {k["word"]: float(k["weight"]) for c in data["categories"] for s in c["subcategories"] for k in s["keywords"]}


def facilities(data: Mapping) -> list[tuple[str, float]]:
    """Facility words with their level's factor, in file order."""
    factors = {name: float(v["factor"]) for name, v in data.get("penalty_levels", {}).items()} or PENALTY_FACTORS
    return list(chain.from_iterable([(w, factors[c["penalty"]]) for w in c["keywords"]] for c in data["categories"]))


def templates(text: str) -> dict[str, list[str]]:
    """Templates by family key from a YAML library."""
    import yaml

    return {key: list(family["templates"]) for key, family in yaml.safe_load(text)["families"].items()}


def dump_templates(families: Mapping[str, Sequence[str]], version: str = "1") -> str:
    import yaml

    return yaml.safe_dump({"version": version, "families": {k: {"templates": list(v)} for k, v in families.items()}}, allow_unicode=True, sort_keys=False)


def code_list(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Distinct trimmed codes of the first of ``wanted`` columns that there is, else of the first column."""
    name = next((c for c in wanted if c in df.columns), df.columns[0])
    return df.select(F.trim(F.col(f"`{name}`").cast("string")).alias("code")).filter("code <> ''").distinct()


def with_mapped(df: DataFrame, column: str, mapping: Mapping[str, object], out: str, default: object = None) -> DataFrame:
    """A map lookup as a literal map: no join for a map of a few entries."""
    held = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else None
    found = F.try_element_at(held, F.col(column)) if held is not None else F.lit(None)
    return df.withColumn(out, F.coalesce(found, F.lit(default)))


def with_width(df: DataFrame, column: str, widths: Mapping[str, float], default: float = DEFAULT_WIDTH) -> DataFrame:
    return with_mapped(df, column, {k: float(v) for k, v in widths.items()}, "width", float(default))


def unmapped(df: DataFrame, column: str, mapping: Mapping[str, object]) -> DataFrame:
    """Distinct values that a map lacks."""
    return df.select(column).distinct().filter(F.col(column).isNotNull() & ~F.col(column).isin(*mapping)).orderBy(column)


def template_table(spark: SparkSession, families: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(key, k, text) for key, texts in families.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, idx int, template string")
