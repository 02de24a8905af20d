"""Template descriptions of relations: phrases, template lookup, slots, clean-up and checks, parsing back.

What the original draws at random is chosen here by a roll in [0, 1) for each row, variant and purpose, by default a
seeded hash, so that results don't depend on order or partitioning. Word pools are own small defaults. Phrases and
texts are put together in blocks of rows: as column functions they were one generated method of 28 KB, and the JVM leaves
methods beyond 8 KB interpreted.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_HALF_EVEN, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Roll = Callable[[int], Column]
NEARBY = "附近"
ROOTS = {"North": "北", "Northeast": "东北", "East": "东", "Southeast": "东南", "South": "南", "Southwest": "西南", "West": "西", "Northwest": "西北"}
EXACT_ADVERBS = ("笔直朝", "恰好在")
ADVERBS = {"EXACT": (*EXACT_ADVERBS, ""), "SLIGHT": ("微微", "有点"), "MODERATE": ("颇", "大幅")}
SUFFIXES, SIDES = ("所指的方向", "去的那边"), ("一面", "一带")
VAGUE = {"VeryClose": ("几步之内", "紧跟前"), "Close": ("百来米", "两三分钟路"), "Medium": ("几百米", "一小段路"), "Far": ("近一公里", "一大段路")}
ULTRA = {"VeryClose": ("很近",), "Close": ("不远",), "Medium": ("有一段",), "Far": ("偏远",)}
PARTICLES = ("大约", "估计")
DEFAULT_TEMPLATES = {
    "SCENE-B_Opposite": ("{target}在{landmark}对面，隔着{road}，位于{dir_text}。", "过{road}，{landmark}{dir_text}就是{target}。"),
    "SCENE-B": ("沿{road}走，{target}在{landmark}{dir_text}，{dist_text}。",),
    "SCENE-C": ("{target}在{landmark}{dir_text}，{dist_text}。", "从{landmark}往{dir_text}走{dist_text}到{target}。"),
    "SCENE-D": ("{target}与{landmark}在同一处。",),
    "FALLBACK_GENERIC": ("{target}位于{landmark}{dir_text}。",),
}
# Weights of the granularities, by ambiguity for directions; words before a number of minutes; speeds.
DIRECTION_WEIGHTS = {True: (("precise", 0.05), ("vague", 0.65), ("functional", 0.30)), False: (("precise", 0.25), ("vague", 0.45), ("functional", 0.30))}
DISTANCE_WEIGHTS = (("precise", 0.5), ("vague", 0.3), ("ultra_vague", 0.1), ("functional", 0.1))
ABOUT = ("约", "大概")
MODES = ("步行", "开车")
WALK_M_PER_MIN, DRIVE_M_PER_MIN, MOST_MINUTES = 80.0, 400.0, 60


def hash_roll(*columns: str, seed: int = 42) -> Roll:
    return lambda salt: F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)


def pick(pool: Sequence[str], roll: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (F.floor(roll * len(pool)) + 1).cast("int"))


def _pick_of(pools: Mapping[str, Sequence[str]], key: Column, roll: Column, default: str) -> Column:
    out = None
    for name, pool in pools.items():
        out = F.when(key == name, pick(pool, roll)) if out is None else out.when(key == name, pick(pool, roll))
    return out.otherwise(pick(pools[default], roll))


def composed_direction(direction: Column, deviation: Column, ambiguity: Column, granularity: str, roll: Roll, sides: bool = True) -> Column:
    """A direction phrase at one granularity, without a road: ``precise`` always has an exact adverb and owns up to a
    deviation, ``functional`` has a general word after it, ``vague`` an adverb that fits the ambiguity."""
    root = F.element_at(F.create_map(*(F.lit(x) for kv in ROOTS.items() for x in kv)), direction)
    adverb = _pick_of(ADVERBS, ambiguity, roll(1), "EXACT")
    exact = adverb.isin(*EXACT_ADVERBS)
    if granularity == "precise":
        text = F.concat(F.when(exact, adverb).otherwise(pick(EXACT_ADVERBS, roll(5))), root, F.when(deviation > 3, "偏").otherwise(""))
    elif granularity == "functional":
        text = F.concat(root, pick(SUFFIXES, roll(4)))
    else:
        side = F.when(roll(2) < 0.3, pick(SIDES, roll(3))).otherwise("") if sides else F.lit("")
        leaning = F.when(roll(2) < 0.8, F.concat(adverb, F.lit("偏"), root)).otherwise(F.concat(adverb, root))
        text = F.when(adverb == "", root).when(exact, F.concat(adverb, root, side)).otherwise(leaning)
    return F.when(root.isNull(), NEARBY).otherwise(text)


def precise_distance(d: Column) -> Column:
    """Tens of metres (halves to even, ten at least), kilometres with one decimal from 1000 m on."""
    km = F.bround(d / 1000, 1)
    whole = F.when(km == F.floor(km), F.floor(km).cast("string")).otherwise(F.format_string("%.1f", km))
    tens = F.greatest(F.lit(10), (F.bround(d / 10) * 10).cast("int"))
    return F.when(d == 0, "0米（就在此处）").when(d >= 1000, F.concat(F.lit("约"), whole, F.lit("公里"))).otherwise(F.concat(F.lit("约"), tens.cast("string"), F.lit("米")))


def _texts(values: pa.Array, default: str | None = None) -> pa.Array:
    values = values.cast(pa.string())
    return values if default is None else pc.fill_null(values, default)


def _codes(values: pa.Array, known: Sequence[str], other: int) -> np.ndarray:
    """The place of each value in ``known``; ``other`` where it is in none."""
    return pc.fill_null(pc.index_in(_texts(values), value_set=pa.array(known, pa.string())), other).to_numpy(zero_copy_only=False)


def _at(roll: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    return np.floor(roll * size).astype(np.int64)


def _granularity(weights: Sequence[tuple[str, float]], roll: np.ndarray, name: str) -> np.ndarray:
    """Where the first weight whose sum reaches the roll (the last at most) is of ``name``."""
    sums = [round(total, 9) for total in itertools.accumulate(w for _, w in weights)]
    return np.array([n == name for n, _ in weights])[np.minimum(np.searchsorted(sums, roll), len(weights) - 1)]


@cache
def _direction_table() -> tuple[pa.Array, dict[str, int], int]:
    """All phrases without a road by root and form, the first place of some forms, and the number of forms."""
    precise = [("正", ""), ("", "偏")]
    leaning = {k: [(f"{word}{way}", "") for word in ADVERBS[k] for way in ("偏", "")] for k in ("SLIGHT", "MODERATE")}
    exact = [(word, side if word else "") for word in ADVERBS["EXACT"] for side in ("", *SIDES)]
    forms = [*precise, *leaning["SLIGHT"], *leaning["MODERATE"], *exact]
    first = {"SLIGHT": len(precise), "MODERATE": len(precise) + len(leaning["SLIGHT"]), "EXACT": len(forms) - len(exact)}
    return pa.array([*(f"{a}{root}{b}" for root in ROOTS.values() for a, b in forms), NEARBY]), first, len(forms)


def direction_texts(direction: pa.Array, deviation: pa.Array, ambiguity: pa.Array, road: pa.Array, rolls: Mapping[int, np.ndarray]) -> pa.Array:
    """Direction phrases: exact, with an adverb, or by the road's name where there is one."""
    table, first, size = _direction_table()
    root, bands = _codes(direction, list(ROOTS), len(ROOTS)), _codes(ambiguity, ["EXACT", "MODERATE"], 2)
    blurred = bands != 0
    is_of = lambda name: np.where(blurred, _granularity(DIRECTION_WEIGHTS[True], rolls[0], name), _granularity(DIRECTION_WEIGHTS[False], rolls[0], name))
    form = first["EXACT"] + _at(rolls[1], len(ADVERBS["EXACT"])) * (len(SIDES) + 1) + np.where(rolls[2] < 0.3, 1 + _at(rolls[3], len(SIDES)), 0)
    for code, name in ((1, "MODERATE"), (2, "SLIGHT")):
        form = np.where(bands == code, first[name] + 2 * _at(rolls[1], len(ADVERBS[name])) + (rolls[2] >= 0.8), form)
    near = deviation.cast(pa.float64()).to_numpy(zero_copy_only=False) <= 3
    form = np.where(is_of("precise"), np.where(near, 0, 1), form)
    text = table.take(pa.array(np.where(root == len(ROOTS), len(table) - 1, root * size + form)))
    named = pc.utf8_trim(_texts(road, ""), characters=" ")
    by_road = is_of("functional") & (root < len(ROOTS)) & pc.not_equal(named, "").to_numpy(zero_copy_only=False)
    told = pc.binary_join_element_wise(named, pa.array(SUFFIXES).take(pa.array(_at(rolls[4], len(SUFFIXES)))), "")
    return pc.if_else(pa.array(by_road), told, text)


def _kilometres(d: float) -> str:
    km = Decimal(repr(d / 1000)).quantize(Decimal("0.1"), ROUND_HALF_EVEN) if np.isfinite(d) else d
    return f"约{int(km)}公里" if np.isfinite(d) and km == int(km) else f"约{km}公里"


@cache
def _distance_table() -> tuple[list[str], dict[str, int], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """All phrases for less than a kilometre, the first place of each kind, and for pools by level the first place of each
    level in them and its number of words."""
    spans = {}
    for name, pools in (("vague", VAGUE), ("ultra", ULTRA)):
        sizes = np.array([len(pools[level]) for level in VAGUE])
        spans[name] = np.cumsum(sizes) - sizes, sizes
    ultra = [word for level in VAGUE for word in ULTRA[level]]
    kinds = {
        "vague": [word for level in VAGUE for word in VAGUE[level]],
        "ultra": [f"{particle}{word}" for particle in ("", *PARTICLES) for word in ultra],
        "here": ["就在此处"],
        "short": [f"{mode}不到1分钟" for mode in MODES],
        "timed": [f"{mode}{about}{n}分钟" for mode in MODES for about in ABOUT for n in range(MOST_MINUTES + 1)],
        "zero": ["0米（就在此处）"],
        "tens": [f"约{max(10, 10 * n)}米" for n in range(101)],
    }
    starts = itertools.accumulate(map(len, kinds.values()), initial=0)
    return [text for texts in kinds.values() for text in texts], dict(zip(kinds, starts)), spans  # noqa: B905


def distance_texts(distance: pa.Array, level: pa.Array, rolls: Mapping[int, np.ndarray]) -> pa.Array:
    """Distance phrases: metres as by ``precise_distance``, a stock phrase, a mere impression, or minutes on foot or by car."""
    table, first, spans = _distance_table()
    level = _codes(level, list(VAGUE), list(VAGUE).index("Close"))
    d = np.maximum(pc.fill_null(distance.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), 0.0)
    of_pool = lambda name: spans[name][0][level] + _at(rolls[11], spans[name][1][level])
    is_of = lambda name: _granularity(DISTANCE_WEIGHTS, rolls[10], name)
    impressions = (first["here"] - first["ultra"]) // (len(PARTICLES) + 1)
    ultra = first["ultra"] + np.where(rolls[12] < 0.5, 1 + _at(rolls[13], len(PARTICLES)), 0) * impressions + of_pool("ultra")
    drives = (d > 3000) | (rolls[14] >= 0.5)
    minutes = np.where(drives, d / DRIVE_M_PER_MIN, d / WALK_M_PER_MIN)
    some = np.rint(minutes) <= MOST_MINUTES
    whole = np.rint(np.where(some, minutes, 0)).astype(np.int64)
    timed = np.where(some, first["timed"] + (drives * len(ABOUT) + _at(rolls[15], len(ABOUT))) * (MOST_MINUTES + 1) + whole, ultra)
    timed = np.where(d == 0, first["here"], np.where(minutes < 1, first["short"] + drives, timed))
    below = d < 1000
    precise = np.where(d == 0, first["zero"], first["tens"] + np.rint(np.where(below, d, 0) / 10).astype(np.int64))
    code = np.where(is_of("functional"), timed, np.where(is_of("ultra_vague"), ultra, first["vague"] + of_pool("vague")))
    code = np.where(is_of("precise"), precise, code)
    far, which = np.unique(d[at := np.flatnonzero(~below & is_of("precise"))], return_inverse=True)
    code[at] = len(table) + which
    return pa.array([*table, *map(_kilometres, far.tolist())], pa.string()).take(pa.array(code))


def with_templates(df: DataFrame, families: Mapping[str, Sequence[str]], key: str = "template_key") -> DataFrame:
    """Adds ``family``, the nearest there is of the whole key, scene and topology, scene, and the fallback, and its
    ``templates``. The library is a literal map: it is configuration of a few families."""
    wanted = (F.col(key), F.substring_index(key, "_", 2), F.substring_index(key, "_", 1), F.lit("FALLBACK_GENERIC"))
    held = F.create_map(*(x for k, v in families.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    family = F.coalesce(*(F.when(w.isin(*families), w) for w in wanted))
    return df.withColumn("family", family).withColumn("templates", F.try_element_at(held, F.col("family")))


_SLOT = re.compile(r"\{[a-z_]+\}")


def _filled_in_turn(template: str, values: Mapping[str, str]) -> str:
    for slot, value in values.items():
        template = template.replace(f"{{{slot}}}", value)
    return _SLOT.sub("", template)


def filled(template: pa.Array, values: Mapping[str, pa.Array]) -> pa.Array:
    """Templates with their slots replaced one after the other; slots without a value become empty. Rows of a template are
    joined at once; only where a brace is outside of slots, one replacement may make way for the next, and rows go singly."""
    held = _texts(template).dictionary_encode()
    codes = pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False)
    odd = np.zeros(len(codes), bool)
    for v in values.values():
        odd |= pc.match_substring_regex(v, "[{}]").to_numpy(zero_copy_only=False)
    order, parts = [], []
    for code, text in enumerate(held.dictionary.to_pylist()):
        at = np.flatnonzero(codes == code)
        singly = odd[at] if not re.search("[{}]", _SLOT.sub("", text)) else np.ones(len(at), bool)
        if singly.any():
            order.append(at[singly])
            rows = {k: v.take(pa.array(at[singly])).to_pylist() for k, v in values.items()}
            parts.append(pa.array([_filled_in_turn(text, dict(zip(rows, row, strict=True))) for row in zip(*rows.values(), strict=True)], pa.string()))
        if not singly.all():
            order.append(at := at[~singly])
            pieces = [x for x in re.split(r"(\{[a-z_]+\})", text) if x]
            pieces = [values[x[1:-1]].take(pa.array(at)) if x[1:-1] in values else x for x in pieces if not _SLOT.fullmatch(x) or x[1:-1] in values]
            empty = pa.array([""]).take(pa.array(np.zeros(len(at), np.int64)))
            parts.append(pc.binary_join_element_wise(empty, *pieces, ""))
    order.append(nowhere := np.flatnonzero(codes < 0))
    parts.append(pa.nulls(len(nowhere), pa.string()))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))


# What rolls are drawn for by ``direction_texts`` and ``distance_texts``; 20 is a template's.
_SALTS = (0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 15)


def described(direction: pa.Array, deviation: pa.Array, ambiguity: pa.Array, road: pa.Array, distance: pa.Array, level: pa.Array, template: pa.Array, landmark: pa.Array, target: pa.Array, target_type: pa.Array, *rolls: pa.Array) -> pa.Array:
    """``(dir_text, dist_text, description_raw)`` of a block of rows; ``rolls`` by ``_SALTS``."""
    drawn = {salt: r.to_numpy(zero_copy_only=False) for salt, r in zip(_SALTS, rolls, strict=True)}
    directions, distances = direction_texts(direction, deviation, ambiguity, road, drawn), distance_texts(distance, level, drawn)
    slots = {
        "landmark": _texts(landmark, ""), "target": _texts(target, "目标"), "target_type": _texts(target_type, "地点"), "road": _texts(road, "路"),
        "dir_text": directions, "dist_text": distances,
    }
    return pa.StructArray.from_arrays([directions, distances, filled(template, slots)], ["dir_text", "dist_text", "description_raw"])


def descriptions(df: DataFrame, variants: int = 5, families: Mapping[str, Sequence[str]] | None = None, roll_of: Callable[[Column], Roll] | None = None) -> DataFrame:
    """``variants`` rows for each relation with phrases, template and ``description_raw``."""
    families = families or DEFAULT_TEMPLATES
    rows = with_templates(df, families).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    roll = roll_of(F.col("variant")) if roll_of else hash_roll("landmark_id", "target_id", "variant")
    rows = rows.withColumn("template", F.element_at("templates", (F.floor(roll(20) * F.size("templates")) + 1).cast("int"))).drop("templates")
    read = ["direction_8", "deviation", "ambiguity_level", "road_name", "distance", "dist_level", "template", "landmark_name", "target_name", "target_type_3"]
    text = F.arrow_udf(described, "dir_text string, dist_text string, description_raw string")(*read, *map(roll, _SALTS))
    rows = rows.withColumn("_text", text)
    return rows.select(*df.columns, "family", "variant", "_text.dir_text", "_text.dist_text", "template", "_text.description_raw")


def without_redundancy(text: Column, road: Column, other: str = "马路") -> Column:
    """The road's name once, then a general word; one of two prepositions; single spaces."""
    at = F.instr(text, road)
    head = F.substr(text, F.lit(1), at + F.length(road) - 1)
    tail = F.replace(F.substr(text, at + F.length(road)), road, F.lit(other))
    once = F.when((F.length(F.coalesce(road, F.lit(""))) > 1) & (at > 0), F.concat(head, tail)).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(once, "在(.*?)在", "在$1，"), r"\s+", " "))


def needs_refining(key: Column, ambiguity: Column, level: Column, d: Column, text: Column) -> Column:
    stops = F.length(text) - F.length(F.translate(text, "，。；", ""))
    return F.coalesce(
        F.contains(key, F.lit("Intersection")) | (ambiguity == "MODERATE") | ((level == "Far") & (d > 800)) | ((F.length(text) > 40) & (stops >= 2)), F.lit(False)
    )


def keeps_direction(before: Column, after: Column, direction: Column) -> Column:
    """Whether a rewritten text still tells the direction."""
    found = lambda t: F.rlike(t, F.lit("[东南西北]"))
    general = F.contains(after, F.lit("方向"))
    lost = found(before) & ~found(after) & ~general
    cardinal = F.element_at(F.create_map(*(F.lit(x) for n in ("North", "South", "East", "West") for x in (n, ROOTS[n]))), direction)
    missing = cardinal.isNotNull() & ~F.contains(after, cardinal) & ~general & ~F.contains(after, F.lit("那边"))
    return F.when(F.coalesce(direction, F.lit("")) == "", True).otherwise(~lost & ~F.coalesce(missing, F.lit(False)))


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


# What counts as a direction spelt out.
HARD_DIRECTIONS = "东南西北左右前后上下"


def good_template(template: Column, valid: Sequence[str], required: Sequence[str]) -> Column:
    """Only valid slots (any, if none is given), all required ones, and no direction spelt out."""
    slots = placeholders(template)
    array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    hard = F.rlike(F.regexp_replace(template, r"\{[^}]*\}", ""), F.lit(f"[{HARD_DIRECTIONS}]"))
    known = F.size(F.array_except(slots, array(valid))) == 0 if valid else F.lit(True)
    return known & (F.size(F.array_except(array(required), slots)) == 0) & ~hard


def merged_templates(held: DataFrame, made: DataFrame, valid: Sequence[str], required: Sequence[str]) -> DataFrame:
    """``(family, template)``: the templates held, and those of ``made`` that are good and not held yet, each once."""
    good = made.filter(good_template(F.col("template"), valid, required)).select("family", "template").distinct()
    return held.select("family", "template").union(good.join(held, ["family", "template"], "left_anti"))


# Words that a text is read back by, in the order in which they are tried.
DIRECTION_WORDS = (
    ("东北", "NE"), ("东南", "SE"), ("西南", "SW"), ("西北", "NW"), ("正东", "E"), ("正南", "S"), ("正西", "W"), ("正北", "N"),
    ("东", "E"), ("南", "S"), ("西", "W"), ("北", "N"),
)
TOPOLOGY_WORDS = (("马路对面", "Opposite"), ("对面", "Opposite"), ("同侧", "SameSide"), ("同一处", "Coincident"))


def first_word(text: Column, words: Sequence[tuple[str, str]]) -> Column:
    """The code of the first of ``words`` that a text holds, by blocks: each word is sought where none before it was found."""

    def run(texts: pa.Array) -> pa.Array:
        codes = np.full(len(texts), len(words))
        rest = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, "|".join(re.escape(w) for w, _ in words)), False).to_numpy(zero_copy_only=False))
        held = texts.take(pa.array(rest))
        for k, (word, _) in enumerate(words):
            found = pc.match_substring(held, word)
            at = found.to_numpy(zero_copy_only=False)
            codes[rest[at]] = k
            rest, held = rest[~at], held.filter(pc.invert(found))
        return pa.array([*(code for _, code in words), None], pa.string()).take(pa.array(codes))

    return F.arrow_udf(run, "string")(text)


# White space as the JVM's expressions have it.
_SPACE = r"[ \t\n\x0B\f\r]"


def parsed_distance(text: Column) -> Column:
    """Metres told in a text, by number and unit."""

    def run(texts: pa.Array) -> pa.Array:
        found = pc.extract_regex(texts, rf"(?P<value>[0-9]+(?:\.[0-9]+)?){_SPACE}*(?P<unit>千米|公里|km|KM|米|m|M)")
        told = pc.struct_field(found, "value").dictionary_encode()
        value = pa.array(map(float, told.dictionary.to_pylist()), pa.float64()).take(told.indices)
        far = pc.is_in(pc.struct_field(found, "unit"), value_set=pa.array(["千米", "公里", "km", "KM"]))
        return pc.if_else(far, pc.multiply(value, 1000.0), value)

    return F.arrow_udf(run, "double")(text)


def json_texts(answer: Column) -> Column:
    """The strings of a JSON array inside other text (between the first and last bracket), else its lines."""
    inner = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[0-9]+[.)、]|[-*])\s*", ""))), lambda x: (x != "") & ~F.startswith(x, F.lit("```")))
    return F.coalesce(F.when(inner != "", F.from_json(inner, "array<string>")), lines)
