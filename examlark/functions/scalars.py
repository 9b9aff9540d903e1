"""Column expressions for the engine's scalar functions; all stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a model's name that tell that it takes images.
VISION_HINTS = ["vision", "vl", "4v", "4o", "gemini", "doubao", "glm-4v"]
#: Image suffixes of a package's media.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".emf", ".wmf"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def env_flag(value: Column | str, default: bool = False) -> Column:
    """1, true, yes and on, trimmed and in any case; null is the default."""
    return F.coalesce(F.lower(F.trim(col(value))).isin("1", "true", "yes", "on"), F.lit(default))


def parse_version(v: Column | str) -> Column:
    """A positive number, after at most one leading v, or null."""
    digits = F.nullif(F.regexp_extract(F.lower(F.trim(col(v).cast("string"))), "^v?([0-9]+)$", 1), F.lit(""))
    n = digits.try_cast("int")
    return F.when(n > 0, n)


def safe_int(v: Column | str) -> Column:
    """The value of an integer literal; of a number, its whole part; else null."""
    text = F.trim(col(v).cast("string"))
    literal = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    number = col(v).try_cast("double")
    kind = F.typeof(col(v))
    return F.when(kind.rlike("^(double|float|decimal|boolean)"), F.when(~F.isnan(number), number.try_cast("int"))).otherwise(literal)


def safe_stem(v: Column | str) -> Column:
    """A file name's stem: other characters become _, at most 80, never empty."""
    clean = F.regexp_replace(col(v), r"[^0-9A-Za-z一-鿿._-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(clean, r"^[._-]+|[._-]+$", ""), 1, 80), F.lit("")), F.lit("document"))


def preview_text(v: Column | str, most: int = 80) -> Column:
    """White space collapsed, the first characters."""
    return F.substring(F.trim(F.regexp_replace(col(v), r"(?U)\s+", " ")), 1, most)


def supports_vision(name: Column | str) -> Column:
    low = F.lower(F.trim(col(name)))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in VISION_HINTS]), F.lit(False))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def first_number(*values: Column | str) -> Column:
    """The first value that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(col(v), F.lit(0)) for v in values], F.lit(0))


def suffix(name: Column | str, empty: str = "<no_suffix>") -> Column:
    """The lower-cased suffix of a file name, with its dot."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.regexp_replace(col(name), r"[?#].*$", ""), r"[^/.](\.[^./]+)$", 1)), F.lit("")), F.lit(empty))


def coverage(n: Column, expected: Column) -> Column:
    """Share of what was expected, rounded half to even at 4 places; null if nothing was."""
    return F.when(expected > 0, F.bround(n / expected, 4))


def render(text: Column | str, variables: Column | str) -> Column:
    """{{ name }} becomes the variable's value, in one pass; missing is empty; no variables leave the text."""
    pattern = r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"
    t, v = col(text), col(variables)
    parts = F.split(t, pattern, -1)
    names = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    values = F.concat(F.transform(names, lambda n: F.coalesce(F.try_element_at(v, n), F.lit(""))), F.array(F.lit("")))
    return F.when(v.isNull() | (F.size(v) == 0), t).otherwise(F.array_join(F.zip_with(parts, values, lambda a, b: F.concat(a, b)), ""))


def iso_time(ts: Column | str) -> Column:
    """ISO text; the fraction only if there is one."""
    t = col(ts)
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def run_id(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd_HHmmss")


def sql_literal(v: Column | str) -> Column:
    return F.concat(F.lit("'"), F.replace(col(v), F.lit("'"), F.lit("''")), F.lit("'"))


def numbered_name(prefix: str, index: Column | str, name: Column | str, sep: str = "__") -> Column:
    return F.format_string(f"{prefix}_%04d{sep}%s", col(index).cast("int"), col(name))


def normal_stem(v: Column | str) -> Column:
    """A stem for matching: lower case, marks and white space collapsed (own rule)."""
    return F.trim(F.regexp_replace(F.lower(col(v)), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " "))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit perceptual hashes."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def trim_box(l: Column, t: Column, r: Column, b: Column, w: Column, h: Column, pad: int = 2) -> Column:  # noqa: E741
    """A padded crop box, clamped to the image."""
    zero = F.lit(0)
    return F.struct(F.greatest(l - pad, zero).alias("left"), F.greatest(t - pad, zero).alias("top"), F.least(r + pad, w).alias("right"), F.least(b + pad, h).alias("bottom"))


def upscale(w: Column, h: Column, factor: int) -> Column:
    """Width and height; small images grow by a factor."""
    small = (w < 300) | (h < 100)
    return F.struct(F.when(small, w * factor).otherwise(w).alias("width"), F.when(small, h * factor).otherwise(h).alias("height"))


def natural_key(number: Column | str) -> Column:
    """A question number's value for ranges: its first run of digits, or null."""
    return F.nullif(F.regexp_extract(col(number).cast("string"), "([0-9]+)", 1), F.lit("")).try_cast("int")


def range_bounds(number: Column | str) -> Column:
    """'1-5' -> (1, 5); '7' -> (7, 7); anything else, and a range that runs backwards, -> null. For joins by range, which need no list."""
    n = F.trim(col(number))
    part = lambda i: F.nullif(F.regexp_extract(n, r"^([0-9]+)(?:\s*[-~]\s*([0-9]+))?$", i), F.lit(""))
    lo = part(1).try_cast("int")
    hi = F.when(part(2).isNull(), lo).otherwise(part(2).try_cast("int"))
    return F.when(hi >= lo, F.struct(lo.alias("lo"), hi.alias("hi")))


def expand_range(number: Column | str) -> Column:
    """'1-5' -> [1, 2, 3, 4, 5]; '7' -> [7]; anything else -> []. Ranges of any length are spread out: join very long ones by ``range_bounds``."""
    r = range_bounds(number)
    return F.when(r.isNotNull(), F.sequence(r["lo"], r["hi"])).otherwise(F.array().cast("array<int>"))


def to_bytes(numbers: Column | str) -> Column:
    """Binary of a list of integers, each modulo 256; bytes stay bytes with a cast."""
    return F.unhex(F.array_join(F.transform(col(numbers), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), ""))


def formula_signature(linear: Column) -> Column:
    """A hash of the linear form that does not see white space, case or how multiplication is written."""
    return F.sha2(F.lower(F.regexp_replace(linear, r"[\s*]+", "")), 256)


def drop_empty(arguments: Column | str) -> Column:
    """A map of options without those that are null or empty."""
    return F.map_filter(col(arguments), lambda k, v: v.isNotNull() & (v != ""))


def in_states(status: Column | str, states: list[str]) -> Column:
    """Whether a status is one of some; null is none."""
    return F.coalesce(col(status).isin(*states), F.lit(False))
