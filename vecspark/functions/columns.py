"""Columns: vector and label expressions that stay in Catalyst. Reductions are over doubles, from the first element on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null for lists of different lengths."""
    a, b = _c(a), _c(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), _sum(products))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def mean_squared_error(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.when(F.size(a) == F.size(b), _sum(squares) / F.nullif(F.size(a), F.lit(0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.try_divide(dot(a, b), n))


def vector_error(v: Column | str, dim: int) -> Column:
    """What is wrong with a vector, or null."""
    v = _c(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNull(), "vector is missing").when(F.size(v) != dim, F.format_string(f"vector has %d components, expected {dim}", F.size(v))).when(bad, "vector holds a null or non-finite component")


def packed_size(count: Column | str | int, bits: Column | str | int) -> Column:
    count, bits = (F.lit(x) if isinstance(x, int) else _c(x) for x in (count, bits))
    return F.floor((count * bits + 7) / 8).cast("int")


def bits_error(bits: Column | str, least: int = 1) -> Column:
    """least: 1 for plain codes, 2 for inner-product codes."""
    return F.when(~_c(bits).between(least, 8), F.format_string(f"bits must be from {least} to 8, not %d", _c(bits)))


def packed_error(packed: Column | str, dim: int, bits: int) -> Column:
    """What is wrong with packed cells, or null."""
    size, want = F.octet_length(_c(packed)), (dim * bits + 7) // 8
    return F.when(_c(packed).isNull(), "code is missing").when(size != want, F.format_string(f"code has %d bytes, expected {want}", size))


def product_error(mse: Column | str, signs: Column | str, res_norm: Column | str, dim: int, bits: int) -> Column:
    """What is wrong with an inner-product code, or null."""
    norm_ = _c(res_norm).cast("double")
    bad = norm_.isNull() | F.isnan(norm_) | (F.abs(norm_) == float("inf"))
    return F.coalesce(packed_error(mse, dim, bits - 1), packed_error(signs, dim, 1), F.when(bad, "residual norm is null or not finite"))


def softmax(score: Column | str, over: WindowSpec) -> Column:
    """Weights of the rows of a window; shifted by the largest score."""
    e = F.exp(_c(score) - F.max(_c(score)).over(over))
    return e / F.sum(e).over(over)


def uniform_reconstruct(v: Column | str, bits: int) -> Column:
    top, n = float((1 << bits) - 1), norm(v).cast("float").cast("double")
    one = lambda x: (F.floor((F.least(F.greatest(x.cast("double") / n, F.lit(-1.0)), F.lit(1.0)) + 1) / 2 * top + 0.5) / top * 2 - 1) * n
    return F.when(n == 0, F.transform(_c(v), lambda x: F.lit(0.0))).otherwise(F.transform(_c(v), one))


def normal_method(method: Column | str, default: str = "primary", known: Sequence[str] = ("primary", "uniform")) -> Column:
    """The method's name in lower case; the default for a blank one, null for one that isn't known."""
    x = F.coalesce(F.nullif(F.lower(F.trim(_c(method))), F.lit("")), F.lit(default))
    return F.when(x.isin(*known), x)


def relative_position(label: Column | str, token_index: Column | str, sequence_length: Column | str) -> Column:
    """The given label, or first, quarter, middle, three_quarter or last by the share of the sequence."""
    given = F.trim(F.lower(_c(label)))
    share = F.try_divide(_c(token_index).cast("double"), (_c(sequence_length) - 1).cast("double"))
    by_share = F.when(share < 0.125, "first").when(share < 0.375, "quarter").when(share < 0.625, "middle").when(share < 0.875, "three_quarter").otherwise("last")
    return F.when(given != "", position_label(given)).when(share.isNull(), "unknown").otherwise(by_share)


#: Names of token positions that mean the same.
SYNONYMS = {"first": "first", "start": "first", "quarter": "quarter", "25%": "quarter", "middle": "middle", "mid": "middle", "50%": "middle", "three_quarter": "three_quarter", "75%": "three_quarter", "last": "last", "end": "last"}
POSITIONS = ("first", "quarter", "middle", "three_quarter", "last")


def position_label(label: Column | str, strict: bool = False) -> Column:
    """The common name of a label. An unknown one stays as it is, or is null if strict."""
    x = F.trim(F.lower(_c(label)))
    known = F.create_map(*[F.lit(y) for pair in SYNONYMS.items() for y in pair])
    got = F.try_element_at(known, x)
    return got if strict else F.coalesce(got, x)


def position_rank(label: Column | str) -> Column:
    """0 for first to 4 for last; 5 for others."""
    found = F.array_position(F.array(*map(F.lit, POSITIONS)), position_label(label))
    return F.when(found > 0, found - 1).otherwise(len(POSITIONS)).cast("int")


def kv_head(head: Column | str, heads: Column | str, kv_heads: Column | str) -> Column:
    """The key/value head that a query head reads; heads must be a multiple of kv_heads."""
    per = F.floor(_c(heads) / _c(kv_heads))
    return F.floor(_c(head) / per).cast("int")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and numbers; the trimmed text itself if there is none and it isn't empty."""
    low = F.lower(F.trim(_c(text)))
    found = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.when(F.size(found) > 0, found).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))


def _cut(text: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8, the last three of them dots where something was cut (no dots up to 3); a character that the cut goes
    through is left out."""
    room, dots = (most, "") if most <= 3 else (most - 3, "...")
    tries = [F.substring(F.encode(text, "UTF-8"), 1, room - k).cast("string") for k in range(min(3, room) + 1)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in tries])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit(dots)))


def summary_text(text: Column | str, most: int) -> Column:
    """White space collapsed, then at most `most` bytes; 0 or less: no limit."""
    one = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return _cut(one, most) if most > 0 else one


def preview_text(text: Column | str, most: int) -> Column:
    """Line feeds as spaces, then at most `most` bytes."""
    return _cut(F.regexp_replace(F.regexp_replace(_c(text), "\n", " "), r"^\s+|\s+$", ""), max(most, 0))


def plain_name(text: Column | str) -> Column:
    """Lower case; each character but a-z and 0-9 becomes a hyphen, none at the ends; "run" for a blank text."""
    low = F.lower(F.trim(_c(text)))
    return F.when(low == "", "run").otherwise(F.trim(F.regexp_replace(low, "[^a-z0-9]", "-"), F.lit("-")))


def clean_strings(values: Column | str) -> Column:
    return F.filter(F.transform(_c(values), lambda x: F.trim(x)), lambda x: x != "")


def overlap(old: Column | str, new: Column | str) -> Column:
    """The largest k so that the last k elements of old are the first k of new."""
    old, new = _c(old), _c(new)
    n = F.least(F.size(old), F.size(new))
    fits = F.filter(F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))), lambda k: F.slice(old, F.size(old) - k + 1, k) == F.slice(new, F.lit(1), k))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0))


def prefix(old: Column | str, new: Column | str) -> Column:
    return (F.size(_c(old)) <= F.size(_c(new))) & (F.slice(_c(new), F.lit(1), F.size(_c(old))) == _c(old))


def bench_kind(n_prompt: Column | str, n_gen: Column | str) -> Column:
    p, g = _c(n_prompt) > 0, _c(n_gen) > 0
    return F.when(p & g, "pg").when(p, "pp").when(g, "tg").otherwise("unknown")


def flat_content(json: Column | str) -> Column:
    """The text of a message's content: a JSON string, or the text parts of a JSON array, one a line."""
    raw = F.trim(_c(json))
    parts = F.from_json(raw, "array<struct<type: string, text: string>>")
    return F.when(raw.startswith("["), F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull() & (x != "")), "\n")).when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")).otherwise(raw)


def best_first(*keys: Column, by: Sequence[Column | str]) -> Column:
    """1 for the first row of each group in the order of keys."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
