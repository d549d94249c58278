"""SQL for DuckDB that says what the vector queries return; specifications are put in as literals."""

from __future__ import annotations

import numpy as np

from vecspark.functions.spec import ProductSpec, QuantizerSpec

from .data import CASES, DIM


def literal(x) -> str:
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return f"CAST({float(x)!r} AS DOUBLE)" if not isinstance(x, (int, np.integer)) else str(x)


def doubles(x) -> str:
    """A list or list of lists of doubles, short."""
    x = np.asarray(x, float)
    return f"CAST({np.array2string(x, separator=',', threshold=x.size + 1, floatmode='unique', max_line_width=10**9)} AS DOUBLE{'[]' * x.ndim})".replace("\n", "").replace(".,", ".0,").replace(".]", ".0]")


def total(terms: str) -> str:
    """The sum of a list, from the first element on."""
    return f"list_reduce(list_prepend(CAST(0 AS DOUBLE), {terms}), lambda a, b: a + b)"


def dot(a: str, b: str) -> str:
    return total(f"list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])")


def coded(spec: QuantizerSpec) -> str:
    """CTEs up to `coded`: id, label, norm, x (unit), cells (from 0)."""
    return f"""
consts AS MATERIALIZED (SELECT {doubles(spec.dense)} AS rot, {doubles(spec.centroids)} AS cen, {doubles(spec.boundaries)} AS bnd),
vecs AS MATERIALIZED (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
units AS MATERIALIZED (SELECT id, label, v, CAST(CAST(sqrt({dot("v", "v")}) AS FLOAT) AS DOUBLE) AS norm FROM vecs),
rotated AS MATERIALIZED (SELECT id, label, v, norm, list_transform(rot, lambda r: {dot("r", "list_transform(v, lambda c: c / (CASE WHEN norm > 1e-12 THEN norm ELSE 1 END))")}) AS y FROM units, consts),
coded AS MATERIALIZED (SELECT id, label, v, norm, y, list_transform(y, lambda c: len(list_filter(bnd, lambda b: b <= c))) AS cells FROM rotated, consts)"""


def packed_hex(cells: str, dim: int, bits: int) -> str:
    """Lower-case hex of packed cells; bits that divide 8."""
    per = 8 // bits
    byte = " + ".join(f"CAST({cells}[{per} * i + {j + 1}] AS INT) * {1 << bits * j}" for j in range(per))
    return f"array_to_string(list_transform(range({dim // per}), lambda i: lower(printf('%02x', {byte}))), '')"


def ranked(scored: str, k: int) -> str:
    """scored: query_id, id, score."""
    return f"SELECT query_id, rank, id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM ({scored})) WHERE rank <= {k}"


def code_scores(spec: QuantizerSpec) -> str:
    return f"""SELECT q.id AS query_id, c.id AS id, round(c.norm * {dot("list_transform(c.cells, lambda i: cen[i + 1])", "q.ry")}, 6) + 0 AS score
FROM (SELECT id, list_transform(rot, lambda r: {dot("r", "v")}) AS ry FROM vecs, consts WHERE id % 100 = 0) q, coded c, consts"""


def sketched(spec: ProductSpec) -> str:
    """CTEs up to `sketched`: id, cells, signs, res_norm."""
    return f"""{coded(spec.base)},
proj AS MATERIALIZED (SELECT {doubles(spec.projection)} AS s),
turned AS MATERIALIZED (SELECT list_transform(range({spec.dim}), lambda j: list_transform(rot, lambda r: r[j + 1])) AS tor FROM consts),
lefts AS MATERIALIZED (SELECT id, v, cells, list_transform(list_zip(list_transform(v, lambda c: c / (CASE WHEN norm > 1e-12 THEN norm ELSE 1 END)), list_transform(tor, lambda r: {dot("r", "list_transform(cells, lambda i: cen[i + 1])")})), lambda p: p[1] - p[2]) AS rest FROM coded, consts, turned),
sketched AS MATERIALIZED (SELECT id, v, cells, rest, list_transform(s, lambda r: CASE WHEN {dot("r", "rest")} >= 0 THEN 1 ELSE 0 END) AS signs, CAST(CAST(sqrt({dot("rest", "rest")}) AS FLOAT) AS DOUBLE) AS res_norm FROM lefts, proj)"""


def cases() -> str:
    return f"cases AS ({CASES})"


__all__ = ["DIM", "cases", "code_scores", "coded", "dot", "doubles", "packed_hex", "ranked", "sketched", "total"]
