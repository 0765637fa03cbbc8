"""DuckDB texts of the colour formulas, for the equivalents of registered queries."""

from __future__ import annotations

from pixelloom.functions import color

Triple = tuple[str, str, str]
RGB: Triple = ("r", "g", "b")


def byte(v: str) -> str:
    return f"least(255, greatest(0, floor(({v}) + 0.5)))::INT"


def linear(v: str) -> str:
    return f"(CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END)"


def dot(row, v: Triple) -> str:
    return "(" + " + ".join(f"{x} * {w!r}::DOUBLE" for x, w in zip(v, row, strict=True)) + ")"


def vector(rgb: Triple, space: str) -> list[str]:
    """Three expressions; write them into columns before they are used twice."""
    if space in ("srgb", "weighted-rgb"):
        return [f"{c}::DOUBLE" for c in rgb]
    if space in color.LUMA:
        return [f"{c} * sqrt({w!r}::DOUBLE)" for c, w in zip(rgb, color.LUMA[space], strict=True)]
    lin = tuple(linear(c) for c in rgb)
    if space == "linear-rgb":
        return list(lin)
    if space == "cielab":
        t = [f"({dot(row, lin)} / {w!r}::DOUBLE)" for row, w in zip(color.XYZ, color.WHITE, strict=True)]
        f = [f"(CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE {x} * 7.787::DOUBLE + 16::DOUBLE / 116 END)" for x in t]
        return [f"({f[1]} * 116 - 16)", f"(({f[0]} - {f[1]}) * 500)", f"(({f[1]} - {f[2]}) * 200)"]
    lms = tuple(f"cbrt({dot(row, lin)})" for row in color.LMS)
    lab = [dot(row, lms) for row in color.OKLAB]
    return lab if space == "oklab" else [lab[0], f"sqrt({lab[1]} * {lab[1]} + {lab[2]} * {lab[2]})", f"atan2({lab[2]}, {lab[1]})"]


def distance(p: str, q: str, space: str) -> str:
    """Between aliases p and q with columns v0, v1, v2."""
    d = [f"({p}.v{k} - {q}.v{k})" for k in range(3)]
    if space == "weighted-rgb":
        red = f"(({p}.v0 + {q}.v0) / 2)"
        return f"({red} / 256 + 2) * {d[0]} * {d[0]} + 4 * {d[1]} * {d[1]} + ((255 - {red}) / 256 + 2) * {d[2]} * {d[2]}"
    if space == "oklch":
        turn = f"least({p}.v1, {q}.v1) * (CASE WHEN abs({d[2]}) > pi() THEN 2 * pi() - abs({d[2]}) ELSE abs({d[2]}) END)"
        return f"{d[0]} * {d[0]} + {d[1]} * {d[1]} + ({turn}) * ({turn})"
    return " + ".join(f"{x} * {x}" for x in d)


def nearest(source: str, space: str, rgb: Triple = RGB, name: str = "matched", vectors: list[str] | None = None) -> str:
    """CTEs that give every row of ``source`` (with column rid) the ordinal idx of the palette ``pal``."""
    q = vector(RGB, space)
    v = vectors or vector(rgb, space)
    cols = lambda x: ", ".join(f"{e} AS v{k}" for k, e in enumerate(x))
    return f"""{name}_p AS (SELECT ord, {cols(q)} FROM pal WHERE kind <> 'transparent'), {name}_s AS (SELECT rid, {cols(v)} FROM {source}),
        {name} AS (SELECT rid, arg_min(ord, (d, ord)) AS idx FROM (SELECT s.rid, q.ord, {distance("s", "q", space)} AS d FROM {name}_s s, {name}_p q) GROUP BY rid)"""


def composite(mode: str) -> Triple:
    """Colours under the matte white."""
    if mode == "preserve":
        return RGB
    if mode == "premultiplied":
        return tuple(f"(CASE WHEN a = 255 THEN {c} ELSE floor({c} * (a / 255.0::DOUBLE) + 0.5)::INT END)" for c in RGB)
    return tuple(f"(CASE WHEN a = 255 THEN {c} ELSE floor({c} * (a / 255.0::DOUBLE) + 255.0::DOUBLE * (1.0 - a / 255.0::DOUBLE) + 0.5)::INT END)" for c in RGB)
