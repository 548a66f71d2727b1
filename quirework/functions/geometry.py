"""Boxes as flat columns x0, y0, x1, y1 (origin bottom left, y up). SQL text, so that it also works inside folds."""

from __future__ import annotations


def width(b: str) -> str:
    return f"({b}.x1 - {b}.x0)"


def height(b: str) -> str:
    return f"({b}.y1 - {b}.y0)"


def area(b: str) -> str:
    return f"({width(b)} * {height(b)})"


def intersection_area(a: str, b: str) -> str:
    """0 for boxes that only touch."""
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0D END)"


def containment(inner: str, outer: str) -> str:
    """Share of the inner box that lies in the outer one; 0 for a box without area."""
    return f"(CASE WHEN {area(inner)} > 0 THEN {intersection_area(inner, outer)} / {area(inner)} ELSE 0D END)"


def x_overlap(a: str, b: str) -> str:
    """Horizontal overlap by the smaller width; 0 without overlap or width."""
    ov = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    w = f"least({width(a)}, {width(b)})"
    return f"(CASE WHEN {ov} > 0 AND {w} > 0 THEN {ov} / {w} ELSE 0D END)"
