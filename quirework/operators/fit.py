"""Fitting text into boxes: wrapping, font size and line placement."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that begin no line, and such that end none.
NOT_FIRST = frozenset("。、．，：；！？）」』】〉》〕］｝)ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー々ゝゞヽヾ")
NOT_LAST = frozenset("（「『【〈《〔［｛(")
BREAK = "\0"
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF), (0x3000, 0x303F))


@dataclass(frozen=True)
class Font:
    """Widths by em. Characters without one are ``cjk`` wide if they are CJK, else ``default``. The table of a real font
    comes from :func:`glyph_font`, where unknown characters are 0 wide."""

    widths: dict[str, float] = field(default_factory=lambda: {" ": 0.25, "i": 0.25, "l": 0.25, ".": 0.25, ",": 0.25, "m": 0.75, "w": 0.75})
    default: float = 0.5
    ascent: float = 0.75
    descent: float = -0.25
    cjk: float = 1.0

    @cached_property
    def table(self) -> np.ndarray:
        """Widths by code point; the last entry is that of all code points beyond the basic plane."""
        out = np.full((1 << 16) + 1, self.default)
        for a, b in CJK:
            out[max(a, 0x3000) : b + 1] = self.cjk
        for c, w in self.widths.items():
            if ord(c) < 1 << 16:
                out[ord(c)] = w
        return out

    def ems(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[np.minimum(codes, 1 << 16)]
        if len(codes) and codes.max() >= 1 << 16:
            for i in np.flatnonzero(codes >= 1 << 16):
                out[i] = self.widths.get(text[i], out[i])
        return out

    def width(self, text: str, size: float) -> float:
        return float(self.ems(text).sum()) * size

    def line_height(self, size: float) -> float:
        return (self.ascent - self.descent) * size * 1.2


def glyph_font(glyphs: DataFrame, most: int = 1 << 17) -> Font:
    """The font of a table of glyphs (code int, width double, by em): at most ``most`` rows, else ValueError. Of repeated
    codes the greatest width counts; characters without a row are 0 wide."""
    rows = glyphs.where("code IS NOT NULL AND width IS NOT NULL").groupBy("code").agg(F.max("width").alias("width")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} glyphs")
    return Font({chr(r.code): float(r.width) for r in rows}, default=0.0, cjk=0.0)


@dataclass(frozen=True)
class FitConfig:
    step: float = 0.5
    smallest: float = 6.0
    break_factor: float = 0.5


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def _widths(text: str, font: Font) -> list[float]:
    """Widths up to each character, by em."""
    return np.concatenate([[0.0], np.cumsum(font.ems(text))]).tolist()


def break_point(text: str, at: int, upto: list[float], ems: float) -> int:
    """How many characters the line that begins at ``at`` takes, at least one."""
    left = len(text) - at
    n = bisect_right(upto, upto[at] + ems, at) - 1 - at
    if n <= 0 or n >= left:
        return max(min(n, left), 1)
    if text[at + n] in NOT_FIRST:
        n += 1
    elif n > 1 and text[at + n - 1] in NOT_LAST:
        n -= 1
    if not is_cjk(text[at + n - 1]):
        blank = text.rfind(" ", at + max(0, n - 20) + 1, at + n)
        if blank > 0:
            return blank + 1 - at
    return n


def measured(text: str, font: Font) -> list[tuple[str, list[float]]]:
    """The text's own lines, stripped, with their widths."""
    return [(part, _widths(part, font)) for part in map(str.strip, text.split("\n"))]


def wrap_measured(parts: list[tuple[str, list[float]]], ems: float) -> list[str]:
    out: list[str] = []
    for i, (part, upto) in enumerate(parts):
        if i:
            out.append(BREAK)
        at = 0
        while at < len(part):
            n = break_point(part, at, upto, ems)
            if line := part[at : at + n].strip():
                out.append(line)
            at += n
            while at < len(part) and part[at].isspace():
                at += 1
    while out and out[-1] == BREAK:
        out.pop()
    return out


def wrap_lines(text: str, width: float, font: Font, size: float) -> list[str]:
    """Lines, with BREAK between the text's own lines; none at the end."""
    return wrap_measured(measured(text, font), width / size)


def least_lines(parts: list[tuple[str, list[float]]], font: Font) -> list[tuple[float, float]]:
    """(width of what is no blank, widest character) of each of the text's lines that has characters: a wrapped line
    takes no more than its width and one character beyond, so their number has a lower bound."""
    out = []
    for part, _ in parts:
        if part:
            ems = font.ems(part)
            ink = ems[[not c.isspace() for c in part]]
            out.append((float(ink.sum()), float(ems.max())))
    return out


def fit_text(text: str, width: float, height: float, size: float, font: Font, config: FitConfig = FitConfig()) -> tuple[float, bool, float, list[str]]:
    """(size, fits, height, lines): the largest size, in steps down, at which the lines fit; else the smallest. Sizes at
    which the ink alone takes more lines than fit are passed over."""
    if not text:
        return size, True, 0.0, []

    def tall(lines: list[str], s: float) -> float:
        breaks = lines.count(BREAK)
        return font.line_height(s) * (len(lines) - breaks + config.break_factor * breaks)

    parts = measured(text, font)
    ink = least_lines(parts, font)
    while size >= config.smallest:
        ems = width / size
        least = sum(math.ceil(w / (ems + top) - 1e-9) for w, top in ink) if ems > 0 else 0
        if font.line_height(size) * least <= height * (1 + 1e-9) + 1e-9:
            lines = wrap_measured(parts, ems)
            if not lines:
                break
            if tall(lines, size) <= height:
                return size, True, tall(lines, size), lines
        size = round(size - config.step, 2)
    lines = wrap_measured(parts, width / config.smallest)
    return config.smallest, False, tall(lines, config.smallest), lines


def wrap(paragraphs: DataFrame, size: float, font: Font = Font()) -> DataFrame:
    """(doc_id, id, line_no, line, is_break)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [wrap_lines(t or "", w, font, size) for t, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.string()))], names=["doc_id", "id", "lines"])

    rows = paragraphs.select("doc_id", "id", "text", F.expr("x1 - x0").alias("w")).mapInArrow(run, "doc_id long, id string, lines array<string>")
    out = rows.select("doc_id", "id", F.posexplode("lines").alias("line_no", "line"))
    return out.withColumn("is_break", F.col("line") == BREAK)


def fit(paragraphs: DataFrame, font: Font = Font(), config: FitConfig = FitConfig(), keep: tuple[str, ...] = ("doc_id", "id")) -> DataFrame:
    """(the columns of ``keep``, font_size, fits, total_height, lines array<text, width, y_position>). Text near 90 or 270
    degrees runs along the box's height."""
    turn = F.pmod(F.coalesce("rotation", F.lit(0.0)) if "rotation" in paragraphs.columns else F.lit(0.0), F.lit(360.0))
    sideways = turn.between(85, 95) | turn.between(265, 275)
    w, h = F.expr("x1 - x0"), F.expr("y1 - y0")
    kept = F.struct(*keep).alias("kept")
    rows = paragraphs.select(kept, "text", F.when(sideways, h).otherwise(w).alias("w"), F.when(sideways, w).otherwise(h).alias("h"), "y1", F.col("original_font_size").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, oks, talls, counts = [], [], [], []
            texts, widths, places = [], [], []
            for text, w, h, top, size in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                size, fits, tall, lines = fit_text(text or "", w, h, size, font, config)
                y, step, before = top - font.ascent * size, font.line_height(size), len(texts)
                for line in lines:
                    if line == BREAK:
                        y -= step * config.break_factor
                    else:
                        texts.append(line)
                        widths.append(font.width(line, size))
                        places.append(y)
                        y -= step
                for c, v in zip((sizes, oks, talls, counts), (size, fits, tall, len(texts) - before)):
                    c.append(v)
            lines = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(widths, pa.float64()), pa.array(places, pa.float64())], ["text", "width", "y_position"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.float64()), pa.array(oks, pa.bool_()), pa.array(talls, pa.float64()), pa.ListArray.from_arrays(offsets, lines)],
                names=["kept", "font_size", "fits", "total_height", "lines"],
            )

    lines = "font_size double, fits boolean, total_height double, lines array<struct<text: string, width: double, y_position: double>>"
    out = rows.mapInArrow(run, T.StructType([rows.schema["kept"], *T.StructType.fromDDL(lines)]))
    return out.select("kept.*", "font_size", "fits", "total_height", "lines")


def place_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (box, width, y_position, rotation in degrees, alignment) with the x and y where each line starts."""
    turn = F.pmod("rotation", F.lit(360.0))
    up, down = turn.between(265, 275), turn.between(85, 95)
    along = F.when(up | down, F.expr("y1 - y0")).otherwise(F.expr("x1 - x0"))
    shift = F.when(F.col("alignment") == "center", (along - F.col("width")) / 2).when(F.col("alignment") == "right", along - F.col("width")).otherwise(0.0)
    drop = F.col("y_position") - F.col("y1")
    a = F.radians("rotation")
    plain = F.abs(a) <= 0.001
    x = F.when(up, F.col("x1") + drop).when(down, F.col("x0") - drop).when(plain, F.col("x0") + shift).otherwise(F.col("x0") + shift * F.cos(a) - drop * F.sin(a))
    y = F.when(up, F.col("y0") + shift).when(down, F.col("y1") - shift).when(plain, F.col("y_position")).otherwise(F.col("y1") + shift * F.sin(a) + drop * F.cos(a))
    return lines.withColumn("x", x).withColumn("y", y)
