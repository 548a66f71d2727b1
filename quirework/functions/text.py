"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without a glyph in standard fonts, and what stands for them.
ASCII_FALLBACK = {
    "∗": "*", "×": "x", "÷": "/", "−": "-", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"',
    "…": "...", "•": "*", "′": "'", "″": '"', "°": "o", "·": ".", "≤": "<=", "≥": ">=", "≠": "!=", "±": "+/-",
    "∞": "inf", "≈": "~=", "√": "sqrt", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "π": "pi", "σ": "sigma", "μ": "mu",
}
CONTROLS = "".join(map(chr, [*range(32), 127, 255]))
SPACES = r"(?U)[\s\x1C-\x1F]"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, rf"^{SPACES}+|{SPACES}+$".replace("|(?U)", "|"), "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, f"{SPACES}+", " "))


def normalise_controls(x: Column, keep_newlines: bool = False) -> Column:
    """STX and soft hyphens become hyphens, tabs and line feeds blanks, other control characters and U+00FF go."""
    mapped = {"\x02": "-", "­": "-", "\t": " ", "\n": " "}
    if keep_newlines:
        del mapped["\n"]
    gone = "".join(c for c in CONTROLS if c not in mapped and not (keep_newlines and c == "\n"))
    return F.translate(x, "".join(mapped) + gone, "".join(mapped.values()))


def ascii_fallback(x: Column) -> Column:
    single = {k: v for k, v in ASCII_FALLBACK.items() if len(v) == 1}
    x = F.translate(x, "".join(single), "".join(single.values()))
    for k, v in ASCII_FALLBACK.items():
        if len(v) > 1:
            x = F.replace(x, F.lit(k), F.lit(v))
    return x


def compare_key(x: Column) -> Column:
    """For comparing documents: control characters, soft hyphens and U+00FF go, so words may fuse; white space collapses."""
    return collapse(F.translate(x, CONTROLS + "­", ""))


def escape_cell(x: Column) -> Column:
    return strip(F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def token_count(x: Column) -> Column:
    """Without an encoder a character counts as a token; an empty text has none."""
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.lit(1), F.length(x)))
