"""Text formats: decimal comma and the minus sign U+2212."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"


def _comma(text: Column) -> Column:
    return F.translate(text, ".-", "," + MINUS)


def number_text(x: Column, places: int = 0, percent: bool = True) -> Column:
    """A percentage, or a number with spaces between thousands."""
    if percent:
        return _comma(F.format_string(f"%.{places}f%%", x * 100))
    return F.translate(F.format_string(f"%,.{places}f", x), ",.-", " ," + MINUS)


def signed_percent(x: Column, places: int = 1) -> Column:
    return _comma(F.format_string(f"%+.{places}f%%", x * 100))


def unsigned_percent(x: Column, places: int = 1) -> Column:
    """As signed_percent, without a leading plus."""
    return F.regexp_replace(signed_percent(x, places), r"^\++", "")


def fixed(x: Column, places: int = 2) -> Column:
    return _comma(F.format_string(f"%.{places}f", x))


def disclosure(base: Column, position: Column, sources: Column, reviewed: Column, conflicts: Column) -> Column:
    """The disclosure line of a publication, in the language of the original."""
    return F.format_string("Data-base: %s | Posição do autor: %s | Natureza: educacional | Principais fontes: %s | Última revisão: %s | Conflitos relevantes: %s", base, position, sources, reviewed, conflicts)
