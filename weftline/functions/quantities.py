"""Numbers with units: the unit table, the number grammar and conversions to base units."""

from __future__ import annotations

import re

# Unit spellings, by dimension, as factors to the dimension's base unit.
UNITS: dict[str, dict[str, float]] = {
    "length_mm": {
        "mm": 1, "millimetre": 1, "millimetres": 1, "millimeter": 1, "millimeters": 1,
        "cm": 10, "centimetre": 10, "centimetres": 10, "centimeter": 10, "centimeters": 10,
        "m": 1000, "metre": 1000, "metres": 1000, "meter": 1000, "meters": 1000,
        "in": 25.4, "inch": 25.4, "inches": 25.4, "zoll": 25.4, '"': 25.4, "''": 25.4,
        "ft": 304.8, "foot": 304.8, "feet": 304.8,
    },
    "mass_g": {
        "g": 1, "gram": 1, "grams": 1, "kg": 1000, "kilogram": 1000, "kilograms": 1000, "kilo": 1000, "kilos": 1000,
        "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237,
        "oz": 453.59237 / 16, "ounce": 453.59237 / 16, "ounces": 453.59237 / 16,
    },
    "power_mw": {
        "mw": 1, "milliwatt": 1, "milliwatts": 1, "w": 1000, "watt": 1000, "watts": 1000, "kw": 1e6, "kilowatt": 1e6, "kilowatts": 1e6,
    },
    "frequency_hz": {
        "hz": 1, "hertz": 1, "cycles/s": 1, "cycles per second": 1, "khz": 1000, "kilohertz": 1000,
    },
    "luminance_cd": {"cd/m2": 1, "cd per sqm": 1, "nits": 1, "nit": 1},
    "ratio": {":1": 1, "to 1": 1},
}

#: A comma or blank before exactly three digits groups them; any other comma is a decimal sign.
NUMBER = r"\d{1,3}(?:[, ]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d+)?"


def number(text: str) -> float:
    """Value of a text that matches NUMBER."""
    grouped = re.fullmatch(r"(\d{1,3}(?:[, ]\d{3})+)(\.\d+)?", text)
    if grouped:
        return float(re.sub(r"[, ]", "", grouped[1]) + (grouped[2] or ""))
    return float(text.replace(",", "."))


def unit_key(text: str) -> str:
    """Spelling of a unit as the table has it."""
    t = " ".join(text.lower().split()).strip()
    return t if t in ('"', "''") else t.rstrip(".").strip()


def unit_pattern(*dimensions: str) -> str:
    """Alternation of the dimensions' unit spellings, longest first, each ending at a word's end."""
    names = sorted({u for d in dimensions for u in UNITS[d]}, key=lambda u: (-len(u), u))
    return "|".join(re.escape(u).replace(r"\ ", r"\s+") + (r"(?![^\W_])\.?" if u[-1].isalnum() else "") for u in names)
