"""Units of measured quantities: the table of spellings is built by rule from
prefixes and unit names, and everything is relative to one base unit each."""

from __future__ import annotations

import re
from dataclasses import dataclass

# SI prefixes, and per quantity the unit symbols and names with
# their size in the base unit. Symbols keep their case, names don't.
PREFIX_SYMBOLS = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "μ": 1e-6, "m": 1e-3, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
PREFIX_NAMES = {"femto": 1e-15, "pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "kilo": 1e3, "mega": 1e6, "meg": 1e6, "giga": 1e9, "tera": 1e12}
PREFIXED_SYMBOLS = {
    "voltage": {"V": 1.0, "V DC": 1.0, "VDC": 1.0, "V AC": 1.0, "Vdc": 1.0},
    "current": {"A": 1.0},
    "frequency": {"Hz": 1.0, "HZ": 1.0, "hz": 1.0},
    "time": {"s": 1.0, "sec": 1.0},
    "resistance": {"Ω": 1.0, "ohm": 1.0, "Ohm": 1.0, "ohms": 1.0, "Ohms": 1.0, "OHM": 1.0},
    "capacitance": {"F": 1.0},
    "power": {"W": 1.0},
    "rate": {"bps": 1.0, "bit/s": 1.0, "b/s": 1.0, "Bps": 8.0, "B/s": 8.0, "byte/s": 8.0},
    "length": {"m": 1.0},
}
PREFIXED_NAMES = {
    "voltage": {"volt": 1.0, "volts": 1.0},
    "current": {"amp": 1.0, "amps": 1.0, "ampere": 1.0, "amperes": 1.0},
    "frequency": {"hertz": 1.0},
    "time": {"second": 1.0, "seconds": 1.0, "sec": 1.0, "secs": 1.0},
    "resistance": {"ohm": 1.0, "ohms": 1.0},
    "capacitance": {"farad": 1.0, "farads": 1.0},
    "power": {"watt": 1.0, "watts": 1.0},
    "rate": {"bits per second": 1.0, "bytes per second": 8.0, "bits/s": 1.0, "bytes/s": 8.0},
    "length": {"metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0},
}
PLAIN_SYMBOLS = {
    "time": {"min": 60.0, "h": 3600.0, "hr": 3600.0},
    "length": {"cm": 1e-2, "in": 0.0254, "mil": 2.54e-5, "mils": 2.54e-5},
}
PLAIN_NAMES = {
    "time": {"minute": 60.0, "minutes": 60.0, "hour": 3600.0, "hours": 3600.0},
    "length": {"inch": 0.0254, "inches": 0.0254, "micron": 1e-6, "microns": 1e-6, "centimetre": 1e-2, "centimetres": 1e-2, "centimeter": 1e-2, "centimeters": 1e-2},
}
#: Kelvin is the base of temperature: base = value * factor + offset.
TEMPERATURES = {
    "K": (1.0, 0.0), "kelvin": (1.0, 0.0), "kelvins": (1.0, 0.0),
    "°C": (1.0, 273.15), "degC": (1.0, 273.15), "deg C": (1.0, 273.15), "celsius": (1.0, 273.15),
    "°F": (5 / 9, 459.67 * 5 / 9), "degF": (5 / 9, 459.67 * 5 / 9), "deg F": (5 / 9, 459.67 * 5 / 9), "fahrenheit": (5 / 9, 459.67 * 5 / 9),
}
#: Logarithmic units: base = reference * 10 ** (value / 10).
DECIBELS = {"dBm": 1e-3, "dBW": 1.0}

#: What a row is about, by the last words of its description or its symbol.
QUANTITY_WORDS = ["voltage", "current", "frequency", "time", "resistance", "capacitance", "power", "temperature", "rate", "length"]
QUANTITY_LETTERS = {"V": "voltage", "I": "current", "f": "frequency", "t": "time", "R": "resistance", "C": "capacitance", "P": "power", "T": "temperature", "D": "rate", "L": "length"}


@dataclass(frozen=True)
class Unit:
    quantity: str
    factor: float
    offset: float = 0.0
    log: bool = False  # factor is the reference of a decibel unit


def _fold(table: dict[str, Unit], spelling: str, unit: Unit) -> None:
    table.setdefault(spelling, unit)


def unit_table() -> dict[str, Unit]:
    """Spelling -> unit; of two readings of one spelling the first built
    (plain before prefixed) counts. Names are in lower case."""
    out: dict[str, Unit] = {}
    for spelling, (factor, offset) in TEMPERATURES.items():
        _fold(out, spelling, Unit("temperature", factor, offset))
    for spelling, reference in DECIBELS.items():
        _fold(out, spelling, Unit("power", reference, log=True))
    for tables in (PLAIN_SYMBOLS, PLAIN_NAMES):
        for quantity, units in tables.items():
            for spelling, size in units.items():
                _fold(out, spelling, Unit(quantity, size))
    for tables, prefixes in ((PREFIXED_SYMBOLS, PREFIX_SYMBOLS), (PREFIXED_NAMES, PREFIX_NAMES)):
        for quantity, units in tables.items():
            for spelling, size in units.items():
                _fold(out, spelling, Unit(quantity, size))
        for quantity, units in tables.items():
            for spelling, size in units.items():
                for prefix, scale in prefixes.items():
                    _fold(out, prefix + spelling, Unit(quantity, size * scale))
    return out


#: Characters that print alike in units, and kinds of blank.
_ALIKE = str.maketrans({"µ": "μ", "Ω": "Ω", " ": " ", " ": " ", " ": " "})


def plain_spelling(text: str) -> str:
    """One form of a unit's spelling: signs and blanks that print alike, the
    one-character degree signs, no blanks around."""
    text = text.translate(_ALIKE).replace("℃", "°C").replace("℉", "°F").replace("K", "K").replace("º", "°")
    return re.sub(r"\s+", " ", text).strip().rstrip(".")


def lookup(table: dict[str, Unit], text: str) -> Unit | None:
    """The unit a text names, exactly or, for names, in any case."""
    spelling = plain_spelling(text)
    if spelling in table:
        return table[spelling]
    lower = spelling.lower()
    return table.get(lower) if len(lower) > 2 else None


def to_base(value: float, unit: Unit) -> float:
    return unit.factor * 10 ** (value / 10) if unit.log else value * unit.factor + unit.offset


def from_base(value: float, unit: Unit) -> float:
    return (value - unit.offset) / unit.factor
