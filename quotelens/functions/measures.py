"""Pack, length, area, volume and weight stated in a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import rnd

# --- fixed values: patterns -----------------------------------------------------
NUM_PACK = r"(\d{1,3}(?:[.,]\d{3})+|\d+)"
NUM_DEC = r"(\d+(?:[.,]\d+)?)"
UNIT_AFTER = r"(\s*(?:kgs?|kilos?|grs?|lts?|litros?|mm|cm|mts?|ml|m)\b)?"
PACK_EXPLICIT = rf"(?iU)(?:x|por)\s*{NUM_PACK}\s*(?:un\b|u\b|unid\w*)"
PACK_WORD = rf"(?iU)(?:cajas?|cja|bolsas?|blsa|packs?|bultos?|blister|paquetes?|paq)[^0-9]{{0,15}}?[x*]\s*{NUM_PACK}{UNIT_AFTER}"
PACK_ROUND = rf"(?iU)\s[x*]\s+{NUM_PACK}\s*[)\"']?\s*$"
SHEET_LENGTH = r"(?iU)[x*]\s*(\d(?:[.,]\d+)?)\s*(?:m|mt|mts|ml|metros?)\b"
WEIGHT_KG = rf"(?iU){NUM_DEC}\s*(?:kgs?|kilos?|kg\.)\b"
WEIGHT_TN = rf"(?iU){NUM_DEC}\s*(?:tns?|toneladas?)\b"
DIM_PAIR = rf"(?<![\d.,]){NUM_DEC}\s*[xX]\s*{NUM_DEC}(?![\d.,])"
TRUCK_VOLUME = rf"(?iU)chasis\s*{NUM_DEC}\s*(?:mt?s?|m3)?"
PER_M3 = r"(?iU)\b(?:x|por)\s*(?:m3|m³|metro\s*cubico)"
PER_METRE = r"(?iU)^\s*mts?\.?\s|\b(?:x|por)\s*(?:metros?|mts?|ml|m)\b"
METRE_UNITS = ("ML", "M", "MT", "MTS", "METRO", "METROS")
TAIL_PACK = r"(?i)[*x]\s*(\d{2,4})\s*(m|mts|u)?\.?[\"\s]*$"
DIM_CHAIN = r"(?i)\d\s*[*x]\s*\d+(?:[.,]\d+)?\s*[*x]\s*\d"
TAIL_UNITS = ("mm", "m", "mts", "cm", "grs", "gr", "kg", "lt", "lts")


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _first(col: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(_text(col), pattern, group), F.lit(""))


def _decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).cast("double")


def _whole(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[.,]", "").cast("double"), F.lit(0.0))


def pack_size(desc: Column) -> Column:
    """Pieces per pack: explicit unit, presentation word, or a round number at the end."""
    explicit = _whole(_first(desc, PACK_EXPLICIT))
    # the unit behind the number is read only where there is a number
    number = _first(desc, PACK_WORD)
    word = F.when(number.isNotNull() & (F.regexp_extract(_text(desc), PACK_WORD, 2) == ""), _whole(number))
    tail = _whole(_first(desc, PACK_ROUND))
    return F.coalesce(explicit, word, F.when((tail >= 25) & (tail % 25 == 0), tail))


def sheet_length(desc: Column) -> Column:
    return _decimal(_first(desc, SHEET_LENGTH))


def sheet_area(desc: Column) -> Column:
    """First A x B with different sides of at most 12 m; grids and long chains do not count."""
    sides = F.arrays_zip(
        F.regexp_extract_all(_text(desc), F.lit(DIM_PAIR), 1).alias("p"), F.regexp_extract_all(_text(desc), F.lit(DIM_PAIR), 2).alias("q"))
    pairs = F.transform(sides, lambda s: F.struct(_decimal(s["p"]).alias("x"), _decimal(s["q"]).alias("y")))
    ok = F.filter(pairs, lambda s: (s["x"] != s["y"]) & (s["x"] > 0) & (s["y"] > 0) & (s["x"] <= 12) & (s["y"] <= 12))
    return F.get(F.transform(ok, lambda s: rnd(s["x"] * s["y"], 4)), 0)


def truck_volume(desc: Column) -> Column:
    return F.nullif(_decimal(_first(desc, TRUCK_VOLUME)), F.lit(0.0))


def weight_kg(desc: Column) -> Column:
    return F.coalesce(_decimal(_first(desc, WEIGHT_KG)), _decimal(_first(desc, WEIGHT_TN)) * 1000)


def per_metre(desc: Column, unit: Column) -> Column:
    return unit.isin(*METRE_UNITS) | _text(desc).rlike(PER_METRE)


def tail_pack(name: Column) -> Column:
    """Pack factor at the end of a catalogue name: struct(factor, metros) or null."""
    t = F.trim(_text(name))
    number, unit = F.regexp_extract(t, TAIL_PACK, 1), F.lower(F.regexp_extract(t, TAIL_PACK, 2))
    before = F.regexp_replace(t, TAIL_PACK, "")
    sign = F.lower(F.substring(t, F.length(before) + 1, F.lit(1)))
    letters = F.lower(F.regexp_extract(before, r"(?i)([a-záéíóúñ]+)$", 1))
    glued = (sign == "x") & F.substring(before, -1, 1).rlike(r"\p{L}") & ~letters.isin(*TAIL_UNITS)
    measure = (unit == "") & F.rtrim(before).rlike(r"\d$")
    factor = number.cast("int")
    ok = (number != "") & ~t.rlike(DIM_CHAIN) & factor.between(10, 1000) & ~glued & ~measure
    metres = F.startswith(unit, F.lit("m")) | F.upper(t).rlike("CABLE|MANGUERA|ROLLO")
    return F.when(ok, F.struct(factor.alias("factor"), metres.alias("metros")))
