"""Scalar column expressions (all Catalyst built-ins; no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_classes as uc

# ---------------------------------------------------------------------------
# Segmentation tables (must equal the benchmark's definitions).
CHARACTER_BASED_PAIRS: tuple[tuple[str, str], ...] = (
    ("cmn", "Hani"),
    ("yue", "Hani"),
    ("zho", "Hani"),
    ("jpn", "Jpan"),
    ("tha", "Thai"),
    ("khm", "Khmr"),
    ("lao", "Laoo"),
    ("mya", "Mymr"),
    ("sat", "Olck"),
    ("nod", "Lana"),
)
CHARACTER_BASED_SCRIPTS: tuple[str, ...] = ("Hani", "Hans", "Hant", "Thai", "Khmr", "Laoo", "Mymr", "Olck", "Lana", "Jpan")
CHARACTER_BASED_SCRIPT_SUBSTRING = "Han"
SYLLABLE_BASED_PAIRS: tuple[tuple[str, str], ...] = (("bod", "Tibt"), ("dzo", "Tibt"), ("lad", "Tibt"))
SYLLABLE_BASED_SCRIPTS: tuple[str, ...] = ("Tibt", "Tibetan")
TSHEG = "་"  # Tibetan syllable delimiter
MIN_SYLLABLES = 3  # fewer syllables than this in a whole text -> character units
# Size units of catalogue sizes and how a number in that unit becomes GB (checked in this order).
SIZE_UNITS: tuple[tuple[str, str, float], ...] = (("TB", "*", 1000.0), ("GB", "*", 1.0), ("MB", "/", 1000.0))
# ---------------------------------------------------------------------------


def utf8_len(text: Column) -> Column:
    """UTF-8 byte length."""
    return F.octet_length(text)


# --- segmentation choice (F3, F4) -------------------------------------------


def _pair_in(iso: Column, script: Column, pairs) -> Column:
    cond = F.lit(False)
    for i, s in pairs:
        cond = cond | ((iso == F.lit(i)) & (script == F.lit(s)))
    return cond


def is_syllable_based(iso: Column, script: Column) -> Column:
    iso_l = F.lower(F.coalesce(iso, F.lit("")))
    scr = F.coalesce(script, F.lit(""))
    return _pair_in(iso_l, scr, SYLLABLE_BASED_PAIRS) | scr.isin(*SYLLABLE_BASED_SCRIPTS)


def is_character_based(iso: Column, script: Column) -> Column:
    iso_l = F.lower(F.coalesce(iso, F.lit("")))
    scr = F.coalesce(script, F.lit(""))
    return (
        _pair_in(iso_l, scr, CHARACTER_BASED_PAIRS)
        | scr.isin(*CHARACTER_BASED_SCRIPTS)
        | scr.contains(CHARACTER_BASED_SCRIPT_SUBSTRING)
    )


def segmentation_method(iso: Column, script: Column) -> Column:
    """'syllable' (checked first), 'character' or 'whitespace'."""
    return (
        F.when(is_syllable_based(iso, script), F.lit("syllable"))
        .when(is_character_based(iso, script), F.lit("character"))
        .otherwise(F.lit("whitespace"))
    )


# --- units (F5, F6, F7) -----------------------------------------------------


def whitespace_units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(uc.java_whitespace_unit_pattern()), 0)


def whitespace_unit_count(text: Column) -> Column:
    """Number of whitespace units, counted without materialising them."""
    return F.regexp_count(text, F.lit(uc.java_whitespace_unit_pattern()))


def _unit_characters(text: Column, without: str = "") -> Column:
    """The text's character units as one string: the runs of other characters are cut out."""
    return F.regexp_replace(text, F.lit(uc.java_no_unit_pattern(without)), F.lit(""))


def _characters(text: Column) -> Column:
    """The characters of a string; none of an empty one (of which ``split`` makes one empty string)."""
    return F.slice(F.split(text, ""), 1, F.char_length(text))


def character_unit_count(text: Column) -> Column:
    return F.char_length(_unit_characters(text))


def character_units(text: Column) -> Column:
    return _characters(_unit_characters(text))


def joined_character_units(text: Column, separator: str) -> Column:
    """The text's character units as one string with a separator between them."""
    return F.array_join(F.split(_unit_characters(text), ""), separator)


def character_units_without_tsheg(text: Column) -> Column:
    return _characters(_unit_characters(text, TSHEG))


def character_unit_count_without_tsheg(text: Column) -> Column:
    return F.char_length(_unit_characters(text, TSHEG))


def strip_ws(text: Column) -> Column:
    w = uc.ws()
    return F.regexp_replace(text, F.lit(f"^[{w}]+|[{w}]+$"), F.lit(""))


def syllable_units(text: Column) -> Column:
    """Split on the tsheg, strip, drop empties (the whole-text fallback is decided by the caller)."""
    parts = F.transform(F.split(text, TSHEG, -1), strip_ws)
    return F.filter(parts, lambda s: s != F.lit(""))


def syllable_unit_count(text: Column) -> Column:
    """Size of :func:`syllable_units`: stretches between tshegs that hold more than white space."""
    return F.regexp_count(text, F.lit(uc.java_syllable_pattern(TSHEG)))


# --- Unicode predicates (F8-F11) --------------------------------------------


def unicode_scripts(text: Column) -> Column:
    """F8: array of script labels present in the text, in ``SCRIPT_LABELS`` order."""
    flags = [F.when(text.rlike(uc.script_class(label)), F.lit(label)) for label in uc.SCRIPT_LABELS]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def starts_with_whitespace(text: Column) -> Column:
    """first character is (Python) whitespace; NULL/empty -> false."""
    return F.coalesce(text.rlike(uc.starts_with_ws_pattern()), F.lit(False))


def has_inner_whitespace(text: Column) -> Column:
    """whitespace remains after stripping the edges."""
    return F.coalesce(text.rlike(uc.inner_ws_pattern()), F.lit(False))


# --- bytes, slices, seeds (F12, F14) ------------------------------------------


def utf8_bytes_of_char(ch: Column) -> Column:
    """UTF-8 byte values (ints) of a one-character string, computed from its code point."""
    cp = F.ascii(ch)

    def cont(shift: int) -> Column:
        v = F.shiftright(cp, shift) if shift else cp
        return F.lit(0x80).bitwiseOR(v.bitwiseAND(F.lit(0x3F)))

    return (
        F.when(cp < 0x80, F.array(cp))
        .when(cp < 0x800, F.array(F.lit(0xC0).bitwiseOR(F.shiftright(cp, 6)), cont(0)))
        .when(cp < 0x10000, F.array(F.lit(0xE0).bitwiseOR(F.shiftright(cp, 12)), cont(6), cont(0)))
        .otherwise(F.array(F.lit(0xF0).bitwiseOR(F.shiftright(cp, 18)), cont(12), cont(6), cont(0)))
    )


def _is_continuation(binary: Column, pos0: Column) -> Column:
    """Byte at 0-based ``pos0`` exists and is a UTF-8 continuation byte (0x80-0xBF)."""
    inside = (pos0 >= 0) & (pos0 < F.octet_length(binary))
    return inside & F.coalesce(F.hex(F.substring(binary, pos0 + 1, 1)).rlike("^[89AB]"), F.lit(False))


def utf8_safe_range(binary: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """``[start, end)`` moved inwards to character borders: the start forward past at most three
    continuation bytes, the end back to the lead byte of a cut character.

    Written as sums of chained tests (no nested conditionals), so the expression stays small.
    """
    n = F.octet_length(binary)
    s0 = F.greatest(start, F.lit(0))
    c1 = _is_continuation(binary, s0)
    c2 = c1 & _is_continuation(binary, s0 + 1)
    c3 = c2 & _is_continuation(binary, s0 + 2)
    s = s0 + c1.cast("int") + c2.cast("int") + c3.cast("int")
    e0 = F.least(end, n)
    d1 = _is_continuation(binary, e0)
    d2 = d1 & _is_continuation(binary, e0 - 1)
    d3 = d2 & _is_continuation(binary, e0 - 2)
    e = e0 - d1.cast("int") - d2.cast("int") - d3.cast("int")
    return s, e


def utf8_slice_bytes(binary: Column, start: Column, end: Column) -> Column:
    """F12 on UTF-8 bytes: the characters lying wholly inside ``[start, end)``."""
    s, e = utf8_safe_range(binary, start, end)
    length = F.greatest(e - s, F.lit(0))
    return F.when(length > 0, F.substring(binary, s + 1, length).cast("string")).otherwise(F.lit(""))


def utf8_slice(text: Column, start: Column, end: Column) -> Column:
    """characters whose bytes lie wholly inside ``[start, end)`` of the UTF-8 form.

    Only the at most three bytes at each edge are looked at, so the cost does not depend on
    the length of the text.
    """
    return utf8_slice_bytes(F.encode(text, "UTF-8"), start, end)


def language_seed(iso: Column, script: Column) -> Column:
    """first 8 bytes of SHA-1(``iso:script``) as an unsigned big-endian integer."""
    digest = F.sha1(F.encode(F.concat_ws(":", F.coalesce(iso, F.lit("")), F.coalesce(script, F.lit(""))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


# --- catalogue helpers (F2, F17) ----------------------------------------------


def parse_size_gb(size: Column) -> Column:
    """F2: '1.2 TB' -> 1200.0, 'GB' as is, 'MB' / 1000, anything else 0.0; bad numbers -> NULL."""
    s = F.trim(F.coalesce(size.cast("string"), F.lit("None")))
    out = F.lit(0.0)
    expr = None
    for unit, op, factor in SIZE_UNITS:
        raw = F.trim(F.regexp_replace(s, unit, "")).try_cast("double")
        num = raw * F.lit(factor) if op == "*" else raw / F.lit(factor)
        expr = F.when(s.contains(unit), num) if expr is None else expr.when(s.contains(unit), num)
    return expr.otherwise(out)


def title_case(s: Column) -> Column:
    """Python ``str.title()``: upper-case a cased letter after a non-cased character."""
    runs = F.regexp_extract_all(s, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0)
    fixed = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]"),
            F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))),
        ).otherwise(r),
    )
    return F.array_join(fixed, "")


def safe_output_name(name: Column) -> Column:
    """S9: '/' and '-' become '_'."""
    return F.translate(name, "/-", "__")
