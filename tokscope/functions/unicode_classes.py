"""Regex character classes generated from Python's ``unicodedata``.

The JVM, RE2 (DuckDB) and Python disagree on what ``\\s``, ``\\p{IsLatin}`` or "printable"
mean, so every class used by the library is spelled out as explicit code-point ranges
(``\\x{hhhh}`` syntax, understood by Java regex and by RE2).  The classes are computed
once per process from a rule over all code points; nothing here runs per row.
"""

from __future__ import annotations

import functools
import unicodedata

# ---------------------------------------------------------------------------
# Fixed values (must equal the benchmark's definitions for equal results).
# Script labels and the keywords searched for in a character's Unicode name, in
# priority order: the first label whose keyword occurs in the name wins.
SCRIPT_NAME_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Korean", ("HANGUL",)),
    ("Japanese", ("HIRAGANA", "KATAKANA")),
    ("Chinese", ("CJK", "HAN")),
    ("Latin", ("LATIN",)),
    ("Cyrillic", ("CYRILLIC",)),
    ("Arabic", ("ARABIC",)),
    ("Devanagari", ("DEVANAGARI",)),
    ("Thai", ("THAI",)),
    ("Hebrew", ("HEBREW",)),
    ("Greek", ("GREEK",)),
)
# Names containing one of these are symbols whatever their category.
SYMBOL_NAME_KEYWORDS: tuple[str, ...] = ("MATHEMATICAL", "DOUBLE-STRUCK")
# Category-derived labels: first letter of the general category -> label.
CATEGORY_LABELS: tuple[tuple[str, str], ...] = (("P", "Punctuation"), ("S", "Symbols"), ("N", "Numbers"))
# ---------------------------------------------------------------------------

#: Version of the character database that the registered results were made with.  Another version may label
#: newly assigned characters; ``tests/test_unicode.py`` says so before results change unseen.
UNICODE_VERSION = "15.1.0"

#: Output order of script labels everywhere in the library.
SCRIPT_LABELS: tuple[str, ...] = tuple(label for label, _ in SCRIPT_NAME_KEYWORDS) + (
    "Punctuation",
    "Symbols",
    "Numbers",
)

_MAX_CP = 0x110000
FAST_LIMIT = 0x250  # Latin-1 and Latin Extended-A/B: tested first in character units
_SURROGATES = range(0xD800, 0xE000)


def _code_points():
    for cp in range(_MAX_CP):
        if cp in _SURROGATES:
            continue
        yield cp


@functools.lru_cache(maxsize=1)
def _label_sets() -> dict[str, set[int]]:
    """Code points of each label: one set for each test, and each label keeps what the earlier ones left."""
    names, first_letters = {}, {}
    for cp in _code_points():
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category not in ("Cn", "Co") and not ch.isspace():  # the others have no name and no label
            names[cp], first_letters[cp] = unicodedata.name(ch, ""), category[0]
    having = lambda words: {cp for cp, name in names.items() if any(w in name for w in words)}
    tests = [("Symbols", having(SYMBOL_NAME_KEYWORDS))]
    tests += [(label, {cp for cp, c in first_letters.items() if c == letter}) for letter, label in CATEGORY_LABELS]
    tests += [(label, having(words)) for label, words in SCRIPT_NAME_KEYWORDS]
    left, out = set(names), {label: set() for label in SCRIPT_LABELS}
    for label, found in tests:
        out[label] |= found & left
        left -= found
    return out


def _ranges(cps: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in cps:
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def ranges_to_class_body(ranges: list[tuple[int, int]]) -> str:
    """Render ranges as the inside of a bracket expression (no brackets).

    Code points below 256 are written one by one: Java packs single characters below 256
    into one bit set, while every range becomes a separate test in a chain.
    """
    parts = []
    for lo, hi in ranges:
        if lo < 256:
            top = min(hi, 255)
            parts.extend(f"\\x{{{cp:x}}}" for cp in range(lo, top + 1))
            if hi <= 255:
                continue
            lo = 256
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


#: Ranges that one nested class of a Java class holds, and nested classes that one holds; code points below
#: JAVA_BITS are tested first, by one bit set.
JAVA_RANGES, JAVA_FAN, JAVA_BITS = 24, 4, 256


def _java_tree(ranges: list[tuple[int, int]]) -> str:
    """Members of a class: ranges, or nested classes that are entered only by code points between their ends."""
    if len(ranges) <= JAVA_RANGES:
        return ranges_to_class_body(ranges)
    size = max(JAVA_RANGES, -(-len(ranges) // JAVA_FAN))
    parts = [ranges[i : i + size] for i in range(0, len(ranges), size)]
    return "".join(f"[{ranges_to_class_body([(some[0][0], some[-1][1])])}&&[{_java_tree(some)}]]" for some in parts)


def java_class(ranges: list[tuple[int, int]]) -> str:
    """Full bracket expression of the ranges for Java, which joins a class's members to a chain that each character is
    passed down.  Here Latin-1 is a nested class of its own (one bit set) before the others, and those are entered only by
    code points beyond it: a tree of nested classes, so that the chain stays short for matches and for the rest.
    """
    low, high = _clip(ranges, 0, JAVA_BITS - 1), _clip(ranges, JAVA_BITS, _MAX_CP - 1)
    parts = [f"[{ranges_to_class_body(low)}]"] if low else []
    if len(high) == 1:
        parts.append(f"[{ranges_to_class_body(high)}]")
    elif high:
        parts.append(f"[{ranges_to_class_body([(high[0][0], high[-1][1])])}&&[{_java_tree(high)}]]")
    return f"[{''.join(parts)}]"


def _others(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code points outside of sorted ranges."""
    ends = [-1, *[b for _, b in ranges]]
    starts = [*[a for a, _ in ranges], _MAX_CP]
    return [(b + 1, a - 1) for b, a in zip(ends, starts, strict=True) if b + 1 <= a - 1]


def _without(lo: int, hi: int, cp: int) -> list[tuple[int, int]]:
    """The range without one code point."""
    return [(a, b) for a, b in ((lo, min(hi, cp - 1)), (max(lo, cp + 1), hi)) if a <= b]


def _clip(ranges: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    return [(max(a, lo), min(b, hi)) for a, b in ranges if b >= lo and a <= hi]


@functools.lru_cache(maxsize=1)
def _tables() -> dict[str, list[tuple[int, int]]]:
    ws: list[int] = []
    nonprint: list[int] = []
    printable: list[int] = []
    for cp in _code_points():
        ch = chr(cp)
        if ch.isspace():
            ws.append(cp)
            continue
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            nonprint.append(cp)
            continue
        if not ch.isprintable():
            nonprint.append(cp)
        else:
            printable.append(cp)
    tables = {"WS": _ranges(ws), "NONPRINT": _ranges(nonprint), "PRINTABLE": _ranges(printable)}
    for label, cps in _label_sets().items():
        tables[label] = _ranges(sorted(cps))
    return tables


def class_body(name: str) -> str:
    """Bracket-expression body for ``WS``, ``NONPRINT`` or a script label."""
    return ranges_to_class_body(_tables()[name])


@functools.lru_cache(maxsize=None)
def ws() -> str:
    """Body of the Python-whitespace class (``str.isspace``)."""
    return class_body("WS")


@functools.lru_cache(maxsize=None)
def nonprint_non_ws() -> str:
    """Body of the class of non-printable characters that are not whitespace."""
    return class_body("NONPRINT")


@functools.lru_cache(maxsize=None)
def script_class(label: str) -> str:
    """Full bracket expression matching one character of the given script label."""
    return f"[{class_body(label)}]"


# Convenience patterns ------------------------------------------------------


@functools.lru_cache(maxsize=None)
def whitespace_unit_pattern() -> str:
    """``\\S+`` with Python's notion of whitespace."""
    return f"[^{ws()}]+"


@functools.lru_cache(maxsize=None)
def character_unit_pattern() -> str:
    """One character that is neither whitespace nor non-printable.

    Written as a positive class in ascending code-point order: Java tests the ranges of a
    class left to right, so ASCII and Latin text match on the first ranges instead of being
    checked against every non-printable range.
    """
    printable = _tables()["PRINTABLE"]
    fast = ranges_to_class_body(_clip(printable, 0, FAST_LIMIT - 1))
    rest = ranges_to_class_body(_clip(printable, FAST_LIMIT, _MAX_CP - 1))
    return f"[{fast}]|[{rest}]"


@functools.lru_cache(maxsize=None)
def java_whitespace_unit_pattern() -> str:
    """:func:`whitespace_unit_pattern`, written for Java (:func:`java_class`)."""
    return java_class(_others(_tables()["WS"])) + "+"


@functools.lru_cache(maxsize=None)
def java_character_unit_pattern() -> str:
    """:func:`character_unit_pattern`, written for Java (:func:`java_class`)."""
    return java_class(_tables()["PRINTABLE"])


@functools.lru_cache(maxsize=None)
def java_no_unit_pattern(also: str = "") -> str:
    """A run of characters that are no character unit (or are in ``also``), written for Java."""
    points = {ord(c) for c in also}
    none = {cp for a, b in _others(_tables()["PRINTABLE"]) for cp in range(a, b + 1)} | points
    return java_class(_ranges(sorted(none - set(_SURROGATES)))) + "+"


@functools.lru_cache(maxsize=None)
def java_syllable_pattern(delimiter: str) -> str:
    """What lies between two delimiters from its first character that is no white space on, written for Java."""
    rest = [r for a, b in _others(_tables()["WS"]) for r in _without(a, b, ord(delimiter))]
    return f"{java_class(rest)}[^{delimiter}]*"


@functools.lru_cache(maxsize=None)
def starts_with_ws_pattern() -> str:
    return f"^[{ws()}]"


@functools.lru_cache(maxsize=None)
def inner_ws_pattern() -> str:
    """Whitespace with non-whitespace on both sides somewhere in the text."""
    return f"[^{ws()}][{ws()}]+[^{ws()}]"


@functools.lru_cache(maxsize=None)
def words_piece_pattern() -> str:
    """Pre-tokenizer of the ``words`` tokenizer: letters, digits, other symbols, whitespace runs."""
    w = ws()
    return (
        f" ?[\\p{{L}}\\p{{M}}]+| ?\\p{{N}}+| ?[^{w}\\p{{L}}\\p{{M}}\\p{{N}}]+|[{w}]+"
    )


def py_scripts(text: str) -> set[str]:
    """Labels of a text's characters, for tests and tiny driver-side checks."""
    points = {ord(c) for c in text or ""}
    return {label for label, cps in _label_sets().items() if points & cps}
