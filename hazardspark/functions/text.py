"""Text for matching names, and the register's code page."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH = bytes(range(0x80, 0x100))


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Signs whose compatible decomposition without combining marks is another sign or none, and those for which it is several."""
    one, several = {}, {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000))):  # Korean syllables go by rule
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c:
            (one if len(plain) < 2 else several)[c] = plain
    return one, several


def _class(signs: list[int]) -> str:
    """A regular expression of code points, as ranges."""
    parts, start = [], None
    for i, c in enumerate(signs):
        start = c if start is None else start
        if i + 1 == len(signs) or signs[i + 1] != c + 1:
            parts.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return f"[{''.join(parts)}]"


_ONE, _SEVERAL = _decomposed()
_DELETED = "".join(c for c, p in _ONE.items() if not p)
_MARKED = "".join(c for c, p in _ONE.items() if p) + _DELETED  # what has no counterpart at the end is deleted
_PLAIN = "".join(p for p in _ONE.values() if p)
#: Korean syllables: first of all, lead, vowel and tail signs, and how many of each there are.
_SYLLABLE, _LEAD, _VOWEL, _TAIL = 0xAC00, [chr(0x1100 + i) for i in range(19)], [chr(0x1161 + i) for i in range(21)], ["", *(chr(0x11A8 + i) for i in range(27))]
_SYLLABLES = (_SYLLABLE, _SYLLABLE + 19 * 21 * 28 - 1)
_MAYBE_RARE = _class([c for c in range(0x80, 0x10000) if c >= 0x250 or chr(c) in _SEVERAL])  # a class of few ranges, which Latin texts do not meet
_RARE = _class(sorted([*map(ord, _SEVERAL), *range(_SYLLABLES[0], _SYLLABLES[1] + 1)]))
#: What a sign of several letters stands for, by its place; signs up to _LOW, then those from _HIGH_FROM on.
_LOW, _HIGH_FROM = 0x3400, 0xF900
_WORDS = "\n".join(_SEVERAL.get(chr(c), "") for c in (*range(_LOW), *range(_HIGH_FROM, 0x10000)))


def _written_out(c: Column) -> Column:
    """Signs of several letters written out, sign by sign, each found by its place in a table."""
    words = F.split(F.lit(_WORDS), "\n", -1)

    def out(sign: Column) -> Column:
        at = F.ascii(sign)
        place = F.when(at < _LOW, at + 1).when(at.between(_HIGH_FROM, 0xFFFF), at - _HIGH_FROM + _LOW + 1)
        k = at - _SYLLABLE
        part = lambda signs, i: F.element_at(F.lit(signs), (i + 1).cast("int"))
        syllable = F.concat(part(_LEAD, F.floor(k / 588)), part(_VOWEL, F.floor(F.pmod(k, F.lit(588)) / 28)), part(_TAIL, F.pmod(k, F.lit(28))))
        return F.when(at.between(*_SYLLABLES), syllable).otherwise(F.coalesce(F.nullif(F.element_at(words, place), F.lit("")), sign))

    return F.array_join(F.transform(F.split(c, ""), out), "")


def strip_accents(c: Column) -> Column:
    """The compatible decomposition of every sign below U+10000, without combining marks: º as o, № as No, ½ as 1⁄2.

    Plain ASCII is left alone after one look; signs of one letter, and marks, are one
    translation; only texts with signs of several letters are taken apart.
    """
    foreign = F.when(c.rlike(_MAYBE_RARE) & c.rlike(_RARE), _written_out(c)).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(foreign, _MARKED, _PLAIN)).otherwise(c)


def normalise(c: Column) -> Column:
    """Without accents, other signs as blanks, lower case, single blanks."""
    spaced = F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", " ")
    return F.trim(spaced)


def title_case(c: Column) -> Column:
    """Capitals after blanks and hyphens, all else in lower case."""
    return F.array_join(F.transform(F.split(F.lower(F.trim(c)), "-"), F.initcap), "-")


def from_cp850(c: Column) -> Column:
    """Text of code page 850 that was read as Latin-1."""
    return F.translate(c, _HIGH.decode("latin-1"), _HIGH.decode("cp850"))


def to_cp850(c: Column) -> Column:
    """Text whose Latin-1 bytes are those of code page 850."""
    return F.translate(c, _HIGH.decode("cp850"), _HIGH.decode("latin-1"))


def from_cp1252(c: Column) -> Column:
    """Text of code page 1252 that was read as Latin-1; left as it is where it has bytes that the page lacks."""
    known = [bytes([b]) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    lacking = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]) not in known)
    foreign = F.when(c.rlike(f"[{lacking}]"), c).otherwise(F.translate(c, b"".join(known).decode("latin-1"), b"".join(known).decode("cp1252")))
    return F.when(c.rlike(r"[\x80-\x9F]"), foreign).otherwise(c)  # most texts have no such sign
