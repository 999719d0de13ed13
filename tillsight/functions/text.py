"""Text cleaning: trimming, phones, codes, numbers, cities, message bodies."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at either end of a
# text field (ASCII blanks, line ends, no-break space, byte order mark and the
# Unicode space separators).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# The longest numeric prefix of a text.
NUMBER_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def strip(text: Column) -> Column:
    """Both-side trim of every white-space character, not only the blank."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def stripped(name: str) -> Column:
    """``strip`` of a column, the empty string for NULL.

    The trim looks outer characters up in the whole list and copies the text; most texts
    begin and end with a visible ASCII character and are passed on as they are.
    """
    column = F.col(name)
    visible = column.between("!", "~") & F.substring(column, -1, 1).between("!", "~")
    return or_empty(F.when(visible, column).otherwise(strip(column)))


def non_empty(text: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(text, F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    """The first value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[non_empty(text) for text in texts], F.lit(""))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_phone(raw: Column) -> Column:
    """Last ten digits of a phone, NULL when there are fewer than ten."""
    digits = F.regexp_replace(raw.cast("string"), "[^0-9]", "")
    return non_empty(F.regexp_extract(digits, "[0-9]{10}$", 0))


def clean_product_code(raw: Column) -> Column:
    """Style code without the size suffix (after '-') and prefix (before '/')."""
    base = F.substring_index(or_empty(raw), "-", 1)
    return strip(F.substring_index(base, "/", -1))


def category_suffix(code: Column) -> Column:
    """The last two characters, upper case, of a code without outer blanks."""
    return F.substring(F.upper(code), -2, 2)


def parse_number(text: Column) -> Column:
    """Longest numeric prefix as double; zero where there is none."""
    prefix = F.regexp_extract(strip(text.cast("string")), NUMBER_PREFIX, 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0))


MARKS = "[\\x{0300}-\\x{036f}]"
# The syllables of Hangul, which decompose by arithmetic (Unicode, section 3.12).
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEADING, VOWEL, TRAILING = 0x1100, 0x1161, 0x11A7
PER_LEADING, PER_VOWEL = 588, 28


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one base character plus accents, the bases, and the other ones with what they give.

    Both are made from the character database; syllables of Hangul are left to arithmetic.
    """
    accented, bases, longer = [], [], {}
    for point in range(0xC0, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or HANGUL_FIRST <= point <= HANGUL_LAST:
            continue
        char = chr(point)
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed == char:
            continue
        base = "".join(c for c in decomposed if not "\u0300" <= c <= "\u036f")
        if len(base) == 1:
            accented.append(char)
            bases.append(base)
        elif base:
            longer[char] = base
    return "".join(accented), "".join(bases), longer


def _char(point: Column) -> Column:
    """The character of a code point below 65,536."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _syllable(char: Column) -> Column:
    """The two or three letters of a syllable of Hangul."""
    place = F.ascii(char) - HANGUL_FIRST
    third = place % PER_VOWEL
    return F.concat(
        _char(F.floor(place / PER_LEADING) + LEADING),
        _char(F.floor(place % PER_LEADING / PER_VOWEL) + VOWEL),
        F.when(third > 0, _char(third + TRAILING)).otherwise(F.lit("")),
    )


def _spelled_out(plain: Column) -> Column:
    """Characters that decompose into several letters, one by one."""
    _, _, longer = _decompositions()
    known = F.create_map(*[F.lit(part) for pair in longer.items() for part in pair])

    def letters(char: Column) -> Column:
        hangul = char.between(F.lit(chr(HANGUL_FIRST)), F.lit(chr(HANGUL_LAST)))
        return F.when(hangul, _syllable(char)).otherwise(F.coalesce(F.try_element_at(known, char), char))

    return F.array_join(F.transform(F.split(plain, ""), letters), "")


def normalize_city(raw: Column) -> Column:
    """Upper-case city, canonically decomposed, without accents; NULL for NULL and for the empty string.

    Most names need a table of single characters only; the others (Hangul, letters that
    decompose into several) are spelled out character by character.
    """
    accented, bases, longer = _decompositions()
    plain = F.regexp_replace(F.translate(raw, accented, bases), MARKS, "")
    several = f"[{chr(HANGUL_FIRST)}-{chr(HANGUL_LAST)}{''.join(longer)}]"
    plain = F.when(F.rlike(raw, F.lit(several)), _spelled_out(plain)).otherwise(plain)
    return F.when(raw != "", strip(F.upper(plain)))


def clean_style(raw: Column) -> Column:
    """A requested style: upper case, only letters, digits, '-', '.', '/'."""
    return F.regexp_replace(F.upper(strip(raw)), "[^A-Z0-9\\-./]", "")


def matches_style(code: Column, style: Column) -> Column:
    """The style itself or one of its '-' variants."""
    return (code == style) | F.startswith(code, F.concat(style, F.lit("-")))


def slim_content(content: Column, content_type: Column) -> Column:
    """Message text as is; attachments reduced to a ``[image/..]`` or ``[attachment]`` stub."""
    body = or_empty(content)
    image = F.regexp_extract(body, "(?i)image/[a-z0-9]+", 0)
    is_attachment = F.contains(F.lower(or_empty(content_type)), F.lit("attachment"))
    return (
        F.when(body == "", F.lit(""))
        .when(~is_attachment, body)
        .when(image != "", F.concat(F.lit("["), image, F.lit("]")))
        .otherwise(F.lit("[attachment]"))
    )
