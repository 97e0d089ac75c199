"""String expressions. All are built-in and stay inside the JVM."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes, the word pattern, display widths.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}]+"
NON_WORD = r"[^\p{L}\p{N}]+"
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BAR_CELLS = 20
ERROR_TEXT_CHARS = 120


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def not_blank(c: Column) -> Column:
    return strip(c) != ""


def words(c: Column) -> Column:
    """Lower-cased words as an array, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def words_and_marks(c: Column) -> Column:
    """Like ``words``, with every other visible character as a token of its own."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_OR_MARK), F.lit(0))


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def bar(pct: Column) -> Column:
    """20-cell bar, one full cell per whole 5 percent."""
    full = F.floor(pct / 5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(BAR_CELLS) - full))


def class_line(name: Column, pct: Column) -> Column:
    return F.format_string("%-15s %s %6.2f%%", name, bar(pct), pct)


def cut(c: Column, chars: int = ERROR_TEXT_CHARS) -> Column:
    """Display form of a long text; ``c`` itself is left whole."""
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """(from, to, several): by rule over all code points, the characters that lose marks by decomposition.

    ``translate`` takes one character to one, and those of ``from`` beyond the end of ``to`` (the
    marks themselves) to none; ``several`` are the few that leave two or more characters.
    """
    one, gone, several = [], [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if "\uac00" <= c <= "\ud7a3" or "\ud800" <= c <= "\udfff":
            continue  # Korean syllables are taken apart by arithmetic below
        left = "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")
        if left == c:
            continue
        if len(left) == 1:
            one.append((c, left))
        elif left:
            several[c] = left
        else:
            gone.append(c)
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one), several


def _letters_of_syllables(c: Column) -> Column:
    """Korean syllables as their letters: 19 x 21 x 28 of them, in order from U+AC00."""
    first, middle, last = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def letters(ch: Column) -> Column:
        n = F.ascii(ch) - 0xAC00
        parts = [(first, F.floor(n / 588)), (middle, F.floor(n % 588 / 28)), (last, n % 28 - 1)]
        taken = [F.when(i >= 0, F.substring(F.lit(s), (i + 1).cast("int"), F.lit(1))).otherwise("") for s, i in parts]
        return F.when((n >= 0) & (n < 11172), F.concat(*taken)).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), letters), "")


def fold_marks(c: Column) -> Column:
    """Canonical decomposition without its non-spacing marks: ``é`` becomes ``e``.

    Characters fold one by one, so only the pieces between blanks that are not ASCII have to.
    """
    folded = F.transform(F.split(c, " "), lambda w: F.when(w.rlike(r"[^\x00-\x7F]"), _fold(w)).otherwise(w))
    return F.array_join(folded, " ")


def _fold(c: Column) -> Column:
    source, target, several = _folding()
    wide = c
    for a, b in several.items():
        wide = F.replace(wide, F.lit(a), F.lit(b))
    out = F.translate(F.when(c.rlike(f"[{''.join(several)}]"), wide).otherwise(c), source, target)
    return F.when(c.rlike("[\uac00-\ud7a3]"), _letters_of_syllables(out)).otherwise(out)
