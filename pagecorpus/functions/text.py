"""Text functions: Unicode trimming, clean-up, graphemes, natural sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space code points (tab..CR, NEL and every Z* character).
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: what the regex escape for white space matches in ICU.
ICU_SPACE = r"[\t\n\f\r\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim Unicode white space, the ideographic space included, from both ends."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def compact(c: Column | str) -> Column:
    """Remove all white space."""
    return F.regexp_replace(_col(c), ICU_SPACE + "+", "")


def clean_breaks(c: Column | str) -> Column:
    """Drop one space on either side of each line break (one pass each), then trim."""
    before = F.replace(_col(c), F.lit(" \n"), F.lit("\n"))
    after = F.replace(before, F.lit("\n "), F.lit("\n"))
    return utrim(after)


def renderable(c: Column | str) -> Column:
    """One-line form: white-space runs become one space, none before closing punctuation."""
    one_line = F.regexp_replace(_col(c), ICU_SPACE + "+", " ")
    return utrim(F.regexp_replace(one_line, " ([,.!?…])", "$1"))


def graphemes(c: Column | str) -> Column:
    """User-perceived characters that are not white space, in order."""
    pieces = F.regexp_extract_all(_col(c), F.lit(r"(\X)"), F.lit(1))
    return F.filter(pieces, lambda g: ~F.contains(F.lit(WHITE_SPACE), F.left(g, F.lit(1))))


def char_count(c: Column | str) -> Column:
    """Number of user-perceived characters that are not white space."""
    return F.size(graphemes(c))


def display_text(translated: Column | str, original: Column | str, trim_original: bool = True) -> Column:
    """Trimmed translation if it says anything, else the original.

    ``trim_original=False`` is the on-screen variant, which shows the original as it is.
    """
    shown = utrim(original) if trim_original else _col(original)
    return F.coalesce(F.nullif(utrim(translated), F.lit("")), shown)


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(utrim(c) == "", F.lit(True))


def contains_script(c: Column | str, first: str = "가", last: str = "힣") -> Column:
    """Any code point in ``first``..``last``; the default range is Hangul syllables."""
    return F.coalesce(F.rlike(_col(c), F.lit(f"[{first}-{last}]")), F.lit(False))


def natural_key(c: Column | str) -> Column:
    """Sortable string: digit runs compare as numbers of any length, text ignores case.

    A number becomes ``0`` + its six-digit length + its digits, other text becomes
    ``1`` + the text; U+0000 ends each token, so string order equals token-wise order.
    """
    tokens = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+(?=[0-9])", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(F.rlike(token, F.lit("^[0-9]")), number).otherwise(F.concat(F.lit("1"), token))

    return F.array_join(F.transform(tokens, encode), "\u0000")
