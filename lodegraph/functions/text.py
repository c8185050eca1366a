"""Tokens, sets and their likeness as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delimiters, then the borders inside camel case and around digits.
DELIMITERS = r"[._\- /:()]+"
# a look at the next character comes first, as few are upper-case letters or digits
BORDERS = r"(?=[\p{Lu}\p{Nd}])(?:(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll}))|(?<=\p{Nd})(?=\p{L})"
#: White space of any script.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column | str) -> Column:
    """Without white space, tabs too, at either end."""
    return F.btrim(c, F.lit(WHITE))


def tokens(c: Column) -> Column:
    """Lower-case tokens in order."""
    return F.transform(F.filter(F.split(c, f"{DELIMITERS}|{BORDERS}"), lambda t: t != ""), F.lower)


def distinct_tokens(tokens_: Column) -> Column:
    """The set of `tokens`: distinct ones of more than one byte."""
    return F.array_distinct(F.filter(tokens_, lambda t: F.octet_length(t) > 1))


def token_set(c: Column) -> Column:
    """Distinct tokens of more than one byte."""
    return distinct_tokens(tokens(c))


def trigrams(c: Column) -> Column:
    """Distinct lower-case trigrams of code points without blanks."""
    low = F.lower(c)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))), lambda t: ~t.rlike("[ \\t\\n]")))


def normalized_ref(c: Column) -> Column:
    """Trimmed, without one trailing pair of parentheses."""
    return F.regexp_replace(stripped(c), r"\(\)\z", "")


def looks_like_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9._]*\z")


def common_non_identifier(c: Column) -> Column:
    return c.rlike("^[-/~]| ")


def exported(name: Column) -> Column:
    """Whether the first byte, read as a code point, is an upper-case letter; of bytes from 0x80, 0xC0 to 0xDE but 0xD7 are."""
    byte = F.ascii(F.decode(F.substring(F.encode(name, "UTF-8"), 1, 1), "ISO-8859-1"))
    return byte.between(65, 90) | (byte.between(0xC0, 0xDE) & (byte != 0xD7))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    """From sizes; 0 for empty sets."""
    return F.when(a + b > common, common / (a + b - common)).otherwise(F.when(common > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def dice(common: Column, a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 2.0 * common / (a + b)).otherwise(F.lit(0.0))
