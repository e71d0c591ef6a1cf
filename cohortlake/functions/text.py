"""Text rules used while cleaning delivered files."""

from pyspark.sql import Column, functions as F

# fixed values: characters that count as white space at the ends of a value
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(c: Column) -> Column:
    """Strip all white space at the ends, tabs and no-break spaces too."""
    return F.btrim(c, F.lit(SPACES))


def trimmed(c: Column) -> Column:
    """Stripped text; empty text becomes null."""
    return F.nullif(stripped(c), F.lit(""))


def proper_case(c: Column) -> Column:
    """Capitalise the first letter, but only of a value written wholly in lower case."""
    lower_only = (c == F.lower(c)) & (c != F.upper(c))
    capital = F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))
    return F.when(lower_only, capital).otherwise(c)


def canonical(c: Column, vocabulary) -> Column:
    """The vocabulary's spelling of a value, ignoring case; null when the value is unknown."""
    pairs = [F.lit(x) for word in vocabulary for x in (word.lower(), word)]
    return F.try_element_at(F.create_map(*pairs), F.lower(c))


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def number(c: Column) -> Column:
    """'8 000 000' -> 8000000.0; null when the text is not a number. Up to 15 digits alone are read as a whole number, which is
    exact as a double and costs less."""
    plain = compact(c)
    return F.when(c.rlike("^[0-9]{1,15}$"), c.try_cast("long").cast("double")).when(plain.rlike(NUMBER), plain.try_cast("double"))


def without_fraction(n: Column) -> Column:
    return F.when(n % 1 == 0, n)


def whole(c: Column) -> Column:
    """The number if it has no fraction; null else."""
    return without_fraction(number(c))


def iso_date(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("-")), F.try_to_date(c, "yyyy-M-d"))


def local_date(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.try_to_date(c, "d.M.yyyy"))


def contains(c: Column, text) -> Column:
    """Literal, case-insensitive substring test."""
    text = text if isinstance(text, Column) else F.lit(text)
    return F.contains(F.lower(c), F.lower(F.trim(text)))
