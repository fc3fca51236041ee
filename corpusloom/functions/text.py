"""Column expressions over text. All but :func:`nfkd`, which Spark has not, stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: what separates words, as Unicode sees white space (no-break and other spaces included).
BLANK = r"[\s\x1c-\x1f]"
#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed value: line ends, ``\r\n`` being one.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOKENS_PER_WORD = 1.3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(expression: Column) -> Column:
    """As the only row of a generator: what follows reads the value instead of working the expression out again."""
    return F.explode(F.array(expression))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(_col(c), F.lit(BLANKS))


def strip_end(c: Column | str) -> Column:
    """Without white space of any kind at the end."""
    return F.rtrim(_col(c), F.lit(BLANKS))


def collapse(c: Column | str) -> Column:
    """Stripped, and each run of white space one blank."""
    return F.regexp_replace(strip(c), rf"(?U){BLANK}+", " ")


def clean_key(c: Column | str) -> Column:
    """A key as keys are compared: stripped, in lower case, null if nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def approx_tokens(c: Column | str) -> Column:
    """1.3 tokens a word, rounded down, and at least 1; 0 for an empty text, null for a null one."""
    c = _col(c)
    return F.when(F.length(c) == 0, F.lit(0)).when(c.isNotNull(), F.greatest(F.lit(1), F.floor(word_count(c) * F.lit(TOKENS_PER_WORD)).cast("int")))


def lines(c: Column | str) -> Column:
    """The lines of a text; an end of line at its end opens no further one."""
    return let(F.split(_col(c), LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def clean_lines(c: Column | str) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def is_table_row(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) | x.contains("!!")


def slug(c: Column | str, most: int = 40) -> Column:
    """Lower case, other runs than letters and digits of ASCII a hyphen, cut to ``most`` characters."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def paragraphs(c: Column | str) -> Column:
    """The paragraphs of a text: what blank lines separate, stripped, none blank."""
    return F.filter(F.transform(F.split(strip(c), r"(?U)\n\s*\n+"), strip), lambda x: x != "")


def sentences(c: Column | str) -> Column:
    """The sentences of a text: a mark, white space, then a capital, a digit or ``[``."""
    return F.filter(F.transform(F.split(strip(c), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\[])"), strip), lambda x: x != "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")


def keyword_text(c: Column | str) -> Column:
    """Lower case, everything but letters and digits of ASCII a blank."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")


def greedy_starts(sizes: Column, limit: int) -> Column:
    """Where groups begin (0-based) if items are put together in order as long as their sizes sum to at most ``limit``."""
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"))

    def step(acc: Column, size: Column) -> Column:
        def grow(full: Column) -> Column:
            starts = F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
            used = F.when(full, size.cast("long")).otherwise(acc["used"] + size)
            return F.struct(starts.alias("starts"), used.alias("used"), (acc["at"] + 1).alias("at"))

        return let((acc["at"] > 0) & (acc["used"] + size > limit), grow)

    return F.aggregate(sizes, first, step, lambda acc: acc["starts"])


def join_groups(items: Column, starts: Column, separator: str) -> Column:
    """Each group of items that begins at one of ``starts``, joined. Both should be columns or bound by :func:`let`."""

    def group(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at(starts, k + 2), F.size(items))
        return F.array_join(F.slice(items, start + 1, end - start), separator)

    return F.when(F.size(items) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, group))


def pack(items: Column, limit: int, separator: str) -> Column:
    """Items joined in order as long as their approximate tokens sum to at most ``limit``."""
    return let(items, lambda bound: let(greedy_starts(F.transform(bound, approx_tokens), limit), lambda starts: join_groups(bound, starts, separator)))


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition, batch by batch; null stays null."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def sanitize(c: Column | str, most: int = 1000) -> Column:
    """Decomposed, ASCII only, runs of blanks one, at most one empty line in a row, cut to ``most`` characters, stripped."""
    plain = F.regexp_replace(nfkd(_col(c)), r"[^\x00-\x7f]+", "")
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"), 1, most))


def char_tokens(c: Column | str) -> Column:
    """A token for every four characters, rounded down."""
    return F.floor(F.length(_col(c)) / 4).cast("int")


def whole_number(c: Column | str) -> Column:
    """The number that a text is, blanks around it apart; null if it is none or has more than 18 digits."""
    return F.when(F.trim(_col(c)).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(_col(c)).cast("bigint"))
