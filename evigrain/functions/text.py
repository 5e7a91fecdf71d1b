"""Text functions as Column expressions; Python only for Unicode folding of rows that need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The token pattern, and the spellings that units share.
TOKEN = r"[a-z0-9]+(?:[._+/-][a-z0-9]+)*|[㐀-鿿]+"
LATIN_TOKEN = r"[a-z0-9]+(?:[._+/-][a-z0-9]+)*"
UNIT_SPELLINGS = [
    ("μ", "u"),
    ("µ", "u"),
    ("−", "-"),
    ("–", "-"),
    ("ₐᵢᵣ", "air"),
    ("⁻¹", "^-1"),
    ("⁻²", "^-2"),
    ("⁻³", "^-3"),
    ("²", "^2"),
    ("³", "^3"),
    ("ω", "ohm"),
    ("Ω", "ohm"),
    ("·", ""),
    ("⋅", ""),
    ("_", ""),
]


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


#: Texts that folding only lower-cases: ASCII and the Latin-1 letters but the sharp s.
PLAIN = r"^[\x00-\x7F\u00C0-\u00D6\u00D8-\u00DE\u00E0-\u00F6\u00F8-\u00FF]*$"


def fold(c: Column) -> Column:
    """NFKC and case folding. Plain rows are lower-cased by the JVM; Python sees the others only, as nulls stand for them."""
    plain = c.rlike(PLAIN)
    return F.coalesce(F.when(plain, F.lower(c)), _fold(F.when(~plain, c)))


def tokens(c: Column) -> Column:
    """Terms of a folded text: Latin runs with inner . _ + / -; runs of Chinese characters as single ones, then as pairs."""
    c = fold(c)
    found = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))

    def split(t: Column) -> Column:
        single = F.split(t, "")
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        wide = F.when(F.length(t) > 1, F.concat(single, pairs)).otherwise(single)
        return F.when(t.rlike(r"^[㐀-鿿]"), wide).otherwise(F.array(t))

    plain = ~c.rlike(r"[㐀-鿿]")
    return F.when(plain, found).otherwise(F.flatten(F.transform(found, split)))


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(LATIN_TOKEN), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unit_key(c: Column) -> Column:
    """A unit's spelling without typographic variants."""
    out = F.lower(F.trim(c))
    for a, b in UNIT_SPELLINGS:
        out = F.replace(out, F.lit(a.lower()), F.lit(b))
    out = F.regexp_replace(out, r"\^\{([+-]?\d+)\}", r"^$1")
    return F.regexp_replace(out, r"[{}\s]+", "")


def claim_key(c: Column) -> Column:
    """What makes two claims the same: letters and digits only, folded."""
    return F.regexp_replace(fold(c), r"[^0-9a-z一-鿿]+", "")


def plain_key(c: Column) -> Column:
    """claim_key() of a text that is lower-cased only: letters such as the sharp s aren't taken for others, but dropped."""
    return F.regexp_replace(F.lower(c), r"[^0-9a-z一-鿿]+", "")


def sentences(c: Column) -> Column:
    """Sentences by Chinese stops and semicolons, squeezed, without empty ones."""
    return F.filter(F.transform(F.split(c, "(?<=[。！？；;])"), squeeze), lambda s: s != "")


def compact(c: Column, limit: int) -> Column:
    """An excerpt: a longer text is cut behind the last sentence end if that is behind 55 % of the limit, else at the limit."""
    text = squeeze(c)
    head = F.substring(text, 1, limit)
    last = lambda m: F.when(F.contains(head, F.lit(m)), F.length(head) - F.locate(m, F.reverse(head)) + 1).otherwise(0)
    stop = F.greatest(*[last(m) for m in "。！？;."])
    cut = F.when(stop - 1 >= int(limit * 0.55), F.substring(head, F.lit(1), stop)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(cut), F.lit("……")))


def bad_citations(answer: Column, sources: Column) -> Column:
    """The [n] of an answer that are not 1 to the number of sources, once each, ascending."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.isNull() | (n < 1) | (n > sources))))


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))


def json_object(c: Column) -> Column:
    """A text that is a JSON object, with or without a code fence round all of it, without the fence; null for any other."""
    text = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    inner = F.regexp_extract(text, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    found = F.when(inner != "", inner).otherwise(text)
    return F.when(found.startswith("{") & F.get_json_object(found, "$").isNotNull(), found)
