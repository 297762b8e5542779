"""Text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.fixed_values import CATALOG_IDS, CHARS_PER_UNIT, DEFAULT_CATALOG_ID

# What counts as white space: one list for trimming, one pattern for collapsing.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
_BLANK_RUN = r"[\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]++"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_text(text) -> Column:
    """NFC with every line end as a line feed.

    Text made only of characters below U+0300 is in NFC already, so just the other rows leave
    the JVM.
    """
    text = _col(text)
    beyond = text.rlike(r"[^\x{0}-\x{2FF}]")
    composed = F.coalesce(_nfc(F.when(beyond, text)), text)
    return F.regexp_replace(composed, r"\r\n?", "\n")


def content_hash(text) -> Column:
    return F.sha2(normalize_text(text), 256)


def character_count(text) -> Column:
    return F.char_length(normalize_text(text)).cast("long")


def work_units(chars) -> Column:
    return _col(chars) / F.lit(float(CHARS_PER_UNIT))


def strip(text) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.trim(_col(text), F.lit(_BLANKS))


def one_line(text, limit: int | None = None) -> Column:
    """White space collapsed to single blanks, cut to ``limit`` characters with an ellipsis if there is one."""
    line = F.trim(F.regexp_replace(_col(text), _BLANK_RUN, " "))
    if limit is None:
        return line
    return F.when(F.char_length(line) <= limit, line).otherwise(
        F.concat(F.substring(line, 1, limit - 3), F.lit("..."))
    )


def slug(name) -> Column:
    """Lower-case letters and digits with single hyphens between, ``model`` if nothing is left."""
    dashed = F.regexp_replace(F.lower(_col(name)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.trim(dashed, F.lit("-")), F.lit("")), F.lit("model"))


def format_elapsed(seconds) -> Column:
    """``1h02m03s``, ``2m03s`` or ``3s``."""
    whole = F.greatest(F.lit(0), _col(seconds).cast("long"))
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return (
        F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s))
        .when(m > 0, F.format_string("%dm%02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def catalog_id(name, catalog: dict[str, str] = CATALOG_IDS) -> Column:
    """Catalogue id of a harness; a short fixed list, so a literal map and no join."""
    pairs = F.create_map(*[F.lit(x) for pair in catalog.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, _col(name)), F.lit(DEFAULT_CATALOG_ID))


def path_tail(path) -> Column:
    """Last component of a path."""
    return F.regexp_extract(_col(path), r"([^/]+)/*$", 1)


def file_stem(path) -> Column:
    """Last component without its final suffix."""
    return F.regexp_replace(path_tail(path), r"(?<=.)\.[^.]*$", "")


def task_tag(folder, ident=None) -> Column:
    """The task's id text, its folder name if that text is blank, or the name after the first hyphen if there is none."""
    name = path_tail(folder)
    tail = F.regexp_replace(name, r"^[^-]*-", "")
    return tail if ident is None else F.coalesce(F.coalesce(F.nullif(strip(ident), F.lit("")), F.when(_col(ident).isNotNull(), name)), tail)
