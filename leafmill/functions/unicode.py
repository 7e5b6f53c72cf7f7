"""Unicode functions that Spark lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEGACY_SOURCES, LEGACY_TARGETS, legacy_gate


def _by_text(function) -> Callable[[Column], Column]:
    def column(value: Column) -> Column:
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda x: None if x is None else function(x))

        return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(value)

    return column


def compose(value: Column) -> Column:
    """Canonical composition (NFC)."""
    return _by_text(lambda x: unicodedata.normalize("NFC", x))(value)


def full_casefold(value: Column) -> Column:
    """Full case folding."""
    return _by_text(str.casefold)(value)


_WORD = "[A-Za-z¡-ÿ−]+"
_TABLE = str.maketrans(LEGACY_SOURCES, LEGACY_TARGETS)


def _loud(pieces: pd.Series, least: int) -> pd.Series:
    """Which pieces have so many ASCII letters at least, all of them capitals."""
    found = pieces.str.replace("[^A-Za-z]", "", regex=True)
    return (found.str.len() >= least) & ~found.str.contains("[a-z]", regex=True)


def _decoded(texts: pd.Series) -> pd.Series:
    """Texts decoded from the legacy encoding, by way of one table of their lines and one of the lines' words."""
    lines = texts.map(lambda x: x.splitlines(keepends=True)).explode().rename("line").rename_axis("text").reset_index()
    lines["loud"] = _loud(lines["line"].str.replace("<[^>]+>", "", regex=True), 4)
    words = lines.assign(word=lines["line"].str.findall(f"{_WORD}|[^A-Za-z¡-ÿ−]+")).explode("word")
    is_word = words["word"].str.fullmatch(_WORD)
    plain = words["word"].str.translate(_TABLE).where(is_word, words["word"])
    words["plain"] = plain.where(~(is_word & (words["loud"] | _loud(words["word"], 2))), plain.str.upper())
    return words.groupby("text", sort=False)["plain"].agg("".join).map(lambda x: unicodedata.normalize("NFC", x))


def legacy_text(value: Column) -> Column:
    """Struct of ``text``, decoded from the legacy Vietnamese encoding if it has enough markers, and ``changed``, how
    many of its characters the encoding maps; null for null.

    Words go to capitals if their own ASCII letters, two at least, or those of their line outside of tags, four at
    least, are all capitals.
    """

    def run(values: pd.Series, wanted: pd.Series) -> pd.Series:
        some = values[wanted.fillna(False).astype(bool)].reset_index(drop=True)
        out = values.copy()
        if len(some):
            out[wanted.fillna(False).astype(bool)] = _decoded(some).reindex(range(len(some))).to_numpy()
        return out

    gate = legacy_gate(value)["is_legacy"]
    mapped = F.length(value) - F.length(F.translate(value, LEGACY_SOURCES, ""))
    text = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(value, gate)
    return F.struct(text.alias("text"), F.when(gate, mapped).otherwise(0).cast("long").alias("changed"))


def restore_case(text: str, capitals: list[str]) -> tuple[str, int]:
    """Put phrases that a capitals font shows in lower case back to capitals, the longest phrase at a place first."""
    import re

    wanted = {x.strip() for x in capitals} - {""}
    phrases = sorted((x for x in wanted if x != x.upper()), key=lambda x: (-len(x), x))
    if not phrases:
        return text, 0
    return re.subn("|".join(map(re.escape, phrases)), lambda found: found[0].upper(), text, flags=re.IGNORECASE)
