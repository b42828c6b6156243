"""Team names: normal form and similarity.

The normal form drops accents, lowers, drops stop tokens, expands short forms
and joins what is left; all of it is Catalyst expressions. Only the similarity
ratio has no expression and runs in a pandas UDF, over the few names that every
cheaper tier left open.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from touchline.functions.blocks import ratios

# Tokens that say nothing about a club, and short forms.
STOP_TOKENS = (
    "fc", "cf", "afc", "cfc", "sc", "ac", "as", "ss", "ssc", "sv", "vfb", "vfl", "tsg",
    "fk", "sk", "bk", "nk", "kv", "krc", "club", "calcio", "cd", "ud", "sad", "the",
    "if", "ik", "ff",
)
EXPANSIONS = {"man": "manchester", "utd": "united", "st": "saint", "nottm": "nottingham"}
LETTERS = {"ø": "o", "æ": "ae", "ß": "ss", "ł": "l", "'": ""}

CUTOFF = 0.88


def _accents() -> tuple[str, str]:
    """Latin letters of one base letter and marks, and their base letters."""
    whole, base = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = [c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(point):
            whole.append(chr(point))
            base.append(parts[0])
    return "".join(whole), "".join(base)


ACCENTED, PLAIN = _accents()


def strip_accents(name: Column) -> Column:
    """Marks that stand alone go, accented letters become plain ones."""
    return F.translate(F.regexp_replace(name, r"[̀-ͯ]", ""), ACCENTED, PLAIN)


def normalise(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    text = F.lower(strip_accents(name))
    for letter, spelled in LETTERS.items():
        text = F.regexp_replace(text, letter, spelled)
    kept = F.filter(F.split(text, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*STOP_TOKENS))
    short = F.create_map(*[F.lit(x) for kv in EXPANSIONS.items() for x in kv])
    return F.array_join(F.transform(kept, lambda t: F.coalesce(F.try_element_at(short, t), t)), "")


def prefix_match(a: Column, b: Column) -> Column:
    """One is the other's beginning; the shorter has three characters at least."""
    return (F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a))


def substring_match(a: Column, b: Column) -> Column:
    """One is inside the other; the shorter has five characters at least."""
    return (F.least(F.length(a), F.length(b)) >= 5) & (a.contains(b) | b.contains(a))


def similarity_from(least: float):
    """Similarity of two columns; NULL where a side is NULL or it is under ``least``."""

    @F.pandas_udf(T.DoubleType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = ratios(a[known].tolist(), b[known].tolist(), least)
        out[out < least] = np.nan
        return pd.Series(pd.array(out, dtype="Float64")).mask(np.isnan(out))

    return similar


#: Twice the matched characters over all characters (longest common blocks).
similarity = similarity_from(0.0)
