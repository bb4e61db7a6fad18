"""Scales, rounding, comparisons and label cleaning, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of two ERB scales; a human's, of Hz, and a ferret's, whose bandwidth is a power of kHz.
HUMAN_Q, HUMAN_MIN = 9.265, 24.7
FERRET_SLOPE, FERRET_POWER = 0.31, 0.533


def hz_to_erb(f: Column) -> Column:
    return F.lit(HUMAN_Q) * F.log(F.lit(1.0) + f / F.lit(HUMAN_MIN * HUMAN_Q))


def erb_to_hz(e: Column) -> Column:
    return F.lit(HUMAN_MIN * HUMAN_Q) * (F.exp(e / F.lit(HUMAN_Q)) - F.lit(1.0))


def erb(f: float) -> float:
    return HUMAN_Q * math.log(1 + f / (HUMAN_MIN * HUMAN_Q))


def hz_of_erb(e: float) -> float:
    return HUMAN_MIN * HUMAN_Q * (math.exp(e / HUMAN_Q) - 1)


def hz_to_erb_ferret(f: Column) -> Column:
    """The integral of one over the bandwidth."""
    return F.pow(f / F.lit(1000.0), F.lit(1 - FERRET_POWER)) / F.lit(FERRET_SLOPE * (1 - FERRET_POWER))


def erb_to_hz_ferret(e: Column) -> Column:
    return F.pow(e * F.lit(FERRET_SLOPE * (1 - FERRET_POWER)), F.lit(1 / (1 - FERRET_POWER))) * F.lit(1000.0)


def is_close(a: Column, b: Column, *, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clean_label(label: Column) -> Column:
    """Upper case without digits, as stress marks are."""
    return F.regexp_replace(F.upper(label), r"\d+", "")


#: Contractions that the endings don't explain, in lower case.
CONTRACTIONS = {"ain't": "is not", "can't": "cannot", "won't": "will not", "shan't": "shall not", "sha'n't": "shall not", "let's": "let us", "so's": "so as", "'cause": "because", "o'clock": "of the clock", "ma'am": "madam", "y'all": "you all", "how'd'y": "how do you", "how'd": "how did", "where'd": "where did"}
#: Endings and the words they stand for, and words after which 's is a verb; after others it marks an owner.
ENDINGS = {"'ve": "have", "'d": "would", "'ll": "will", "'re": "are", "'m": "am", "n't": "not"}
VERBAL = ("he", "she", "it", "that", "there", "what", "when", "where", "who", "why", "how")


def expanded(label: Column) -> Column:
    """Lower-cased words with contractions written out: those that have words of their own, wherever a word begins with one, then endings, then 's."""
    out = F.translate(F.lower(label), "\u2019", "'")
    for contraction in sorted(CONTRACTIONS, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?<![\w']){contraction}(?![\w])", CONTRACTIONS[contraction])
    for ending, meaning in ENDINGS.items():
        out = F.regexp_replace(out, rf"(?<=\w){ending}(?!\w)", f" {meaning}")
    out = F.regexp_replace(out, rf"\b({'|'.join(VERBAL)})'s(?!\w)", "$1 is")
    return F.regexp_replace(out, r"(?<=\w)'s(?!\w)", "")


def base_name(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def escaped(text: Column) -> Column:
    """Underscores, carets, braces and backslashes after a backslash."""
    return F.regexp_replace(text, r"([_^{}\\])", r"\\$1")


def identity(*parts: Column) -> Column:
    """A name for a set of parameters, joined in order by underscores."""
    return F.concat_ws("_", *parts)


def compressed(x: Column, power: float = 0.3) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(power))


def log_compressed(x: Column, constant: float = 1e-12) -> Column:
    return F.log10(x + F.lit(constant))


def decibels(ratio: Column) -> Column:
    """10 log10 of a power ratio; null where it is zero or null."""
    return F.when(ratio > 0, F.lit(10.0) * F.log10(ratio))


def frequency_bin(k: Column, n: int | Column, sr: float) -> Column:
    """The frequency of bin k of a transform of n points; the Nyquist frequency is positive."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(k <= F.floor(n / 2), k).otherwise(k - n) * F.lit(float(sr)) / n


def shifted_bin(k: Column, n: int | Column) -> Column:
    """Where bin k stands when frequencies ascend and the Nyquist frequency comes last."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(k + F.floor((n - 1) / 2), n)


def log_frequency(k: Column, low: float, per_octave: float) -> Column:
    """The frequency of place k on an axis of so many places an octave from ``low``."""
    return F.pow(F.lit(2.0), F.log2(F.lit(float(low))) + k / F.lit(float(per_octave)))


def gammatone(t: Column, rate: Column) -> Column:
    """The impulse response of a gammatone of a rate."""
    turn = t * rate
    return turn * turn * F.exp(-3.5 * turn) * F.sin(2 * math.pi * turn)


def mexican_hat(f: Column, scale: float) -> Column:
    """The transfer function of a Mexican hat, one at its scale."""
    g = F.pow(f / F.lit(float(scale)), F.lit(2.0))
    return g * F.exp(1 - g)
