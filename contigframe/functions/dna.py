"""Expressions on DNA strings.

Sequences are ASCII, so a position is a byte offset and ``piece`` slices the binary form, where
slicing a string would walk it from the first character. Each call still copies its input once:
long sequences are first cut into blocks (``operators.windows.blocks``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import IUPAC_FROM, IUPAC_TO

BASES = "ACGT"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times in ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def derive_sequence(text: Column | str) -> Column:
    """Map any text to the alphabet ACGTN: letters a..z in turn to A C G T, the rest to N."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    bases = "".join(BASES[i % 4] for i in range(len(letters)))
    return F.regexp_replace(F.translate(F.lower(_col(text)), letters, bases), "[^ACGT]", "N")


def piece(seq: Column | str, start: Column | int, length: Column | int) -> Column:
    """``length`` bases from 0-based ``start``; shorter at the end of the sequence."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    data = _col(seq).cast("binary")
    return F.substring(data, (start + 1).cast("int"), length.cast("int")).cast("string")


def is_valid_dna(seq: Column | str) -> Column:
    return _col(seq).rlike("^[ATGCNatgcn]+$")


def invalid_letters(seq: Column | str) -> Column:
    """Sorted distinct letters outside the alphabet."""
    rest = F.regexp_replace(_col(seq), "[ATGCNatgcn]", "")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.split(rest, "")))
    )


def complement(seq: Column | str) -> Column:
    known = F.regexp_replace(_col(seq), "[^ACGTacgtRYKMBVDHWSN\\-]", "N")
    return F.translate(known, IUPAC_FROM, IUPAC_TO)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def complement_strict(seq: Column | str) -> Column:
    """Complement of A C G T in either case, case kept; any other letter becomes N."""
    return F.translate(F.regexp_replace(_col(seq), "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca")


def count_of(seq: Column | str, letter: str) -> Column:
    seq = _col(seq)
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def base_counts(seq: Column | str) -> dict[str, Column]:
    """Upper-case counts only, so soft-masked bases are left out."""
    return {name: count_of(seq, name.upper()) for name in ("g", "c", "a", "t")}


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def gc_content(seq: Column | str) -> Column:
    seq = _col(seq)
    return share(count_of(seq, "G") + count_of(seq, "C"), F.length(seq))


def n_fraction(seq: Column | str) -> Column:
    seq = _col(seq)
    return share(count_of(seq, "N"), F.length(seq))


def gc_skew(seq: Column | str) -> Column:
    g, c = count_of(seq, "G"), count_of(seq, "C")
    return share(g - c, g + c)


def rounded_skew(g: Column, c: Column) -> Column:
    """Skew of a window, kept at two decimals (half to even)."""
    return F.bround(share(g - c, g + c), 2)


def shannon_entropy(seq: Column | str, letters: str = "ACGTN") -> Column:
    """Entropy in bits over the letters present; letters outside ``letters`` must not occur."""
    seq = _col(seq)
    total = F.lit(0.0)
    for letter in letters:
        p = share(count_of(seq, letter), F.length(seq))
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.abs(total)


def escape_id(name: Column | str) -> Column:
    return F.replace(_col(name), F.lit(","), F.lit("___"))


def unescape_id(name: Column | str) -> Column:
    return F.replace(_col(name), F.lit("___"), F.lit(","))


def strip_class_suffix(name: Column | str) -> tuple[Column, Column]:
    """``id__class=x`` as ``(id, x)``; the class is null without a suffix."""
    parts = F.split(_col(name), "__class=", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def nucleotide_length(codons: Column) -> Column:
    """Bases needed so that all six frames hold ``codons`` codons."""
    return codons * 3 + 5


def codon_length(nucleotides: Column) -> Column:
    return F.floor((nucleotides - 5) / 3).cast("int")


def resolve_crop(size: int, units: str) -> dict[str, int]:
    """A crop size given in codons or nucleotides, in both units."""
    if units not in ("codon", "nucleotide"):
        raise ValueError(f"unknown crop unit: {units}")
    if size <= 0:
        raise ValueError("crop size must be positive")
    codons = size if units == "codon" else (size - 5) // 3
    if codons <= 0:
        raise ValueError("crop size is too small for one codon in every frame")
    return {"codons": codons, "nucleotides": 3 * codons + 5 if units == "codon" else size}


def mask_to_lower(seq: Column | str, spans: Column) -> Column:
    """Lower-case the half-open ``spans`` (array of struct start, end; sorted, disjoint)."""
    seq = _col(seq)
    edges = F.concat(
        F.array(F.lit(0)),
        F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))),
        F.array(F.length(seq)),
    )

    def rebuild(e: Column) -> Column:
        # Pieces alternate: unmasked, masked, unmasked, ...
        pieces = F.transform(
            F.sequence(F.lit(0), F.size(e) - 2),
            lambda i: let(
                piece(seq, F.get(e, i), F.get(e, i + 1) - F.get(e, i)),
                lambda p: F.when(i % 2 == 1, F.lower(p)).otherwise(p),
            ),
        )
        return F.array_join(pieces, "")

    return let(edges, rebuild)


#: Triplets whose intervals are scored at a time.
STRIP = 1 << 16


def _repetitive(codes: np.ndarray, window: int, score: float) -> np.ndarray:
    """Which letters lie in an interval of maximal repetition; see ``low_complexity_mask``."""
    out = np.zeros(len(codes), bool)
    wide = codes.astype(np.uint64)
    triplets = wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:]
    for start in range(0, len(triplets), STRIP):
        t = triplets[start : start + STRIP + window]  # one window of overlap
        m, own = len(t), min(STRIP, len(triplets) - start)
        equal_before = np.zeros(m, np.int32)  # equal triplets among those before, up to the interval's length
        pairs, best = np.zeros(m, np.int32), np.zeros(m)
        cover = np.zeros(m + 3, np.int32)
        for n in range(2, min(window - 2, m) + 1):
            equal_before[n - 1 :] += t[n - 1 :] == t[: m - n + 1]
            size = m - n + 1
            pairs = pairs[:size] + equal_before[n - 1 :]
            now = 10.0 * pairs / (n - 1)
            inner = np.maximum(best[:size], best[1 : size + 1])
            found = np.flatnonzero(((now > score) & (now >= inner))[:own])
            cover[found] += 1
            cover[found + n + 2] -= 1
            best = np.maximum(inner, now)
        covered = np.cumsum(cover)[: m + 2] > 0
        out[start : start + len(covered)] |= covered
    return out


def _masked(text: str | None, window: int, score: float) -> str | None:
    if text is None or len(text) < 4:
        return text
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = _repetitive(codes, window, score) & (codes >= 65) & (codes <= 90)
    return np.where(low, codes | 32, codes).astype("<u4").tobytes().decode("utf-32-le") if low.any() else text


def low_complexity_mask(seq: Column | str, window: int = 64, score: float = 20.0) -> Column:
    """Lower-case the letters of repetitive intervals.

    An interval of n triplets scores 10 * (pairs of equal triplets) / (n - 1). Masked are all
    intervals of up to ``window`` letters that score above ``score`` and in which no shorter
    interval scores more. Every interval is scored, for all starts of a strip at once: the work is
    the length times the window, in arrays of a fixed size.
    """

    @F.pandas_udf(StringType())
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, window, score) for t in texts], dtype=object)

    return mask(_col(seq))
