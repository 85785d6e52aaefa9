"""Token arrays: codons in six reading frames, bases on two strands, one-hot cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .constants import AMINO_ACID_IDS, BASE_TOKENS, IUPAC_FROM, IUPAC_TO, STRONG_WEAK, alphabet_ids
from .dna import _col

#: Letters of a batch that are worked on at a time; a longer text is taken alone.
PART = 1 << 21
#: Deepest cells that are written as a constant for each token.
CELLS = 1 << 7


def letter_parts(texts: pa.Array, part: int | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The rows of a batch in parts: code points of all letters in a row, and letters of each text."""
    part = part or PART
    texts = texts.fill_null("")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + part, "right")))
        joined = "".join(texts.slice(begin, stop - begin).to_pylist())
        yield slice(begin, stop), np.frombuffer(joined.encode("utf-32-le"), np.uint32), sizes[begin:stop]
        begin = stop


def first_places(sizes: np.ndarray) -> np.ndarray:
    """Where each text begins among the letters of all."""
    return np.cumsum(sizes) - sizes


def places_within(sizes: np.ndarray) -> np.ndarray:
    """The place of every letter in its own text."""
    return np.arange(sizes.sum()) - np.repeat(first_places(sizes), sizes)


def _lists(values: np.ndarray, sizes: np.ndarray, null: pa.Array | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=null)


def _groups(lists: pa.Array, each: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(lists) + 1, each), pa.int32()), lists)


def _like(rows: pa.ListArray, lists: pa.Array) -> pa.ListArray:
    """Other lists, grouped as those of ``rows``."""
    counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, lists, mask=rows.is_null())


def _each_part(texts: pa.Array, make: Callable[[np.ndarray, np.ndarray, pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``make(letters, sizes, nulls)`` for each part of a batch, together."""
    null = texts.is_null()
    made = [make(codes, sizes, null[rows.start : rows.stop]) for rows, codes, sizes in letter_parts(texts)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


_TOKENS = pa.list_(pa.int32())
_COMPLEMENT = {a: b for a, b in zip(IUPAC_FROM, IUPAC_TO, strict=True)}


def _table(values: dict[str, int], other: int) -> np.ndarray:
    """A value for each code point; the last slot is for all above ASCII."""
    out = np.full(129, other, np.int32)
    for letter, value in values.items():
        out[ord(letter)] = value
    return out


def _look_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, 128)]


def frame_length(nucleotides: Column) -> Column:
    """Codons in the shortest of the three frames of a strand."""
    third = F.floor(nucleotides / 3)
    return F.greatest(
        F.lit(0), F.when(nucleotides % 3 == 0, third - 2).otherwise(third - 1)
    ).cast("int")


def batch_frame_length(nucleotides: Column) -> Column:
    """Frame length used for fixed-size batches; equal to ``frame_length`` at 3c + 5."""
    return F.greatest(F.lit(0), F.floor(nucleotides / 3) - 1).cast("int")


def _codon_table(ids: list[int]) -> np.ndarray:
    """Token of a codon written as three base-5 digits; 0 where a digit is 4."""
    slots = np.zeros(125, np.int32)
    for n, token in enumerate(ids):
        second, first, third = n // 16, n // 4 % 4, n % 4
        slots[25 * first + 5 * second + third] = token + 1
    return slots


def codon_frames(seq: Column | str, alphabet: str = "codon_id") -> Column:
    """Six frames (three forward, three on the reverse complement) of codon tokens.

    A token is the alphabet id plus one; a codon with any other letter is 0. The codon at every
    place is looked up once for each strand, for all texts of a batch; a frame is every third.
    """
    tokens = _codon_table(alphabet_ids(alphabet))
    # Digits for T C A G; every other letter is 4.
    of = {b: n for n, b in enumerate("TCAG")}
    digits, paired = _table(of, 4), _table({a: of.get(b, 4) for a, b in _COMPLEMENT.items()}, 4)

    def frames_of(codes: np.ndarray, sizes: np.ndarray, null: pa.Array) -> pa.Array:
        d, r = _look_up(digits, codes), _look_up(paired, codes)
        forward = tokens[25 * d[:-2] + 5 * d[1:-1] + d[2:]]
        back = tokens[25 * r[2:] + 5 * r[1:-1] + r[:-2]]
        codons = np.maximum(0, sizes // 3 - np.where(sizes % 3 == 0, 2, 1))
        step, begin = places_within(codons), np.repeat(first_places(sizes), codons)
        end = begin + np.repeat(sizes, codons) - 3
        # The frames of a text follow each other.
        at = 6 * np.repeat(first_places(codons), codons) + step
        out = np.empty(6 * codons.sum(), np.int32)
        for offset in range(3):
            out[at + offset * np.repeat(codons, codons)] = forward[begin + offset + 3 * step]
            out[at + (offset + 3) * np.repeat(codons, codons)] = back[end - offset - 3 * step]
        nulls = pa.array(np.repeat(null.to_numpy(zero_copy_only=False), 6))
        return _groups(_lists(out, np.repeat(codons, 6), nulls), 6)

    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def frames(texts: pa.Array) -> pa.Array:
        return _each_part(texts, frames_of, pa.list_(_TOKENS))

    return frames(_col(seq))


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _pairs(frames: pa.Array) -> pa.Array:
    inner = frames.flatten()
    sizes = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = inner.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    pairs = np.maximum(sizes - 1, 0)
    at = np.repeat(first_places(sizes), pairs) + places_within(pairs)
    one, two = tokens[at], tokens[at + 1]
    made = _lists(np.where((one > 0) & (two > 0), (one - 1) * 64 + two, 0), pairs)
    return _like(frames, made)


def dicodon_frames(frames: Column) -> Column:
    """Overlapping codon pairs from ``codon_frames`` tokens: id c1 * 64 + c2, plus one."""
    return _pairs(frames)


def letters(seq: Column | str) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def letter_tokens(seq: Column | str, ids: dict[str, int], unknown: int = 0) -> Column:
    """One integer per letter."""
    table = _table(ids, unknown)

    def tokens_of(codes: np.ndarray, sizes: np.ndarray, null: pa.Array) -> pa.Array:
        return _lists(_look_up(table, codes), sizes, null)

    @F.arrow_udf(ArrayType(IntegerType()))
    def tokens(texts: pa.Array) -> pa.Array:
        return _each_part(texts, tokens_of, _TOKENS)

    return tokens(_col(seq))


def nucleotide_tokens(
    seq: Column | str, ids: dict[str, int] | None = None, reverse: bool = False
) -> Column:
    """Tokens of both strands; the second is complemented, and reversed if asked."""
    ids = ids or BASE_TOKENS
    plain = _table(ids, 0)
    other = _table({a: ids.get(b, 0) for a, b in _COMPLEMENT.items()}, ids.get("N", 0))

    def strands_of(codes: np.ndarray, sizes: np.ndarray, null: pa.Array) -> pa.Array:
        begin, within = np.repeat(first_places(sizes), sizes), places_within(sizes)
        at = 2 * begin + within
        size = np.repeat(sizes, sizes)
        out = np.empty(2 * len(codes), np.int32)
        out[at] = _look_up(plain, codes)
        out[at + size + (size - 1 - 2 * within if reverse else 0)] = _look_up(other, codes)
        nulls = pa.array(np.repeat(null.to_numpy(zero_copy_only=False), 2))
        return _groups(_lists(out, np.repeat(sizes, 2), nulls), 2)

    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def strands(texts: pa.Array) -> pa.Array:
        return _each_part(texts, strands_of, pa.list_(_TOKENS))

    return strands(_col(seq))


def protein_tokens(seq: Column | str) -> Column:
    ids = {aa: n for aa, n in AMINO_ACID_IDS.items() if aa != "*"}
    return letter_tokens(seq, ids)


def strong_weak_tokens(seq: Column | str) -> Column:
    return letter_tokens(seq, STRONG_WEAK, unknown=-1)


def _cells(values: np.ndarray, depth: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, depth), pa.int32()), pa.array(values, pa.int32()))


def one_hot(tokens: Column, depth: int, skip_zero: bool = True, batches: bool = False) -> Column:
    """One cell array per token. ``skip_zero``: token t sets cell t-1, of 1..depth-1 only.

    With ``batches``, all tokens of an Arrow batch at once; this cannot stand inside a lambda.
    """
    if batches:

        @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
        def cells_of(rows: pa.Array) -> pa.Array:
            numbers = rows.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            cells, set_ = np.zeros((len(numbers), depth), np.int32), np.flatnonzero((numbers > 0) & (numbers < depth))
            cells[set_, numbers[set_] - skip_zero] = 1
            return _like(rows, _cells(cells.ravel(), depth))

        return cells_of(tokens)
    if depth <= CELLS:
        # The cells of each token are written once, as a constant; the first are those of all other tokens.
        rows = [[int(t > 0 and i == t - skip_zero) for i in range(depth)] for t in range(depth)]
        known = F.expr(f"array({', '.join(f'array({", ".join(map(str, r))})' for r in rows)})")
        return F.transform(tokens, lambda t: F.get(known, F.when((t > 0) & (t < depth), t).otherwise(0).cast("int")))
    cells = F.sequence(F.lit(0), F.lit(depth - 1))
    if skip_zero:
        return F.transform(
            tokens,
            lambda t: F.transform(
                cells, lambda i: F.when((t > 0) & (t < depth) & (t - 1 == i), 1).otherwise(0)
            ),
        )
    return F.transform(
        tokens,
        lambda t: F.transform(cells, lambda i: F.when((t > 0) & (t == i), 1).otherwise(0)),
    )


def one_hot_to_tokens(cells: Column, depth: int, batches: bool = False) -> Column:
    """Position of the set cell, or ``depth`` for an all-zero row. ``batches`` as in ``one_hot``."""
    if not batches:
        return F.transform(
            cells,
            lambda c: F.coalesce(F.nullif(F.array_position(c, F.lit(1)), F.lit(0)) - 1, F.lit(depth))
            .cast("int"),
        )

    @F.arrow_udf(ArrayType(IntegerType()))
    def tokens_of(rows: pa.Array) -> pa.Array:
        inner = rows.flatten()
        sizes = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(inner.flatten().fill_null(0).to_numpy(zero_copy_only=False) == 1)[::-1]
        own = np.searchsorted(np.cumsum(sizes), at, "right")
        out = np.full(len(inner), depth, np.int32)
        out[own] = at - first_places(sizes)[own]  # the first set cell is written last
        return _like(rows, pa.array(out, pa.int32()))

    return tokens_of(cells)


def first_cells(cells: Column, size: int) -> Column:
    """The first ``size`` cells of each cell array."""

    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def cut(rows: pa.Array) -> pa.Array:
        inner = rows.flatten()
        sizes = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        kept = np.minimum(sizes, size)
        at = np.repeat(first_places(sizes), kept) + places_within(kept)
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
        made = pa.ListArray.from_arrays(offsets, inner.flatten().take(pa.array(at)), mask=inner.is_null() if inner.null_count else None)
        return _like(rows, made)

    return cut(cells)


def tokens_to_one_hot(tokens: Column, depth: int) -> Column:
    cells = F.sequence(F.lit(0), F.lit(depth - 1))
    return F.transform(
        tokens, lambda t: F.transform(cells, lambda i: F.when(t == i, 1).otherwise(0))
    )


def label_one_hot(label: Column, classes: int) -> Column:
    """Label vector; a binary label keeps one element."""
    if classes <= 1:
        return F.array(label.cast("int"))
    cells = F.sequence(F.lit(0), F.lit(classes - 1))
    return F.transform(cells, lambda i: F.when(label == i, 1).otherwise(0))


def pad_or_truncate(tokens: Column, length: int, value: int = 0) -> Column:
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(value), length)), 1, length)


def pad_frames(frames: Column, length: int, value: int = 0) -> Column:
    """``pad_or_truncate`` of every array of an array of token arrays."""

    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def padded(rows: pa.Array) -> pa.Array:
        inner = rows.flatten()
        sizes = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = np.minimum(sizes, length)
        within = places_within(kept)
        out = np.full(len(inner) * length, value, np.int32)
        tokens = inner.flatten().to_numpy(zero_copy_only=False)
        out[np.repeat(np.arange(len(inner)) * length, kept) + within] = tokens[np.repeat(first_places(sizes), kept) + within]
        full = np.where(inner.is_null().to_numpy(zero_copy_only=False), 0, length)
        made = _lists(out[np.repeat(full > 0, length)], full, inner.is_null())
        return _like(rows, made)

    return padded(frames)


def narrow_type(vocabulary: int) -> str:
    """Smallest integer type that holds ids below ``vocabulary``."""
    if vocabulary < 128:
        return "tinyint"
    return "smallint" if vocabulary < 32768 else "int"


def _joined(lists: pa.ListArray, texts: pa.Array, separator: str) -> pa.Array:
    """The texts of each list in a row, nulls left out."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if texts.null_count:
        known = np.concatenate([[0], np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False))])
        sizes, texts = np.diff(known[np.concatenate([[0], np.cumsum(sizes)])]), texts.drop_null()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), separator)
    return pc.if_else(lists.is_valid(), joined, None) if lists.null_count else joined


def _digits(lists: pa.ListArray, inner: pa.ListArray | None, values: pa.Array, separators: tuple[str, ...]) -> pa.Array | None:
    """The text of single digits, all of them at once; None where there are other numbers, nulls or empty lists."""
    if values.null_count or not 0 < len(values) < 1 << 29 or (inner is not None and inner.null_count):
        return None
    numbers = values.to_numpy(zero_copy_only=False)
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False) if inner is not None else None
    if numbers.min() < 0 or numbers.max() > 9 or (sizes is not None and not sizes.all()):
        return None
    text = np.empty((len(numbers), 2), np.uint8)
    text[:, 0], text[:, 1] = numbers + ord("0"), ord(separators[0])
    ends = np.concatenate([[0], np.cumsum(counts)])
    if sizes is not None:
        lasts = np.concatenate([[0], np.cumsum(sizes)])
        text[lasts[1:] - 1, 1] = ord(separators[1])
        ends = lasts[ends]
    kept = np.ones(2 * len(numbers), bool)
    kept[2 * ends[1:][np.diff(ends) > 0] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(np.maximum(2 * np.diff(ends) - 1, 0))]).astype(np.int32)
    made = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(text.ravel()[kept]))
    return pc.if_else(lists.is_valid(), made, None) if lists.null_count else made


def numbers_text(lists: Column, *separators: str) -> Column:
    """Lists of whole numbers (with two separators, lists of such lists) as text; nulls are left out."""

    @F.arrow_udf(StringType())
    def text(rows: pa.Array) -> pa.Array:
        inner = rows.flatten() if len(separators) > 1 else None
        values = rows.flatten() if inner is None else inner.flatten()
        found = _digits(rows, inner, values, separators)
        if found is None:
            texts = values.cast(pa.string())
            found = _joined(rows, texts if inner is None else _joined(inner, texts, separators[0]), separators[-1])
        return found

    return text(lists)


def reshape_frames(frames: Column, steps: int, size: int) -> Column:
    """Cut every frame into ``steps`` pieces of ``size``: [time, frame, codon]."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda t: F.transform(frames, lambda f: F.slice(f, t * size + 1, F.lit(size))),
    )
