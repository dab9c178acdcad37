"""Text scalar functions: cleaning, token counts, profiles, number coercion.

Token counting is done on Arrow batches with one NumPy ``bincount`` per slice of
text. Against the equivalent chain of ``length - length(replace)`` expressions
this reads each text once instead of once per vocabulary entry (0.6 s against
3.5 s for 600,000 rows with four texts each on eight cores), and a wide
vocabulary does not produce a generated method too large for the JIT. The
expression form is kept as :func:`token_vector_expr` for plans without Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that carry no token: decimal digits of any script and brackets.
REMOVED = r"[\p{Nd}()\[\]{}]+"
_BRACKETS = "()[]{}"
_SLICE_BYTES = 4 << 20


def is_removed(char: str) -> bool:
    """Python twin of :data:`REMOVED` for one character."""
    return char in _BRACKETS or char.isdecimal()


def clean_text(col: str | Column) -> Column:
    """Delete digits and brackets; what remains is the token alphabet."""
    return F.regexp_replace(_col(col), REMOVED, "")


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Row slices of a text array, each about 4 MB or one row if that is longer.

    A record batch is bounded by rows, not by bytes; working on slices keeps the
    index arrays below small even when single texts run to megabytes.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + _SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield texts.slice(start, stop - start)
        start = stop


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(code points of all rows end to end, number of code points per row)``."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    if raw.size == 0 or raw.max() < 128:
        return raw, np.diff(offsets)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, pc.utf8_length(texts).to_numpy(zero_copy_only=False)


def _token_slots(vocab: Sequence[str]) -> np.ndarray:
    """Code point → vector position; unknown or removed characters → one past the end."""
    width = len(vocab)
    table = np.full(max([127, *map(ord, vocab)]) + 2, width, dtype=np.int64)
    for position, token in enumerate(vocab):
        if not is_removed(token):
            table[ord(token)] = position
    return table


def _check_vocab(vocab: Sequence[str]) -> list[str]:
    vocab = list(vocab)
    if any(len(token) != 1 for token in vocab) or len(set(vocab)) != len(vocab):
        raise ValueError("a vocabulary is a list of distinct single characters")
    return vocab


def token_vector(col: str | Column, vocab: Sequence[str]) -> Column:
    """``array<int>`` with the count of every vocabulary token, in vocabulary order.

    Characters outside the vocabulary are dropped; a null text gives null.
    """
    vocab = _check_vocab(vocab)
    width = len(vocab)
    slots = _token_slots(vocab)

    def count(texts: pa.Array) -> pa.Array:
        parts = []
        for piece in text_slices(texts):
            points, lengths = code_points(piece)
            rows = np.repeat(np.arange(len(piece), dtype=np.int64) * (width + 1), lengths)
            rows += slots.take(points, mode="clip")
            counts = np.bincount(rows, minlength=len(piece) * (width + 1))
            parts.append(counts.reshape(len(piece), width + 1)[:, :width].astype(np.int32).ravel())
        values = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
        offsets = pa.array(np.arange(0, (len(texts) + 1) * width, width, dtype=np.int32))
        if texts.null_count:
            missing = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
            offsets = pa.array(offsets.to_numpy(), mask=missing)
        return pa.ListArray.from_arrays(offsets, values)

    return F.arrow_udf(count, T.ArrayType(T.IntegerType()))(_col(col))


def token_vector_expr(col: str | Column, vocab: Sequence[str]) -> Column:
    """:func:`token_vector` from built-in expressions only.

    Cleaning needs no pass of its own: removed characters are never counted, and
    deleting them changes no other character's count.
    """
    text = _col(col)
    counts = [
        F.lit(0) if is_removed(token) else (F.length(text) - F.length(F.replace(text, F.lit(token), F.lit(""))))
        for token in _check_vocab(vocab)
    ]
    return F.when(text.isNotNull(), F.array(*[c.cast("int") for c in counts]))


def count_tokens(col: str | Column) -> Column:
    """``map<string,int>`` of the characters left after cleaning."""

    def count(texts: pa.Array) -> pa.Array:
        keys: list[str] = []
        values, sizes = [], []
        for piece in text_slices(texts):
            points, lengths = code_points(piece)
            rows = np.repeat(np.arange(len(piece), dtype=np.int64), lengths)
            pairs, counts = np.unique((rows << 21) | points.astype(np.int64), return_counts=True)
            chars = pairs & 0x1FFFFF
            alphabet = {int(p): chr(int(p)) for p in np.unique(chars)}
            removed = [p for p, c in alphabet.items() if is_removed(c)]
            keep = ~np.isin(chars, removed)
            keys.extend(alphabet[p] for p in chars[keep].tolist())
            values.append(counts[keep])
            sizes.append(np.bincount((pairs >> 21)[keep], minlength=len(piece)))
        sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        values = np.concatenate(values) if values else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.MapArray.from_arrays(
            pa.array(offsets), pa.array(keys, pa.string()), pa.array(values.astype(np.int32))
        )

    counted = F.arrow_udf(count, T.MapType(T.StringType(), T.IntegerType()))(_col(col))
    return F.when(_col(col).isNotNull(), counted)


def ratio_or_zero(numerator: str | Column, denominator: str | Column) -> Column:
    """``a / b`` where ``b > 0``, else 0."""
    a, b = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def sum_of(*cols: str | Column) -> Column:
    """Sum of descriptor columns (for example donors + acceptors)."""
    return reduce(lambda a, b: a + b, [_col(c) for c in cols])


PROFILE_SCHEMA = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in
     ("n_chars", "n_upper", "n_lower", "n_digit", "n_open", "n_punct", "n_distinct")]
    + [T.StructField("lower_share", T.DoubleType())]
)

#: Character classes of :func:`text_profile`; everything else is punctuation.
_CLASSES = {
    "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "n_lower": "abcdefghijklmnopqrstuvwxyz",
    "n_digit": "0123456789",
    "space": " \t\n\f\r",
    "n_open": "([{",
}
_MATRIX_CELLS = 8_000_000


def _profile(texts: pa.Array) -> dict[str, np.ndarray]:
    """Profile columns of a text array from its (row, character) count matrix."""
    points, lengths = code_points(texts)
    alphabet = np.flatnonzero(np.bincount(points)) if points.size else np.empty(0, np.int64)
    slots = np.zeros(int(alphabet[-1]) + 1 if alphabet.size else 1, dtype=np.int64)
    slots[alphabet] = np.arange(alphabet.size)
    codes = slots[points]
    step = max(1, _MATRIX_CELLS // max(1, alphabet.size))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    members = {name: np.isin(alphabet, [ord(c) for c in chars]) for name, chars in _CLASSES.items()}
    parts: dict[str, list[np.ndarray]] = {name: [] for name in (*_CLASSES, "n_distinct")}
    for start in range(0, len(texts), step):
        stop = min(start + step, len(texts))
        rows = np.repeat(np.arange(stop - start, dtype=np.int64) * alphabet.size, lengths[start:stop])
        cells = np.bincount(rows + codes[ends[start] : ends[stop]], minlength=(stop - start) * alphabet.size)
        matrix = cells.reshape(stop - start, alphabet.size)
        for name, member in members.items():
            parts[name].append(matrix[:, member].sum(1))
        parts["n_distinct"].append((matrix > 0).sum(1))
    columns = {name: np.concatenate(p) for name, p in parts.items()}
    known = sum(columns[name] for name in ("n_upper", "n_lower", "n_digit", "space"))
    letters = columns["n_upper"] + columns["n_lower"]
    columns["n_chars"], columns["n_punct"] = lengths, lengths - known
    columns["lower_share"] = columns["n_lower"] / np.maximum(letters, 1)
    return columns


def text_profile(col: str | Column) -> Column:
    """Struct of eight descriptors of one text; null for a null text.

    Length, counts of ASCII upper and lower case letters and digits, of opening
    brackets, of characters that are neither ASCII letter, digit nor white space,
    of distinct characters, and the share of lower case among ASCII letters.
    One read per text on Arrow batches, an order of magnitude faster than the
    regular expressions of :func:`text_profile_expr`.
    """

    def run(texts: pa.Array) -> pa.Array:
        pieces = [_profile(piece) for piece in text_slices(texts)]
        fields = []
        for field in PROFILE_SCHEMA.fields:
            kind = pa.float64() if field.name == "lower_share" else pa.int32()
            values = np.concatenate([p[field.name] for p in pieces]) if pieces else np.empty(0)
            fields.append(pa.array(values.astype(kind.to_pandas_dtype())))
        return pa.StructArray.from_arrays(fields, names=PROFILE_SCHEMA.fieldNames(), mask=texts.is_null())

    return F.arrow_udf(run, PROFILE_SCHEMA)(_col(col))


def text_profile_expr(col: str | Column) -> Column:
    """:func:`text_profile` from built-in expressions only.

    Punctuation is what other classes leave over: a negated character class costs
    ten times a plain one.
    """
    text = _col(col)
    lower, upper, digit, space = (
        F.regexp_count(text, F.lit(f"[{chars}]")) for chars in ("a-z", "A-Z", "0-9", "\\t\\n\\f\\r ")
    )
    profile = F.struct(
        F.length(text).alias("n_chars"),
        upper.alias("n_upper"),
        lower.alias("n_lower"),
        digit.alias("n_digit"),
        F.regexp_count(text, F.lit(r"[(\[{]")).alias("n_open"),
        (F.length(text) - upper - lower - digit - space).alias("n_punct"),
        F.when(text == "", 0).otherwise(F.size(F.array_distinct(F.split(text, "")))).alias("n_distinct"),
        ratio_or_zero(lower, lower + upper).alias("lower_share"),
    )
    return F.when(text.isNotNull(), profile)


_INT = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def coerce_number(col: str | Column, prefix: str = "as") -> list[Column]:
    """Integer if the text parses as one, else float, else the text itself.

    Returns three columns ``<prefix>_int``, ``<prefix>_float``, ``<prefix>_text``
    of which at most one is set. Integers beyond 64 bits become floats.
    """
    text = _col(col)
    trimmed = F.trim(text)
    whole = F.when(text.rlike(_INT), trimmed.try_cast("bigint"))
    real = F.when(whole.isNull() & text.rlike(_FLOAT), trimmed.try_cast("double"))
    return [
        whole.alias(f"{prefix}_int"),
        real.alias(f"{prefix}_float"),
        F.when(whole.isNull() & real.isNull(), text).alias(f"{prefix}_text"),
    ]
