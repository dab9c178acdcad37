"""Language ID with n-gram filters whose slots are bit masks of languages.

Learning counts character n-grams (lower-cased letters, anything else one space) of a bounded sample of
labelled rows per language. A language claims an n-gram whose share in it is at least ``CLAIM`` of the
n-gram's largest share in any language. Claims are kept as a Bloom filter per language, bit-sliced: slot i
holds bit i of all filters in one word, so that one look-up per hash and an AND return all languages that
hold an n-gram. A text's hits per language are popcounts over its n-grams; what false positives add (the
share of set bits to the power of the hashes) is taken out before the largest decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import text_slices

SIZES = (3, 4)
HASHES = 3
#: Rows of each language that learning reads, in expectation.
SAMPLE_ROWS = 2_000
CLAIM = 0.5
#: Slots per claimed n-gram, rounded up to a power of two; at most 2**26 slots.
SLOTS_PER_CLAIM = 16
#: Text that is cut into n-grams in one go: it takes arrays of about a hundred times as many bytes.
SLICE = 1 << 20
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def letters() -> np.ndarray:
    """Lower-cased code point of every letter (or mark), 32 for anything else."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            if not 0xD800 <= cp < 0xE000 and unicodedata.category(chr(cp))[0] in "LM":
                low = chr(cp).lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _TABLE.append(table)
    return _TABLE[0]


def has_letter() -> np.ndarray:
    """True for code points of category L alone."""
    if len(_TABLE) < 2:
        letters()
        _TABLE.append(np.array([unicodedata.category(chr(cp))[0] == "L" for cp in range(0x110000)]))
    return _TABLE[1]


def ngram_hashes(texts: list[str | None], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of a batch, the text of each, and which texts have a letter.

    A text is padded with a space at both ends; n-grams that start or end inside a run of spaces are left out.
    """
    padded = ["" if t is None else t for t in texts]
    code = np.frombuffer(("  " + "  ".join(padded) + "  ").encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    owner = np.repeat(np.arange(len(padded)), size + 2)
    x = letters()[code][1:-1]
    solid = x != 32
    has = np.bincount(owner[has_letter()[code][1:-1]], minlength=len(padded)) > 0
    # runs of spaces shrink to one; every text keeps its first pad
    keep = solid | np.concatenate(([True], solid[:-1] | (owner[1:] != owner[:-1])))
    x, owner = x[keep].astype(np.uint64), owner[keep]
    hashes, owners = [], []
    for n in sizes:
        if len(x) < n:
            continue
        h = np.zeros(len(x) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ x[i : len(x) - n + 1 + i]) * _MIX[0]
            h ^= h >> np.uint64(29)
        h = (h + np.uint64(n)) * _MIX[1]
        inside = owner[: len(h)] == owner[n - 1 :]
        for i in range(1, n - 1):  # a space inside would join two words
            inside &= x[i : len(h) + i] != 32
        hashes.append(h[inside])
        owners.append(owner[: len(h)][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class LanguageFilter:
    """Languages in code-point order; ``slots`` has a word of masks per 64 languages."""

    languages: list[str]
    slots: np.ndarray

    @classmethod
    def build(cls, claims: list[tuple[int, list[str]]], languages: list[str]) -> LanguageFilter:
        languages = sorted(languages)
        place = {name: i for i, name in enumerate(languages)}
        bits = min(26, max(10, int(len(claims) * SLOTS_PER_CLAIM - 1).bit_length()))
        slots = np.zeros((-(-len(languages) // 64) or 1, 1 << bits), np.uint64)
        hashed = np.array([h for h, _ in claims], np.int64).view(np.uint64)
        for name, i in place.items():
            own = hashed[np.fromiter((name in held for _, held in claims), bool, len(claims))]
            for at in slot_places(own, bits):
                slots[i // 64][at] |= np.uint64(1 << i % 64)
        return cls(languages, slots)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text; the score is the winner's share of all corrected hits."""
        hashes, owner, has = ngram_hashes(texts)
        bits = self.slots.shape[1].bit_length() - 1
        places = slot_places(hashes, bits)
        total = np.bincount(owner, minlength=len(texts))
        rate = np.zeros((len(texts), max(1, len(self.languages))))
        for word, slots in enumerate(self.slots):
            mask = slots[places[0]]
            for at in places[1:]:
                mask &= slots[at]
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                bit = np.uint64(1 << i % 64)
                false = float(np.count_nonzero(slots & bit) / len(slots)) ** HASHES
                hits = np.bincount(owner[mask & bit != 0], minlength=len(texts))
                rate[:, i] = np.clip((hits / np.maximum(total, 1) - false) / max(1e-9, 1 - false), 0, 1)
        best, whole = rate.argmax(axis=1), rate.sum(axis=1)
        score = np.where(whole > 0, rate.max(axis=1) / np.maximum(whole, 1e-12), 0.0)
        known = has & bool(self.languages)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def slot_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slots of every n-gram: two halves of a hash, combined."""
    mask = np.uint64((1 << bits) - 1)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n``: the n-grams of each language in every slice of the texts."""
    for part in text_slices(batches, limit=SLICE):
        names = part.column("lang").to_pylist()
        order = sorted(set(names))
        hashes, owner, _ = ngram_hashes(part.column("text").to_pylist())
        which = np.array([order.index(n) for n in names])[owner]
        for i, name in enumerate(order):
            seen, n = np.unique(hashes[which == i], return_counts=True)
            yield pa.record_batch([pa.array([name] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(rows: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, claim: float = CLAIM) -> LanguageFilter:
    """Filter learned from rows with a text and a language.

    Of a language with more than ``sample_rows`` rows, those are read whose key's hash falls below the
    matching share. N-gram counts are Spark aggregates; the claims of the bounded sample come to the driver.
    """
    rows = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(language).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(42)), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_rows / r["n"])))]) if sizes else None
    if share is None:
        return LanguageFilter.build([], [])

    drawn = rows.where(draw < F.try_element_at(share, F.col(language))).select(F.col(language).alias("lang"), F.col(text).alias("text"))
    counts = drawn.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter.build([], [r["lang"] for r in sizes])
    total = F.create_map(*[x for name, n in totals.items() for x in (F.lit(name), F.lit(float(n)))])
    shares = counts.withColumn("share", F.col("n") / F.try_element_at(total, F.col("lang")))
    held = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("all"))
    claims = held.select("gram", F.transform(F.filter("all", lambda x: x["share"] >= F.col("top") * claim), lambda x: x["lang"]).alias("held"))
    return LanguageFilter.build([(r["gram"], r["held"]) for r in claims.toLocalIterator()], [r["lang"] for r in sizes])


def held_out(key: str = "doc_id") -> Column:
    """True for rows that learning never sees: CRC-32 of the key's text, modulo 4, is 2; a null key is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, held_out, lang_pred, score`` for every row, from its whole text.

    A null text or one without a letter is ``und`` with score 0; so is any text if nothing was learned. A
    text whose n-grams no language holds has score 0 and the first language. Repeated rows are predicted
    each; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SLICE):
            names, scores = sent.value.predict(part.column("text").to_pylist())
            yield pa.record_batch([part.column("key"), part.column("out"), pa.array(names, pa.string()), pa.array(scores)], ["key", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), held_out(key).alias("out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def predicted(texts: pa.Array) -> pa.Array:
        parts = text_slices(iter([pa.record_batch([texts], ["text"])]), limit=SLICE)
        names = [n for part in parts for n in sent.value.predict(part.column("text").to_pylist())[0]]
        return pa.array(names, pa.string())

    return docs.where(predicted(F.col(text)) != UNKNOWN)
