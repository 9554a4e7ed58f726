"""Text functions as column expressions: normal forms, hashes, shingles, SimHash, token sets, numbers, keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
ARABIC_LETTERS = ("يك", "یک")
DIACRITICS = "[\u064b-\u0670&&[\u064b-\u065f\u0670]]"
TITLE_MARKS = "[«»\"'()\\[\\]{}\\-.،؛:!؟?…]"
INVISIBLE = "[\u200b-\ufeff&&[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]]"
#: White space of any script.
SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"


#: Letters, digits and marks that the compatibility form leaves as they are, whatever stands beside them: ASCII, Latin-1
#: without its compatibility signs, and the letters and digits of Arabic and Persian.
SETTLED = r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u060c\u061b\u061f\u0621-\u063a\u0641-\u064a\u0660-\u0669\u067e\u0686\u0698\u06a9\u06af\u06cc\u06f0-\u06f9\u200b-\u200f\u2013\u2014\u2018-\u201e"


def once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it, also in lambdas."""
    return F.element_at(F.transform(F.array(x), f), 1)


def spaced(text: Column, spaces: str = SPACES, flags: str = "") -> Column:
    """Runs of white space as one space.  A lone space is no match, so nothing is built anew for each word, and the ranges
    before && settle the visible characters of ASCII."""
    any_, other = (rf"[\x00-{end}\x7f-\x{{10ffff}}&&[{spaces}]]" for end in (r"\x20", r"\x1f"))
    return F.regexp_replace(text, f"{flags}{other}{any_}*+| {any_}++", " ")


def stripped(line: Column) -> Column:
    """Without white space of any script at its ends, for which lines are searched only if their first or last character is such."""
    return once(line, lambda s: F.when(F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).otherwise(s))


def translated(text: Column, old: str, new: str) -> Column:
    """F.translate, which makes a string of every character, only of texts that hold one of the characters."""
    some = "".join(f"\\x{{{ord(c):x}}}" for c in old)
    held = rf"[\x{{{min(map(ord, old)):x}}}-\x{{{max(map(ord, old)):x}}}&&[{some}]]"
    return once(text, lambda t: F.when(t.rlike(held), F.translate(t, old, new)).otherwise(t))


def nfkc(text: Column) -> Column:
    """The compatibility form of texts."""
    return F.coalesce(nfkc_if_other(text), text)


def nfkc_if_other(text: Column) -> Column:
    """The compatibility form of texts that may differ from it, null for others.

    Spark's functions don't offer it, so texts go to Python in Arrow batches, but only those with a character outside of
    ``SETTLED``: for others the batch holds a null.
    """

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # the range before && settles ASCII, which is most of most texts, by one comparison a character
    return form(once(text, lambda t: F.when(t.rlike(rf"[\x80-\x{{10ffff}}&&[^{SETTLED}]]"), t)))


def normalized_for_hash(text: Column) -> Column:
    """TXT-02: compatibility form, letters unified, diacritics, invisible marks and tags dropped, spaces collapsed, lower
    case; null is empty."""
    return folded(nfkc(F.coalesce(text, F.lit(""))))


def folded(text: Column) -> Column:
    """What TXT-02 makes of a text in compatibility form; unlike that form it can stand in a lambda."""
    x = text
    for old, new in zip(*ARABIC_LETTERS, strict=True):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(F.regexp_replace(x, DIACRITICS, ""), INVISIBLE, "")
    return F.lower(F.trim(spaced(F.regexp_replace(x, "<[^>]+>", " "))))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized_for_hash(text), 256)


def normalized_title(text: Column) -> Column:
    """TXT-04: punctuation of titles becomes a space."""
    return F.trim(spaced(F.regexp_replace(normalized_for_hash(text), TITLE_MARKS, " ")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def shingles(text: Column, size: int = 3) -> Column:
    """TXT-06: word shingles; of fewer words one shingle of all; none of an empty text."""

    def of(w: Column) -> Column:
        n = F.size(w)
        # words by their places: a slice would copy the whole list for every shingle
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(many)

    return once(words(text), of)


def majority(flat: np.ndarray, offsets: np.ndarray, piece: int = 1 << 14) -> np.ndarray:
    """For each list flat[offsets[k]:offsets[k + 1]] the integer whose bits most of it have; 0 for an empty list."""
    sizes = np.diff(offsets)
    counts = np.zeros((len(sizes), 64), np.int32)
    for start in range(int(offsets[0]), int(offsets[-1]), piece):  # so many hashes at a time, whatever lists they are of
        own = flat[start : min(start + piece, int(offsets[-1]))]
        bits = np.unpackbits(own.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        lists = np.arange(np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, start + len(own), "left"))
        lists = lists[sizes[lists] > 0]
        counts[lists] += np.add.reduceat(bits, np.maximum(offsets[lists] - start, 0), axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def with_simhash64(df: DataFrame, grams: Column, name: str = "simhash") -> DataFrame:
    """TXT-07: the rows with a SimHash of their shingles, whose bit i is set where more hashes have it than not.

    Hashes are the first 8 bytes of MD5, taken by Spark; bits are counted in Arrow batches.
    """
    hashes = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 16), 16, -10).cast("long"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            made = pa.array(majority(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=batch.schema.names)

    return df.withColumn(name, hashes).mapInArrow(count, ", ".join([*fields, f"`{name}` long"]))


def jaccard(a: Column, b: Column) -> Column:
    """TXT-13; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def numbers(text: Column) -> Column:
    """TXT-15: distinct numbers as strings in order, digits of any script."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(translated(F.coalesce(text, F.lit("")), *DIGITS), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))))


def lineage_key(url: Column) -> Column:
    """TXT-52: the host of an item that wasn't forwarded."""
    return F.concat(F.lit("dom:"), F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)))


def slug(text: Column) -> Column:
    """TXT-60 without its random end: runs of what is no letter, digit or underscore as one dash, none at either end, before
    and after the cut to 60 characters; ``story`` if nothing is left."""
    dashed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\u0600-\u06FF]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60), "^-+|-+$", "")
    return F.when(cut == "", F.lit("story")).otherwise(cut)


def bucket_15m(ts: Column) -> Column:
    """TXT-22."""
    return F.concat(F.date_format(ts, "yyyyMMddHH"), F.floor(F.minute(ts) / 15).cast("string"))
