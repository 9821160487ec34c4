"""Phrase collocations by Rabin-Karp fingerprints.

Texts are cut once into slices of coded words, kept as a table. Prefix sums of a polynomial over the words' hashes (modulo
2^64, in numpy) give each n-gram's fingerprint by one subtraction. Each slice deals out its distinct fingerprints with
their counts, as packed blocks, by range of fingerprint; a fingerprint's pointer is the slice that it comes from. Where a
range's sums are high enough, the fingerprint goes back to the slices that have it, and these alone read the phrase from
their words: the text decides which occurrences are the same phrase, and the counts that come out are of texts. An n-gram
is dealt out only if all the pairs of words in it may be frequent, as no phrase is more frequent than a part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import gathered, materialize, partitions, texts_of, tune, words_of

LONGEST = 4
OCCURRENCES = 30
TOP = 2000
#: Scores are this times a / (l + r), so that a phrase which is all that its parts occur in has a million.
SCALE = 2_000_000
#: A candidate goes if a longer one with so many hundredths of its occurrences holds it.
HELD = 80
#: Bytes of text in a slice, about.
SLICE = 2 << 20
#: Bytes of an Arrow batch.
BATCH = 4 << 20
#: Parts that a range of fingerprints is counted in, one after another.
PARTS = 8
#: Parts that a language's phrases are ranked in before they meet.
SALTS = 64
#: Scores are ranked in bands so wide, each on its own; how many rows the bands above have gives the rank.
BAND = 5000
UNKNOWN = "und"

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_SLICES = "slice bigint, langs array<string>, ends array<int>, n_words array<bigint>, words array<string>, codes binary"
_PRINTS = "bucket int, slice bigint, prints binary, counts binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's words by code from 1 on (2 or 4 bytes each), and 0 at the ends of pieces; texts by language, which end at `ends`."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(gathered(batches, "text", SLICE)):
        langs = pc.fill_null(batch.column("lang").cast(pa.string()), UNKNOWN).dictionary_encode()
        lang = langs.indices.to_numpy()
        order = np.argsort(lang, kind="stable")
        texts = pc.ascii_lower(texts_of(batch).take(pa.array(order)))
        cut = pc.binary_join_element_wise(pc.replace_substring_regex(texts, "[.,;:!?\\n\\v\\f\\r]+", " . "), " .", "")
        codes, bounds, words = words_of(cut)
        stop = pc.index(words, pa.scalar(".", words.type)).as_py()
        swapped = np.arange(len(words), dtype=np.int32)
        swapped[[0, stop]] = stop, 0
        names = words.take(pa.array(swapped))[1:]
        codes = swapped[codes]
        ends = bounds[np.searchsorted(lang[order], np.arange(len(langs.dictionary)), side="right")]
        counted = np.diff(np.concatenate([[0], np.cumsum(codes > 0)])[np.concatenate([[0], ends])])
        row = [[part << 20 | number], [langs.dictionary.to_pylist()], [ends.tolist()], [counted.tolist()], [codes.astype("<u2" if len(words) <= 1 << 16 else "<u4").tobytes()]]
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
        cols = [pa.array(x, k) for x, k in zip(row, kinds, strict=True)]
        cols.insert(4, pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names))
        yield pa.RecordBatch.from_arrays(cols, names=["slice", "langs", "ends", "n_words", "words", "codes"])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Slice:
    """A slice's words and the fingerprints of its n-grams."""

    def __init__(self, langs: list[str], ends: list[int], words: pa.Array, codes: pa.Buffer):
        self.words, self.langs = words, langs
        self.codes = np.frombuffer(codes, f"<u{codes.size // ends[-1]}" if ends and ends[-1] else "<u2").astype(np.int32)
        digest = xxhash.xxh64_intdigest
        spelt = words.cast(pa.large_binary())
        at, raw = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset : spelt.offset + len(words) + 1].tolist(), memoryview(spelt.buffers()[2] or b"")
        self.hashes = np.zeros(len(words) + 1, np.uint64)
        self.hashes[1:] = np.fromiter((digest(raw[a:b]) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(words))
        self.seeds = np.array([digest(x.encode(), 1) | 1 for x in langs], np.uint64)
        self.lang = np.repeat(np.arange(len(langs), dtype=np.int32), np.diff([0, *ends]))
        stops = np.flatnonzero(self.codes == 0).astype(np.int32)
        at = np.arange(len(self.codes), dtype=np.int32)
        self.room = stops[np.searchsorted(stops, at)] - at if len(stops) else at  # words up to the piece's end
        m = len(self.codes)
        power = np.full(m, _BASE, np.uint64)
        power[:1] = 1
        inverse = np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[:1] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes[self.codes] * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)])

    def starts(self, n: int) -> np.ndarray:
        """Where n-grams begin."""
        return np.flatnonzero(self.room >= n)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """The fingerprints of the n-grams that begin at these places, different for each language."""
        polynomial = (self.prefix[at + n] - self.prefix[at]) * self.inverse[at]
        return _mixed((polynomial + np.uint64(n)) * self.seeds[self.lang[at]])

    def possible(self, n: int, frequent: np.ndarray) -> np.ndarray:
        """Where n-grams begin all of whose pairs of words are among the frequent fingerprints (sorted)."""
        pairs = np.zeros(len(self.codes) + n, bool)
        at = self.starts(2)
        pairs[at] = among(self.prints(at, 2), frequent)
        own = self.starts(n)
        return own[np.logical_and.reduce([pairs[own + j] for j in range(n - 1)])] if n > 1 else own

    def phrases(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams at these places, a place for each distinct text and language, and how often it occurs. Fingerprints group them, the words decide."""
        _, first, group, times = np.unique(self.prints(at, n), return_index=True, return_inverse=True, return_counts=True)
        stands = at[first]
        own = stands[group]
        differ = self.lang[at] != self.lang[own]
        for j in range(n):
            differ |= self.codes[at + j] != self.codes[own + j]
        if differ.any():
            times -= np.bincount(group[differ], minlength=len(times))
            rest = at[differ]
            _, first, more = np.unique(np.stack([self.lang[rest], *(self.codes[rest + j] for j in range(n))], 1), axis=0, return_index=True, return_counts=True)
            stands, times = np.concatenate([stands, rest[first]]), np.concatenate([times, more])
        return stands, times


def packed(prints: np.ndarray) -> bytes:
    """Sorted fingerprints as their differences, byte by byte, so that the bytes which are all zero compress to nothing."""
    return np.diff(prints, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _slice_of(batch: pa.RecordBatch, i: int) -> Slice:
    return Slice(batch.column("langs")[i].as_py(), batch.column("ends")[i].as_py(), batch.column("words")[i].values, batch.column("codes")[i].as_buffer())


def _dealt(number: int, found: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """A slice's fingerprints as rows for each range of fingerprints that has any."""
    prints, counts = np.unique(np.concatenate(found), return_counts=True)
    bucket = ((prints >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(prints)]]) if len(prints) else np.zeros(1, np.int64)
    own = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
    cols = [
        pa.array(bucket[cuts[:-1]], pa.int32()),
        pa.array(np.full(len(cuts) - 1, number)),
        pa.array([packed(prints[a:b]) for a, b in own], pa.binary()),
        pa.array([counts[a:b].astype("<u4").tobytes() for a, b in own], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "slice", "prints", "counts"])


def _frequent(least: int):
    """A range's fingerprints that occur often enough, for each slice that has some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, prints, counts = [], [], []
        for batch in batches:
            numbers += batch.column("slice").to_pylist()
            prints += [unpacked(x.as_buffer()) for x in batch.column("prints")]
            counts += [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("counts")]
        if not numbers:
            return
        low, high = min(int(p[0]) for p in prints), max(int(p[-1]) for p in prints) + 1
        edges = np.array([low + (high - low) * i // PARTS for i in range(PARTS)], np.uint64)
        cuts = [np.append(np.searchsorted(p, edges), len(p)) for p in prints]
        kept: list[list[np.ndarray]] = [[] for _ in prints]
        for i in range(PARTS):
            own = [p[c[i] : c[i + 1]] for p, c in zip(prints, cuts, strict=True)]
            _, group = np.unique(np.concatenate(own), return_inverse=True)
            times = np.concatenate([n[c[i] : c[i + 1]] for n, c in zip(counts, cuts, strict=True)])
            enough = np.bincount(group, weights=times)[group] >= least  # sums of counts are exact in doubles up to 2^53
            at = 0
            for p, found in zip(own, kept, strict=True):
                found.append(p[enough[at : at + len(p)]])
                at += len(p)
        rows = [(k, packed(own)) for k, found in zip(numbers, kept, strict=True) if len(own := np.concatenate(found))]
        cols = list(zip(*rows, strict=True)) if rows else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["slice", "prints"])

    return run


def _may_be_frequent(found: DataFrame, least: int) -> DataFrame:
    n = partitions(found.sparkSession)
    return found.repartitionById(n, F.col("bucket")).mapInArrow(_frequent(least), "slice bigint, prints binary")


def _met(table: DataFrame, kept: DataFrame, work: Callable[[int, Slice, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(number, slice, its fingerprints that may be frequent, sorted) for all slices. A slice's rows of fingerprints come before its words."""
    names = ["slice", "langs", "ends", "words", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = None, []
        for batch in batches:
            for i, (k, prints) in enumerate(zip(batch.column("slice").to_pylist(), batch.column("prints").to_pylist(), strict=True)):
                if k != number:
                    number, own = k, []
                if prints is not None:
                    own.append(unpacked(pa.py_buffer(prints)))
                else:
                    yield from work(k, _slice_of(batch, i), np.sort(np.concatenate([np.empty(0, np.uint64), *own])))

    n = partitions(table.sparkSession)
    both = kept.select("slice", "prints").unionByName(table.select(*names), allowMissingColumns=True)
    place = F.pmod(F.shiftright("slice", 20) + (F.col("slice") % (1 << 20)) * 7919, F.lit(n)).cast("int")
    return both.repartitionById(n, place).sortWithinPartitions("slice", F.col("prints").isNull()).mapInArrow(run, schema)


def _small_batches(spark: SparkSession) -> None:
    """Rows are as large as a slice, so Arrow batches are bounded by bytes; a smaller setting of the user's stays."""
    tune(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(key)).lower().removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH:
        spark.conf.set(key, str(BATCH))


def frequent_phrases(docs: DataFrame, least: int = OCCURRENCES, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases of up to `longest` words with f >= least; and (lang, n), all its words."""
    spark = docs.sparkSession
    _small_batches(spark)
    n_buckets = partitions(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table = materialize(rows.mapInArrow(_slices, _SLICES))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                own = _slice_of(batch, i)
                yield _dealt(number, [own.prints(own.starts(n), n) for n in range(1, min(2, longest) + 1)], n_buckets)

    def long(number: int, own: Slice, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _dealt(number, [own.prints(own.possible(n, frequent), n) for n in range(3, longest + 1)], n_buckets)

    def texts(number: int, own: Slice, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        for n in range(1, longest + 1):
            at = own.starts(n) if n < 3 else own.possible(n, frequent)
            stands, times = own.phrases(at[among(own.prints(at, n), frequent)], n)
            spelt = [own.words.take(pa.array(own.codes[stands + j] - 1)) for j in range(n)]
            phrases = pc.binary_join_element_wise(*spelt, " ")
            lang = pa.array(own.langs, pa.string()).take(pa.array(own.lang[stands]))
            cols = [lang, phrases, pa.array(np.full(len(phrases), n, np.int32)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "n_words", "f"])

    kept = materialize(_may_be_frequent(table.select("slice", "langs", "ends", "words", "codes").mapInArrow(short, _PRINTS), least))
    if longest > 2:
        kept = materialize(kept.union(_may_be_frequent(_met(table, kept, long, _PRINTS), least)))
    counted = _met(table, kept, texts, "lang string, phrase string, n_words int, f bigint")
    found = counted.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = table.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n_words").alias("n"))
    return materialize(found), words


def _wide(column: str):
    return F.col(column).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of phrases of two words or more, each cut where its score is lowest, the earliest of these cuts.

    Parts of a frequent phrase are frequent themselves, so their counts are there. Products are decimals of up to 38 digits.
    """
    words = F.split("phrase", " ")
    cuts = found.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "n_words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words")), " ").alias("rest")
    )
    own = found.select("lang", F.col("phrase").alias("part"), "f")
    both = parts.join(own.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(own.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.withColumn("score", F.expr(f"cast(a AS decimal(20,0)) * {SCALE} div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("x")
    return both.groupBy("lang", "phrase", "n_words", "a").agg(lowest).select("lang", "phrase", "n_words", "a", "x.l", "x.r", "x.score")


def maximal(candidates: DataFrame, held: int = HELD) -> DataFrame:
    """Candidates that no longer one holds with `held` hundredths of their occurrences or more."""
    longer = candidates.where("n_words > 2").select("lang", F.split("phrase", " ").alias("w"), "n_words", F.col("a").alias("f"))
    sized = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    within = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    joined = candidates.join(within, ["lang", "phrase"], "left")
    return joined.where(F.col("f").isNull() | (_wide("f") * 100 < _wide("a") * held)).drop("f")


def collocations(docs: DataFrame, least: int = OCCURRENCES, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts with A-Z in lower case are split at `[.,;:!?\\x0A-\\x0D]` into pieces, these into words `[^\\x20\\x09]+`; counts are of
    all occurrences within pieces, overlaps included. A null text is empty, a null lang is `und`; repeated rows count each;
    other columns are ignored; a language without candidates has no rows. Phrases are ordered by score, then a, both
    descending, then the phrase's bytes.
    """
    found, words = frequent_phrases(docs, least, longest)
    kept = maximal(materialize(scored(found)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    some = materialize(some.drop("rank", "salt").withColumn("band", F.floor(F.col("score") / BAND)))
    bands = some.groupBy("lang", "band").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1))
    bands = bands.select("lang", "band", F.coalesce(above, F.lit(0)).alias("above"))
    place = F.row_number().over(Window.partitionBy("lang", "band").orderBy(*order))
    ranked = some.withColumn("place", place).join(bands, ["lang", "band"]).withColumn("rank", F.col("above") + F.col("place")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
