"""Quality rules with suffix-array repetition.

The words of a batch of documents are sorted as suffixes by prefix doubling, each document apart from the others. The
longest common prefixes of neighbours in the order are the intervals of maximal repeated substrings: at each word the
longest one that starts there. The union of their spans is the covered part of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import slices, sums, texts_of, tune, words_of

#: Characters that count as symbols; a fixed value.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a document at a limit is kept.

    least_words and repeat_percent are the base rules: words in three-word windows found twice. least_repeat is the
    number of words from which a repeated substring counts; covered_percent limits the share of words under such
    substrings, and must be below repeat_percent to say more than the base rules; longest_percent and longest_words limit the longest one, which fails only beyond both.
    """

    least_words: int = 50
    repeat_percent: int = 50
    least_repeat: int = 5
    covered_percent: int = 30
    longest_percent: int = 15
    longest_words: int = 50


def suffix_ranks(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... words at each place, until every suffix has a rank of its own.

    Equal ranks mean equal substrings of one document. A rank is the place of the first of its class in the sorted order.
    """
    n = len(codes)
    first = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, step = [rank], 1
    ends = np.searchsorted(doc, doc, side="right")
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            return ranks
        after = tied + step
        key = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[tied]
        order = np.lexsort((key, own))
        o, k = own[order], key[order]
        head = np.concatenate([[True], o[1:] != o[:-1]])
        new = head | np.concatenate([[True], k[1:] != k[:-1]])
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[tied[order]] = o + np.maximum.accumulate(np.where(new, at, 0)) - start
        ranks.append(rank)
        step *= 2


def longest_repeats(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each place the words of the longest substring that starts there and occurs elsewhere in the document."""
    n = len(codes)
    ranks = suffix_ranks(codes, doc)
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n + 1, np.int64)  # with the suffix before; none for the first and the last
    live = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b, lcp = a[live], b[live], np.zeros(len(live), np.int64)
    ends = np.searchsorted(doc, doc, side="right")
    for level in range(len(ranks) - 1, -1, -1):
        on = np.flatnonzero((a + lcp < n) & (b + lcp < n))
        x, y = a[on] + lcp[on], b[on] + lcp[on]
        inside = (x < ends[a[on]]) & (y < ends[b[on]])
        on, x, y = on[inside], x[inside], y[inside]
        lcp[on[ranks[level][x] == ranks[level][y]]] += 1 << level
    common[live + 1] = lcp
    found = np.empty(n, np.int64)
    found[order] = np.maximum(common[:-1], common[1:])
    return found, ranks


def covered(length: np.ndarray) -> np.ndarray:
    """Places under a span [i, i + length[i])."""
    at = np.arange(len(length))
    return np.maximum.accumulate(at + length, axis=0) > at if len(length) else np.zeros(0, bool)


def _measure(batch: pa.RecordBatch, rules: Rules) -> pa.RecordBatch:
    texts = texts_of(batch)
    codes, bounds, words = words_of(texts)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), n_words)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    line = lines.indices.to_numpy(zero_copy_only=False)
    worded = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line]
    line_doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[worded]
    first = np.unique(line_doc * (len(lines.dictionary) + 1) + line[worded])
    n_dup = np.bincount(line_doc, minlength=len(texts)) - np.bincount(first // (len(lines.dictionary) + 1), minlength=len(texts))

    n_repeat, n_covered, longest = (np.zeros(len(texts), np.int64) for _ in range(3))
    if len(codes):
        length, ranks = longest_repeats(codes, doc)
        # A window of three words is found twice exactly where a repeat of three or more starts.
        n_repeat = sums(covered(np.where(length >= 3, 3, 0)), bounds)
        long = np.where(length >= rules.least_repeat, length, 0)
        n_covered = sums(covered(long), bounds)
        np.maximum.at(longest, doc, long)
    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    too_long = (longest > rules.longest_words) & (100 * longest > rules.longest_percent * n_words)
    kept = ~failed & (100 * n_covered <= rules.covered_percent * n_words) & ~too_long
    out = {"n_words": n_words, "word_chars": sums(chars[codes], bounds), "n_symbols": sums(symbols[codes], bounds), "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "n_covered_words": n_covered, "longest_repeat": longest, "kept": kept}
    return pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, *(pa.array(x) for x in out.values())], names=[*(c for c in batch.schema.names if c != "text"), *out])


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_covered_words bigint, longest_repeat bigint, kept boolean"


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """A row for each row of docs: doc_id and the measures; whole texts, no shuffle.

    A null or empty text has no words and fails the base rules. Repeated rows and null ids stay as they are; columns but
    doc_id and text are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _measure(batch, rules)

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, {MEASURES}")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The rows and columns of docs that the rules keep; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            measured = _measure(pa.RecordBatch.from_arrays([batch.column("text")], names=["text"]), rules)
            yield batch.filter(measured.column("kept"))

    tune(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
