"""Spelling variants: words one edit apart, by dynamic programming over sorted word lists.

Two words one edit apart share the first half of the shorter one or, if the edit lies there, its last half. So words are
dealt out by half (forwards, and spelt backwards), and each block of a half is a sorted list. All words of the block go
down the list together, each with the three cells of an edit-matrix row that one edit can reach. The rows after each
code point are kept, so that the next word of the list starts from the rows at its common prefix with the last; words that
are beyond one edit are left behind on the way, and list words below a prefix that no other word reaches are skipped.

A block of very many words is split: its list by the next code point, again until blocks are small; the words to be
compared go to those parts only whose prefix they can reach by one edit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, partitions, slices, texts_of, tune, words_of

LETTERS = 6
OCCURRENCES = 5
RATIO = 5
#: A run whose checksum this divides loses a code point.
DAMAGED = 199
#: List words of a block beyond which it's split.
BLOCK = 20_000

_FAR = 9


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        runs = pc.ascii_lower(pc.replace_substring_regex(texts_of(batch), "[^A-Za-zÀ-ÿ]+", " "))
        codes, bounds, words = words_of(runs)
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        long = length[codes] >= LETTERS
        pairs, times = np.unique(doc[long] * len(words) + codes[long], return_counts=True)
        doc, code = np.divmod(pairs, max(len(words), 1))
        ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
        begun = [zlib.crc32(f"{x}:".encode()) for x in ids]
        spelt = words.cast(pa.binary()).to_pylist()
        crc = zlib.crc32
        h = np.fromiter((crc(spelt[w], begun[d]) for d, w in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(doc))
        hit = h % DAMAGED == 0
        n = np.bincount(code[~hit], weights=times[~hit], minlength=len(words)).astype(np.int64)
        found = np.flatnonzero(n)
        names, values = words.take(pa.array(found)).to_pylist(), n[found].tolist()
        for w, x, many in zip(code[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
            word = spelt[w].decode()
            if len(word) > LETTERS:
                at = x % len(word)
                names.append(word[:at] + word[at + 1 :])
                values.append(many)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): words of at least six code points and their occurrences, if these are enough. Counted in each slice of texts before rows are shuffled."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _blocks(words: DataFrame) -> DataFrame:
    """A row for each word, direction and half: backwards, half (code points), block (a prefix of text), text (the word in its direction), n, listed, asking.

    A word of even length is also there under the half of words one shorter.
    """
    length = F.length("word")
    halves = F.array_distinct(F.array(F.floor(length / 2).cast("int"), F.floor((length - 1) / 2).cast("int")))
    ways = F.array(F.struct(F.lit(False).alias("backwards"), F.col("word").alias("text")), F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("text")))
    each = words.select("n", F.explode(ways).alias("way"), halves.alias("halves")).select("n", "way.*", F.explode("halves").alias("half"))
    return each.select("backwards", "half", F.col("text").substr(F.lit(1), F.col("half")).alias("block"), "text", "n", F.lit(True).alias("listed"), F.lit(True).alias("asking"))


def _split(rows: DataFrame, most: int) -> DataFrame:
    """Split blocks of more than `most` list words until there are none."""
    key = ["backwards", "half", "block"]
    while True:
        large = materialize(rows.where("listed").groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n"))
        if large.isEmpty():
            return rows
        hot = rows.join(large, key, "left_semi")
        deeper = F.col("text").substr(F.lit(1), F.length("block") + 1)
        listed = hot.where("listed").select("backwards", "half", F.col("block"), deeper.alias("part"), "text", "n")
        parts = listed.select(*key, "part").distinct()
        length = F.length("part")
        near = [F.levenshtein(F.col("text").substr(F.lit(1), length + i), F.col("part"), 1) >= 0 for i in (-1, 0, 1)]
        asking = hot.where("asking").join(parts, key).where(near[0] | near[1] | near[2])
        own = listed.select("backwards", "half", F.col("part").alias("block"), "text", "n", F.lit(True).alias("listed"), F.lit(False).alias("asking"))
        others = asking.select("backwards", "half", F.col("part").alias("block"), "text", "n", F.lit(False).alias("listed"), F.lit(True).alias("asking"))
        rows = materialize(rows.join(large, key, "left_anti").union(own).union(others))


def _codes(words: list[str]) -> list[list[int]]:
    return [[*map(ord, w)] for w in words]


def near_pairs(listed: list[str], asking: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in asking, in listed) of all words exactly one edit apart. listed is sorted and has no word twice."""
    most = max(map(len, asking), default=0)
    cells = np.full((len(asking), most + 4), -1, np.int32)  # a word's code point j is in column j + 1
    for row, word in zip(cells, _codes(asking), strict=True):
        row[1 : len(word) + 1] = word
    lengths = np.fromiter(map(len, asking), np.int64, len(asking))
    everyone = np.arange(len(asking))
    # The words still within one edit after each code point of the list's word, and their cells before, on and after the diagonal.
    stack = [(everyone, np.full(len(asking), _FAR), np.zeros(len(asking), np.int64), np.ones(len(asking), np.int64))]
    out_a, out_b, before, both = [], [], [], set(listed) <= set(asking)
    for place, word in enumerate(_codes(listed)):
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        before = word
        del stack[shared + 1 :]
        for depth in range(len(stack) - 1, len(word)):
            own, left, on, right = stack[-1]
            if len(own) <= both:  # none but the word itself comes this far
                break
            c = word[depth]
            differs = cells[own, depth : depth + 3] != c
            new_left = np.minimum(left + differs[:, 0], on + 1)
            new_on = np.minimum(np.minimum(on + differs[:, 1], right + 1), new_left + 1)
            new_right = np.minimum(right + differs[:, 2], new_on + 1)
            alive = np.minimum(np.minimum(new_left, new_on), new_right) <= 1
            stack.append((own[alive], new_left[alive], new_on[alive], new_right[alive]))
        if len(stack) == len(word) + 1:
            own, left, on, right = stack[-1]
            off = lengths[own] - len(word)
            last = np.where(off == 0, on, np.where(off == -1, left, np.where(off == 1, right, _FAR)))
            hit = own[last == 1]
            out_a.append(hit)
            out_b.append(np.full(len(hit), place))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64),) * 2


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a block: its near words there, how many, and the most frequent. Rows come sorted by block and text."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out: list[tuple] = []

    def done() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["word", "n_near", "form_n", "form"])

    for (backwards, half, block), group in groupby(rows, key=lambda r: r[:3]):
        own = list(group)
        if len(own) == 1:
            continue
        way = -1 if backwards else 1
        asking, listed = [r for r in own if r[6]], [r for r in own if r[5]]
        a, b = near_pairs([r[3][half:] for r in listed], [r[3][half:] for r in asking])
        best: dict[int, tuple] = {}
        for i, k in zip(a.tolist(), b.tolist(), strict=True):
            word, other = asking[i][3], listed[k][3]
            if min(len(word), len(other)) // 2 != half or backwards and word[::-1][:half] == other[::-1][:half]:
                continue  # the pair belongs to another block
            n, order, form = best.get(i, (0, None, None))
            mine = (-listed[k][4], other[::way])
            best[i] = (n + 1, *min((order, form), mine)) if n else (1, *mine)
        out += [(asking[i][3][::way], n, -order, form) for i, (n, order, form) in best.items()]
        if len(out) > 50_000:
            yield done()
            out = []
    yield done()


def variants(docs: DataFrame, occurrences: int = OCCURRENCES, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """A row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; a run whose crc32, after its document's id and
    a colon, is a multiple of 199 loses one code point. Words with at least six code points and enough occurrences count.
    form is the near word (one code point inserted, deleted or replaced) with the largest n, the smallest in code-point
    order of these, if it has `ratio` times the word's occurrences; root is where following forms ends. Null texts have no
    words, a null doc_id counts as an empty one; repeated rows count each; other columns are ignored; no word, no row.
    """
    words = materialize(vocabulary(docs, occurrences))
    rows = _split(_blocks(words), block)
    dealt = rows.repartition(partitions(docs.sparkSession), "backwards", "half", "block").sortWithinPartitions("backwards", "half", "block", "text")
    found = dealt.mapInArrow(_best, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    placed = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    placed = materialize(placed)
    return placed.join(_ends(placed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(placed: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form. Forms have several times the word's occurrences, so chains are short; each round doubles what is followed."""
    links = materialize(placed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = links.join(onward, "root", "left")
        if further.where("next IS NOT NULL").isEmpty():
            return links
        links = materialize(further.select("word", F.coalesce("next", "root").alias("root")), instead_of=links)
