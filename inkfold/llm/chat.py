"""Chat formatting by token-level assembly.

Each segment, a turn's role or text, is encoded by itself; the reserved ids of the marks are spliced in between, so no text
can ever make a mark. The loss mask is the prefix sum of +1 where a trained text begins and -1 where it ends. The
formatted text writes the marks out; control strings that occur in a role or text are escaped in it reversibly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import partitions, tune


@dataclass(frozen=True)
class Template:
    """Marks around a conversation, a role and a text. Each is one reserved id, from `first_id` in this order.

    A mark begins with a character that no mark holds further on; that makes the escapes unambiguous.
    """

    begin: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    first_id: int = 50257
    trained: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.role, self.text, self.end)

    def __post_init__(self):
        heads = {m[0] for m in self.marks}
        if any(len(m) < 2 or set(m[1:]) & (heads | {"\\"}) or m[0] == "\\" for m in self.marks):
            raise ValueError("a mark's first character must not occur further on in a mark, and none may hold a backslash")

    def escape(self, text: str) -> str:
        """One more backslash after the first character of each mark, and of each mark that has such backslashes."""
        return self._pattern("*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._pattern("+").sub(lambda m: m[0][0] + m[0][2:], text)

    def _pattern(self, many: str) -> re.Pattern:
        return re.compile("|".join(re.escape(m[0]) + r"\\" + many + re.escape(m[1:]) for m in self.marks))


def _turns(template: Template, path: str):
    """Rows come sorted by conversation and turn; a conversation may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True  # in a text their strings are text
        begin, role_mark, text_mark, end = range(template.first_id, template.first_id + 4)
        last: object = run  # no conversation's id
        turn = at = 0
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            texts = [template.escape(x or "") for x in batch.column("text").to_pylist()]
            roles = [x or "" for x in batch.column("role").to_pylist()]
            known = {r: (escaped := template.escape(r), tokenizer.encode(escaped, add_special_tokens=False).ids, r in template.trained) for r in set(roles)}
            named = [known[r] for r in roles]
            ids = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            heads, turns, firsts, segments = [], [], [], []
            for conv, (_, role_ids, _), own in zip(convs, named, ids, strict=True):
                heads.append(conv != last)
                if conv != last:
                    last, turn, at = conv, 0, 0
                    segments.append((begin,))
                segments += [(role_mark,), role_ids, (text_mark,), own, (end,)]
                turns.append(turn)
                firsts.append(at)
                turn, at = turn + 1, at + heads[-1] + 3 + len(role_ids) + len(own)
            size = np.array([h + 3 + len(n[1]) + len(own) for h, n, own in zip(heads, named, ids, strict=True)], np.int64)
            ends = np.cumsum(size)
            step = np.zeros(int(size.sum()) + 1, np.int8)
            trained = np.flatnonzero([n[2] for n in named])
            text_size = np.array([len(own) for own in ids], np.int64)[trained]
            np.add.at(step, ends[trained] - 1 - text_size, 1)
            np.add.at(step, ends[trained] - 1, -1)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            flat = pa.array(np.fromiter(chain.from_iterable(segments), np.int32, int(size.sum())))
            mask = pa.array(np.cumsum(step[:-1], dtype=np.int8))
            formatted = [(template.begin if h else "") + template.role + n[0] + template.text + text + template.end for h, n, text in zip(heads, named, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(turns, pa.int64()), pa.array(firsts, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, mask), pa.array(formatted, pa.string())],
                names=["conv_id", "turn_no", "first_token", "ids", "mask", "formatted"],
            )

    return run


def format_conversations(conversations: DataFrame, path: str, template: Template = Template()) -> DataFrame:  # noqa: B008
    """A row for each turn, those of a conversation together and in order: conv_id, turn_no, first_token, ids, mask, formatted.

    conversations: conv_id, turn, role, text. Turns are ordered by turn, nulls first, then role and text; repeated rows are
    turns of their own. Null roles and texts are empty; null ids are one conversation. ids of a conversation's rows, put
    together, are its tokens; first_token is where a turn's begin. mask is 1 on the tokens of texts to train on.
    A turn is a row, so no conversation is ever gathered in memory. Other columns are ignored.
    """
    tune(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_turns(template, path), "conv_id bigint, turn_no bigint, first_token bigint, ids array<int>, mask array<tinyint>, formatted string")


def _read(template: Template, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        low = template.first_id
        for batch in batches:
            n, lists, masks = batch.num_rows, batch.column("ids"), batch.column("mask")
            ids, mask = lists.flatten().to_numpy(zero_copy_only=False), masks.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            role, text, end = (np.flatnonzero(ids == low + k) for k in (1, 2, 3))  # one of each in a row
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
            low_edge, high_edge = edges[::2], edges[1::2]  # no row ends under the mask
            cuts = [*zip((role + 1).tolist(), text.tolist(), strict=True), *zip((text + 1).tolist(), end.tolist(), strict=True), *zip(low_edge.tolist(), high_edge.tolist(), strict=True)]
            # Equal segments are decoded once: a role occurs in many rows, and a trained text is also its row's text.
            number: dict[bytes, int] = {}
            places = [number.setdefault(ids[a:b].tobytes(), len(number)) for a, b in cuts]
            told = [template.unescape(x) for x in tokenizer.decode_batch([np.frombuffer(x, ids.dtype).tolist() for x in number], skip_special_tokens=False)]
            loss = [""] * n
            for row, place in zip(np.searchsorted(ends, low_edge, side="right").tolist(), places[2 * n :], strict=True):
                loss[row] += told[place]
            cols = {"role": [told[p] for p in places[:n]], "text": [told[p] for p in places[n : 2 * n]], "loss_text": loss}
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_no"), *(pa.array(x, pa.string()) for x in cols.values()), batch.column("formatted")], names=["conv_id", "turn_no", *cols, "formatted"])

    return run


def read_back(formatted: DataFrame, path: str, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, turn_no, role, text, loss_text, formatted: what the ids and the mask of each turn say, unescaped. Rows stay in order."""
    return formatted.mapInArrow(_read(template, path), "conv_id bigint, turn_no bigint, role string, text string, loss_text string, formatted string")
