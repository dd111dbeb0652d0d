"""Token counts by the whole-token shortcut.

A piece-BPE model never merges over a boundary that no vocabulary string spans. The counter
proves that from the vocabulary, once, before any text is read: no piece has the space mark
after another character, and none holds a line feed. So a text's count is the sum over its
pre-tokens (a run of spaces with the characters after it), each line apart. It also encodes
every vocabulary string alone; those that come back as one token form the shortcut table and
count as 1 without merging. Only other pre-tokens are merged by the library, and their counts
are kept in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Counts of merged pre-tokens that a worker keeps; beyond it the table starts anew.
MEMO_ENTRIES = 400_000


class _Counts(dict):
    """Pre-token -> number of tokens; what the shortcut lacks is merged by the library."""

    def __init__(self, whole: dict[str, int], prefix: str, merge):
        super().__init__(whole)
        self.whole, self.prefix, self.merge = whole, prefix, merge

    def __missing__(self, word: str) -> int:
        n = self.merge(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= MEMO_ENTRIES + len(self.whole):
                self.clear()
                self.update(self.whole)
            self[word] = n
        return n


class WholeTokenCounter:
    """Counts tokens as the sentencepiece library does, without begin and end tokens."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.splits = not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        self.newline = len(self.model.encode("\n"))
        #: As the model is BPE with an identity normaliser, a line feed is a token (or a
        #: few byte tokens) of its own, behind the mark that opens every text.
        self.splits = self.splits and len(self.model.encode("\na")) == self.newline + 1 and self.model.encode("a  b \n ") != self.model.encode("a b")
        lead, bare = {}, {}
        if self.splits:
            for p in pieces:
                text = p.replace(MARK, " ")
                if text and self.merge(text) == 1:
                    if text[0] == " " and text[1:] and text[1] != " ":
                        lead[text[1:]] = 1
                    elif text[0] != " ":
                        bare[text] = 1
        self.lead, self.bare = _Counts(lead, " ", self.merge), _Counts(bare, "", self.merge)

    def merge(self, chunk: str) -> int:
        """Tokens of a chunk inside a text: behind a line feed no mark is put before it."""
        return len(self.model.encode("\n" + chunk)) - self.newline

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        n, lead = 0, self.lead
        for i, line in enumerate((" " + text).split("\n")):
            if i:
                n += self.newline - 1
            if not line:
                continue
            if "  " in line or line[-1] == " ":
                for run, word in re.findall("( *)([^ ]*)", line)[:-1]:
                    n += lead[word] if len(run) == 1 and word else self.merge(run + word) if run else self.bare[word]
                continue
            words = line.split(" ")
            if words[0]:
                n += self.bare[words[0]]
            del words[0]
            n += sum(map(lead.__getitem__, words))
        return n


@lru_cache(2)
def counter(model_file: str) -> WholeTokenCounter:
    """One for each worker process."""
    return WholeTokenCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs, in no order: its id, n_bytes (UTF-8), n_tokens and
    over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted
    like any other row. Other columns are not read. No shuffle: each task counts the texts
    of its own partition, whole, one record batch at a time."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            n = [c.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
