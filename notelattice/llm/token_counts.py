"""Token counts from pieces per distinct pre-token.

Each task splits its texts into pre-tokens as byte-level BPE does, counts the pieces of every
distinct pre-token once with the tokenizers library (a bounded table per worker), joins these counts
to the documents' pre-token frequencies and sums. No token ids are made, and nothing is shuffled.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a text count as
one token each, which is the library's default; equal rows get equal counts; a text longer than a block
is taken whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_type, map_arrow, text_blocks

#: Fixed value: the split of byte-level BPE, which the model file names by "use_regex".
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's table of pieces; when full it is emptied, which costs time only.
KNOWN = 250_000
LIMIT = 512


class PieceTable:
    """Pieces of pre-tokens, each counted once while it stays in the table."""

    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(PRE_TOKEN)
        self.known, self.limit = {}, known

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies, and the special strings, which count by themselves."""
        if self.special is None or not self.special.search(text):
            return Counter(self.split.findall(text)), 0
        parts = self.special.split(text)
        freq: Counter = Counter()
        for part in parts:
            freq.update(self.split.findall(part))
        return freq, len(parts) - 1

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.limit:
            self.known = {}
        for token, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[token] = len(e)

    def counts(self, texts: list[str]) -> list[int]:
        freqs = [self.frequencies(t) for t in texts]
        wanted = dict.fromkeys(t for f, _ in freqs for t in f)
        missing = [t for t in wanted if t not in self.known]
        if missing:
            if len(self.known) + len(missing) > self.limit:
                missing = list(wanted)
            self.learn(missing)
        known = self.known
        return [n + sum(known[t] * k for t, k in f.items()) for f, n in freqs]


_TABLES: dict[str, PieceTable] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document under the tokenizer at `path`."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens")), T.StructField("over_limit", T.BooleanType())])

    id_type = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TABLES.get(path) or _TABLES.setdefault(path, PieceTable(path))
        for ids, texts in text_blocks(batches):
            counts = table.counts(texts)
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)
