"""Token counts of whole texts by batched encoding.

A task reads its rows' UTF-8 bytes from Arrow buffers, cuts long texts into pieces at safe boundaries
and encodes pieces in batches of about BATCH_BYTES, so that a batch costs the same whether it holds a
thousand short texts or a part of a long one. Only lengths leave the batch; a text's count is the sum
over its pieces. Rows stay where they lie: there is no shuffle and no state across batches.

A cut is safe where the tokenizer's own split of a text into words always ends a word: before ASCII
white space that follows a character that no version of Unicode calls white space, and before common
punctuation that follows a letter or digit. The vocabulary's special string holds no such place. Text
without one (a million letters on end) is encoded whole.

Counts are those of the tokenizers library on the `vocabulary` file, no special tokens added, its special
string inside a text being one token. The encoder is packing's, whose ids equal that library's.

Defined cases: null text counts as empty, 0 bytes and 0 tokens; repeated rows and null ids are counted
each; texts of any length are counted whole; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import buffers
from florilege.llm.packing import encoder

BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16  # longer texts are cut
LIMIT = 1024
SAFE = re.compile(
    # ASCII; two bytes from U+00C0; three bytes U+0800-0FFF, kana and after, U+4000-D7FF
    rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=[\xe0\xe4-\xed][\x80-\xbf]{2})|(?<=\xe3[\x81-\xbf][\x80-\xbf]))(?=[ \t\n\r])"
    # a Latin letter or digit before a point or comma; an ideograph (U+5000-8FFF) before U+3001, 3002, FF0C
    rb"|(?<=[0-9A-Za-z])(?=[.,;:!?])|(?<=[\xe5-\xe8][\x80-\xbf]{2})(?=\xe3\x80[\x81\x82]|\xef\xbc\x8c)"
)


def pieces(data: memoryview, start: int, end: int, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of the pieces of data[start:end], each of about limit bytes, or as long as it takes to reach a safe boundary."""
    while end - start > limit:
        found = SAFE.search(data, start + limit, end)
        if not found:
            break
        yield start, found.start()
        start = found.start()
    yield start, end


def _counts(vocabulary: str, limit: int):
    def run(batches):
        count = encoder(vocabulary)
        for b in batches:
            data, offs = buffers(b.column(1))
            tokens = np.zeros(b.num_rows, np.int64)
            view, held, size = memoryview(data), [], 0

            def encode(held, view=view, tokens=tokens):
                lengths = [len(count(str(view[s:e], "utf-8"))) for _, s, e in held]
                np.add.at(tokens, [row for row, _, _ in held], lengths)

            for row in range(b.num_rows):
                for s, e in pieces(view, int(offs[row]), int(offs[row + 1])):
                    held.append((row, s, e))
                    size += e - s
                    if size >= BATCH_BYTES:
                        encode(held)
                        held, size = [], 0
            if held:
                encode(held)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_counts(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
