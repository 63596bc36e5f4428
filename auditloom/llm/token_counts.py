"""Token counts of whole texts: the tokenizers library over Arrow batches, lengths only.

A text is cut where white space begins after something else. The tokenizers handled here never form a token, or look
ahead, across such a place, so the counts of the pieces add up to the count of the text whatever its length. Pieces
are encoded in batches of equal bytes, and short ones are remembered.

Defined cases: a null text is empty and has no tokens; repeated rows give repeated results; special strings inside a
text are handled as the tokenizer's default does.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import WHITE_SPACE, Memo, byte_slices, texts

#: A run of white space with what follows it, or white space at the end.
PIECES = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a worker; one thread, as Spark runs a worker for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def length_memo(path: str) -> Memo:
    encode = tokenizer(path).encode_batch_fast
    return Memo(lambda pieces: list(map(len, encode(pieces, add_special_tokens=False))))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = length_memo(path)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            counts: list[int] = []
            for lo, hi in byte_slices(bodies):
                counts += map(sum, memo.lookup([PIECES.findall(t) for t in bodies[lo:hi]]))
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(batch.column(1)), pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
