"""Token counts: batches balanced by bytes, long texts split at safe boundaries, and only lengths leave the task.

An Arrow batch is cut into slices of a few megabytes of text; a text above that is cut where a unit ends, which no token
spans, and its pieces are counted one after the other. See ``tokens`` for how a slice is
encoded.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Special strings inside texts are handled as the library
does by default. Null ids and repeated rows are kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dealsift.llm import textkit as T, tokens
from dealsift.llm.tables import documents


def count(docs: DataFrame, path: str, limit: int = 1024, slice_bytes: int = T.SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row."""
    def run(batches):
        encoder = tokens.library(path)
        for batch in batches:
            for part in T.slices(batch, limit=slice_bytes):
                texts = part.column("text")
                n_bytes = np.diff(T.flat(texts)[1])
                if len(part) == 1 and n_bytes[0] > slice_bytes:
                    pieces = tokens.cut_long(texts[0].as_py().encode(), slice_bytes, encoder.special)
                    n = np.array([sum(int(tokens.lengths(pa.array([p.decode()]), encoder)[0]) for p in pieces)])
                else:
                    n = tokens.lengths(texts, encoder)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array(n > limit)})

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
