"""Token counts by overlap resynchronisation (see bpe.py for how chunks are spliced)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CHUNK, OVERLAP, encoder
from .common import pick, slices, utf8


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row, in one pass without a shuffle.

    tokenizer: a tokenizers .json file that every executor can read. A null text counts as empty, with 0 bytes and 0
    tokens; a null id stays null; repeated rows each give a row; no rows give none. Texts longer than `chunk`
    characters are encoded in chunks that overlap by `overlap` characters and more where needed.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).fill_null("")
                _, bounds = encode(texts.to_pylist(), chunk, overlap)
                _, offsets = utf8(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(bounds).astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
