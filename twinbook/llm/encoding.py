"""Problem 6: the whole corpus as ids of a public tokenizer, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinbook.llm.bpe import Bpe, default_vocabulary


@lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    """One encoder a worker process; its memory of pieces is bounded."""
    return Bpe(path)


def _batches(path: str, id_column: str, text: str, lengths_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            keep = [c for i, c in enumerate(b.columns) if b.schema.names[i] != text]
            names = [n for n in b.schema.names if n != text]
            flat: list[int] = []
            ends = [0]
            for t in b.column(b.schema.get_field_index(text)):
                flat.extend(encode(t.as_py()))
                ends.append(len(flat))
            if lengths_only:
                made = pa.array(np.diff(np.array(ends, np.int64)))
                names = [*names, "n_tokens"]
            else:
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays([*keep, made], names=names)

    return run


def encode_texts(documents: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_column`` and ``ids`` (array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; blank texts the tokens of their blanks; strings that look like special tokens
    are ordinary text. Repeated rows stay; an empty table stays empty; other columns are left out. No shuffle.
    """
    schema = f"`{id_column}` {documents.schema[id_column].dataType.simpleString()}, ids array<int>"
    return documents.select(id_column, text).mapInArrow(_batches(vocabulary or default_vocabulary(), id_column, text, False), schema)


def count_tokens(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``columns`` and ``n_tokens`` (bigint) of every row."""
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return documents.select(*columns, text).mapInArrow(
        _batches(vocabulary or default_vocabulary(), columns[0], text, True), f"{fields}, n_tokens bigint"
    )


def decode_ids(encoded: DataFrame, id_column: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``id_column`` and ``text`` of every row of ``ids``; null and empty lists give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for b in batches:
            texts = ["".join(decode(x.as_py() or ())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    schema = f"`{id_column}` {encoded.schema[id_column].dataType.simpleString()}, text string"
    return encoded.select(id_column, "ids").mapInArrow(run, schema)
