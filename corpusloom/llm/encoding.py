"""Problem 6: the corpus as token ids of a public tokenizer, and back."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import DEFAULT_VOCABULARY, decode, encoder


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>): the ids of each row's text, without special tokens.

    A narrow step: no shuffle, one row out for each row in. Null and empty texts give an empty list,
    repeated rows repeat, a null key stays null, other columns are not read. Strings that look like
    special tokens are ordinary text. ``vocabulary`` is a file that every executor can read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                enc.into(flat, value)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (long), the length of each text's list of ids; 0 for empty and null."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            counts = array("q")
            for value in batch.column(len(keep)).to_pylist():
                ids = array("i")
                enc.into(ids, value)
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(memoryview(counts), pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, f"{fields}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``text``: the text of each list of ids. An empty list gives an empty text, a null list a null one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        merges = encoder(vocabulary).merges
        for batch in batches:
            texts = [None if x is None else decode(merges, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
