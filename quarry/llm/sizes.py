"""Token counts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.core.runtime import process_cache

#: Folder of the public vocabulary files, on every executor.
VOCABULARY = os.environ.get("QUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Long texts are encoded in pieces of about so many letters.  A piece ends before white space that
#: follows other letters, where the encoding splits anyway, so counts add up to those of the whole.
_STRIDE = 50_000
_BREAK = re.compile(r"(?<=\S)(?=\s)")


def encoder(path: str):
    """The encoding of a rank file, loaded once per process."""
    cache = process_cache()
    if ("encoder", path) in cache:
        return cache["encoder", path]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    cache["encoder", path] = tiktoken.Encoding("corpus", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return cache["encoder", path]


def count(text: str, path: str) -> int:
    enc = encoder(path)
    n = at = 0
    while at < len(text):
        stop = _BREAK.search(text, at + _STRIDE) if len(text) > at + _STRIDE else None
        end = stop.start() if stop else len(text)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_sizes(rows: DataFrame, key: str, text: str, keep: tuple = (), path: str = VOCABULARY) -> DataFrame:
    """``(key, *keep, size)``: tokens of each text; null texts count 0."""

    def run(it):
        for b in it:
            sizes = [count(t, path) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], [*b.schema.names[:-1], "size"])

    x = rows.select(key, *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema[:-1]) + ", size long"
    return x.mapInArrow(run, schema)
