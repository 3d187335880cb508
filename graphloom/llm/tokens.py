"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of a byte-level BPE; any file of that form will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer parts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """The text with what UTF-8 can't hold replaced."""
    return text.encode("utf-8", "replace").decode("utf-8")


def with_sizes(df: DataFrame, text: str, out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """df with `out`, the tokens of `text` instead of the text; 0 for a null or empty one. Blanks count as the tokenizer counts them."""
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32())], names=[*rest, out])

    return df.select(*rest, F.col(text)).mapInArrow(run, schema)
