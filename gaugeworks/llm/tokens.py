"""Sizes of texts in tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_tokens(text: str = "text") -> Column:
    """Tokens of the byte-level tokenizer, one for each byte of the UTF-8 text; 0 for a null text."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def vocabulary_tokens(path: str, text: str = "text") -> Column:
    """Tokens of a public tokenizer whose JSON file is at ``path`` on every worker; 0 for a null text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count(F.col(text))
