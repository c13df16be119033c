"""Token counts of texts under a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, path: str, pattern: str | None = None):
        import tiktoken

        if pattern is None:
            import public_tokenizers as P

            pattern = P.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, tokens) of the documents with text, once per doc_id.

    ``cluster`` is the hash of the lower-cased text with its blanks made even, the same for copies.
    Null and empty texts give no row.
    """
    path = vocabulary or default_vocabulary()
    even = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    docs = documents.where(F.length("text") > 0).select("doc_id", "source", F.xxhash64(even).alias("cluster"), "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizer(path)
        for pdf in batches:
            out = pdf[["doc_id", "source", "cluster"]].assign(tokens=[len(t.ids(x)) for x in pdf["text"]])
            yield out

    return docs.mapInPandas(work, "doc_id long, source string, cluster long, tokens int").where("tokens > 0")
