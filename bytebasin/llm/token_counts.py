"""Token counts without shuffling a pre-token.

Two tiers of lookup on the map side: a compact table of the lengths of frequent pre-tokens goes to every executor once,
and a worker encodes what is not in it through its own bounded cache.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import give_back, kept
from bytebasin.llm.word_bpe import WordEncoder, chunks

#: The first tier is learnt from so many rows at most, and holds so many pre-tokens; neither changes a count.
SAMPLE_ROWS, TABLE_SIZE = 1000, 32_768


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE) -> tuple[str, bytes]:
    """The most frequent pre-tokens of a bounded sample, joined by line breaks, and their lengths in ids, a byte each.

    The table speeds up counting and never decides a count, so a sample does: about ``sample_rows`` rows, taken from all
    over the table. Pre-tokens are counted by task and summed up by Spark; at most ``table_size`` are kept (under 1 MB).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch[text]:
                seen.update(c for c in chunks(t or "") or [] if c.isalpha())
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})
        give_back()

    share = min(1.0, sample_rows / max(1, docs.count()))
    counts = docs.select(text).sample(share, seed=1).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(table_size).collect()]
    sizes: dict[str, int] = {}
    encoder = WordEncoder(path, value=len)
    encoder.learn(words, sizes)
    return "\n".join(words), bytes(min(255, sizes[w] // encoder.dtype.itemsize) for w in words)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``docs`` with UTF-8 bytes, token count and whether the count is over ``limit``, in columns ``names``.

    A null or empty text has 0 bytes and 0 tokens. Columns of ``docs`` by these names are replaced; all others, and
    repeated rows, stay. An empty table gives an empty table. No shuffle but that of the bounded sample.
    """
    words, sizes = frequent_lengths(docs, path, text)
    key = uuid.uuid4().hex
    table = docs.sparkSession.sparkContext.broadcast((words, sizes))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def make() -> WordEncoder:
            words, sizes = table.value
            known = {w: n for w, n in zip(words.split("\n"), sizes) if 0 < n < 255}
            encoder = WordEncoder(path, known, join=sum)
            encoder.value = lambda raw: len(raw) // encoder.dtype.itemsize
            return encoder

        encoder = kept(("counts", path, key), make)
        for batch in batches:
            yield pd.Series([sum(p) for p in encoder.pieces(batch.tolist())], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    n_bytes, n_tokens, over = names
    out = docs.withColumn(n_tokens, count(whole)).withColumn(n_bytes, F.octet_length(whole).cast("long"))
    return out.withColumn(over, F.col(n_tokens) > limit)
