"""Sizes of texts in tokens of a public tokenizer, loaded once per worker."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
_loaded: dict[str, object] = {}


def piece_model(path: str):
    """The sentencepiece model of ``path``, one per process."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def _shipped(name: str):
    """The model that the driver handed to the workers under ``name``, one per worker process."""
    if name not in _loaded:
        import sentencepiece
        from pyspark import SparkFiles

        _loaded[name] = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
    return _loaded[name]


def with_sizes(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER, terms: str | None = None) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of the whole text in ``out``; null and empty texts have 0.

    With ``terms``, also the distinct token ids and how often each occurs, in ``terms`` and ``terms``_tf. ``tokenizer`` is a
    file of the driver, which is handed to the workers, so these need none of their own.
    """
    name = Path(tokenizer).name
    df.sparkSession.sparkContext.addFile(tokenizer)
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = _shipped(name)
        for batch in batches:
            made = batch[keep].copy()
            sizes, ids, counts = [], [], []
            texts = [t or "" for t in batch[text]]
            for at in range(0, len(texts), 512):
                for tokens in model.encode(texts[at : at + 512], num_threads=1):
                    sizes.append(len(tokens))
                    if terms:
                        i, n = np.unique(np.array(tokens, "int32"), return_counts=True)
                        ids.append(i)
                        counts.append(n.astype("int32"))
            made[out] = np.array(sizes, "int64")
            if terms:
                made[terms], made[f"{terms}_tf"] = ids, counts
            yield made

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep) + f"`{out}` long"
    if terms:
        schema += f", `{terms}` array<int>, `{terms}_tf` array<int>"
    return df.select(*keep, text).mapInPandas(run, schema)
