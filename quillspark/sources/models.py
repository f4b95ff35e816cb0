"""Outside models as plain callables: embedders, recognisers and language models.

Nothing here downloads or trains; a caller passes the model in, tests pass a stub.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calls, text


def embed(model, prefix: str = "passage: ", batch: int = 64):
    """Arrow function text -> unit vector for ``model(list of texts) -> matrix``, called in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(c: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(c), batch):
            v = np.asarray(model([prefix + (t or "") for t in c.iloc[i : i + batch]]), np.float32)
            out += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
        return pd.Series(out, index=c.index, dtype=object)

    return run


def hashed_embedder(dim: int = 64):
    """A stand-in embedder: hashed character trigrams."""

    def model(texts):
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for j in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[j : j + 3].encode(), digest_size=4).digest(), "little")
                out[i, h % dim] += 1 - 2 * (h >> 31)
        return out

    return model


def prompt(template: str, transcript: Column | str, heading: str = "=== Transcript ===") -> Column:
    """The template with its {transcript} filled, or the text behind it under a heading."""
    c = F.coalesce(text.col(transcript), F.lit(""))
    if "{transcript}" in template:
        before, after = template.split("{transcript}", 1)
        return F.concat(F.lit(before), c, F.lit(after))
    return F.concat(F.lit(template.rstrip() + f"\n\n{heading}\n"), c)


def complete(df: DataFrame, client, prompt_col: str = "prompt", concurrency: int = 2) -> DataFrame:
    """df with ``reply`` and ``error`` of ``client(prompt) -> text``; as many calls at once as partitions."""
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for b in batches:
            replies, errors = [], []
            for p in b[prompt_col]:
                try:
                    replies.append(client(p))
                    errors.append(None)
                except Exception as e:  # a failed call is a row's error, not the job's
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(reply=replies, error=errors)

    return df.repartition(concurrency).mapInPandas(run, schema)


def parsed_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df with ``human``, ``call`` (struct) and ``error`` of each reply."""
    t = df.withColumn("__q_parts", calls.reply_parts(reply))
    bad = calls.reply_error("__q_parts.json")
    t = t.withColumn("human", F.col("__q_parts.human")).withColumn("call", F.from_json(calls.json_candidate("__q_parts.json"), calls.CALL_SCHEMA))
    kept = F.coalesce(F.col("error"), bad) if "error" in df.columns else bad
    return t.withColumn("error", kept).drop("__q_parts")
