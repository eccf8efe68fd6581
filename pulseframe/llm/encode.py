"""Encoding tables of texts with the transducer lexicon (see ``bpe``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.bpe import LEXICON_WORDS, Rules, batches_of, codec, frequent_words, lexicon_file
from pulseframe.llm.tables import text_or_empty
from pulseframe.session import ship_package


def prepared(df: DataFrame, tokenizer: str, text_col: str, lexicon_words: int = LEXICON_WORDS):
    """Tokenizer file and compiled lexicon of ``df``'s frequent words, sent to
    the tasks once: both are bounded, by the vocabulary and ``lexicon_words``."""
    ship_package(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    return df.sparkSession.sparkContext.broadcast((spec, lexicon_file(Rules(spec), frequent_words(df, text_col, lexicon_words))))


def encode_map(df: DataFrame, tokenizer: str, keep: list[str], text_col: str, finish, schema: str,
               lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Columns ``keep`` and those that ``finish(codec, ids of a batch)`` makes
    (a list of Arrow arrays, ``schema``)."""
    tables = prepared(df, tokenizer, text_col, lexicon_words)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        c = codec(*tables.value)
        for b in batches:
            texts = b.column("__text").to_pylist()
            for s in batches_of(texts):
                ids = c.encode(texts[s])
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *finish(c, ids)], names=[*keep, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
    return df.select(*keep, text_or_empty(text_col).alias("__text")).mapInArrow(run, kinds + schema)


def _id_lists(ids: list[bytes]) -> pa.Array:
    import numpy as np
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``n_tokens`` in place of nothing:
    all columns stay, also ones named alike are replaced."""
    keep = [c for c in df.columns if c not in ("ids", "n_tokens")]
    return encode_map(df, tokenizer, keep, text_col, lambda c, ids: [_id_lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64())],
                      "ids array<int>, n_tokens long", lexicon_words)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of the ids in ``ids_col``."""
    ship_package(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        tokens = df.sparkSession.sparkContext.broadcast(Rules(f.read()).tokens)

    def run(batches):
        for b in batches:
            names = tokens.value
            out = [None if x is None else " ".join(names[i] for i in x) for x in b.column(ids_col).to_pylist()]
            yield b.append_column("decoded", pa.array(out, pa.string()))

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return df.mapInArrow(run, kinds + "decoded string")


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
            lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    import hashlib

    def finish(c, ids):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]),
                pa.array([sha(c.decode(x).encode("utf-8")) for x in ids])]

    docs = df.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return encode_map(docs, tokenizer, [id_col], text_col, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", lexicon_words)
