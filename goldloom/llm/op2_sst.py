"""Query op2: the whole documents table as token-id shards, read back."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.llm.common import arrow_batches, table
from goldloom.llm.pieces import Pieces
from goldloom.llm.sstable import new_folder, read_shards, write_shards

VOCABULARY = "byte_bpe_50k.json"
_known: dict[str, Pieces] = {}


def library_encoder(path: str):
    """Encodes with the tokenizers library, remembering pieces of texts; one per Python worker."""

    def make() -> Pieces:
        if path not in _known:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _known[path] = Pieces(joined_encoder(tokenizer), special=[t.content for t in tokenizer.get_added_tokens_decoder().values()])
        return _known[path]

    return make


def joined_encoder(tokenizer, together: int = 200):
    """Encodings of texts. Those that hold one space, their first character, are encoded as long joined texts, which the library
    does in a third of the time; a token that begins with a space then begins a text."""
    vocabulary = tokenizer.get_vocab()
    spaced = np.zeros(max(vocabulary.values()) + 1, bool)
    spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
    ids_of = lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        if len(texts) < 2 or not all(t[:1] == " " and t.count(" ") == 1 for t in texts):
            return [i.tobytes() for i in ids_of(texts)]
        groups, out = [texts[k : k + together] for k in range(0, len(texts), together)], []
        for group, ids in zip(groups, ids_of(["".join(g) for g in groups])):
            starts = np.flatnonzero(spaced[ids]).tolist()
            if len(starts) != len(group) or starts[0]:
                out += [i.tobytes() for i in ids_of(group)]
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(starts, [*starts[1:], len(ids)])]
        return out

    return encode


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(docs)
    shards = write_shards(docs, folder, library_encoder(public_tokenizers.path(VOCABULARY)))
    # Every id is below 2**32, so a shard's bytes are the ids' as the check sum wants them.
    return read_shards(shards, folder).select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))
