"""Byte-level BPE by backtracking.

A pretoken's encoding is found left to right: an Aho-Corasick automaton over all tokens gives the longest
token at a position; it stays if the pair it forms with its left neighbour is compatible, that is, if the
merge rules would never join across or inside that border earlier. Else the next shorter token is tried,
and where none is left the last token is taken back. Each position is given up at most once, which bounds
the work by the length of the text. Decoding copies slices of one byte table through an offset table.

Texts are cut at borders that the pretokenizer always keeps, and the encodings of the cut pieces are
remembered, so a frequent word is encoded once per worker.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import map_batches
from goldloom.llm.pieces import Pieces

#: Fixed value: the pretokenizer of byte-level BPE vocabularies of this family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens and pieces of texts that a worker remembers.
PAIRS, PIECES = 100_000, 250_000


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Encodes and decodes with a vocabulary file of the tokenizers library (byte-level BPE, ids in merge order)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE with the usual pretokenizer and without a normalizer is read")
        letter = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if t not in self.special}
        size = max([*raw, *self.special.values()]) + 1
        self.token = [raw.get(i, b"") for i in range(size)]
        for t, i in self.special.items():
            self.token[i] = t.encode()
        ident = {t: i for i, t in raw.items()}
        self.left, self.right, self.joined = [*range(size)], [*range(size)], {}
        for merge in spec["model"]["merges"]:
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            c = ident[self.token[a] + self.token[b]]
            self.joined[a * size + b] = c
            self.left[c], self.right[c] = a, b
        self.size = size
        self.automaton = ahocorasick.Automaton()
        self.shorter: list[int] = [-1] * size
        for t, i in ident.items():
            self.automaton.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((ident[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ident), -1)
        self.automaton.make_automaton()
        self.longest = max(map(len, ident))
        self.length = [len(t) for t in self.token]
        self.pretokens = regex.compile(PRETOKEN).findall
        self.borders = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.hints = lambda text: any(t in text for t in self.special)
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.compatible: dict[int, bool] = {}
        self.pieces = Pieces(lambda texts: [*map(self._whole, texts)], PIECES, 25_000, special=self.special)
        self.pieces.forgetful.append(self.forget)

    def fits(self, a: int, b: int) -> bool:
        """Whether token a directly before token b can be the outcome of the merge rules."""
        key = a * self.size + b
        known = self.compatible.get(key)
        if known is None:
            known = self._fits(a, b)
            if len(self.compatible) < PAIRS:
                self.compatible[key] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo the later of both tokens' last merges step by step; a rule that joins the inner ends before that merge rules the border out.
        before = self.size
        while True:
            whole = self.joined.get(a * self.size + b)
            if whole is not None and whole < before:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    before, inner = a, self.right[a]
                    if inner != a:
                        a = inner
                        break
                else:
                    before, inner = b + 1, self.left[b]
                    if inner != b:
                        b = inner
                        break
                undo_left = not undo_left
            else:
                return True

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pretoken."""
        text, known, size = piece.decode("latin-1"), self.compatible, self.size
        out: list[int] = []
        for _, token in self.automaton.iter_long(text):
            if out and not (known.get(out[-1] * size + token) or self.fits(out[-1], token)):
                return self._backtrack(text, out, token)
            out.append(token)
        return out

    def _longest_at(self, text: str, at: int) -> int:
        return next(self.automaton.iter_long(text[at : at + self.longest]))[1]

    def _backtrack(self, text: str, out: list[int], token: int) -> list[int]:
        """Goes on from the tokens in out, which fit each other, where token doesn't fit."""
        length, shorter, known, size = self.length, self.shorter, self.compatible, self.size
        n, at = len(text), sum([length[t] for t in out])
        closed: set[int] = set()
        while True:
            end = at + length[token]
            if end not in closed and (not out or known.get(out[-1] * size + token) or self.fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, self._longest_at(text, end)
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                # Nothing that starts here fits: the position is closed and the token before it is tried shorter.
                closed.add(at)
                token = out.pop()
                at -= length[token]

    def _whole(self, text: str) -> bytes:
        """Ids of a text, pretoken by pretoken; those of one text are remembered while it lasts."""
        out: list[bytes] = []
        known: dict[str, bytes] = {}
        for part in self.borders(text) if self.hints(text) else (text,):
            if part in self.special:
                out.append(int(self.special[part]).to_bytes(4, "little"))
                continue
            for p in self.pretokens(part):
                got = known.get(p)
                if got is None:
                    got = known[p] = array("I", self.merge(p.encode())).tobytes()
                out.append(got)
        return b"".join(out)

    def forget(self) -> None:
        """Lets an idle worker's memory go; the next task that encodes builds the tables anew."""
        self.compatible = {}
        encoder.cache_clear()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; null counts as empty."""
        return self.pieces(texts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't valid UTF-8 become U+FFFD."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        start, length = self.offset[i], self.offset[i + 1] - self.offset[i]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def transcode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), decoded: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns key, the columns in keep, token_ids (binary, little-endian unsigned 32-bit integers), lossless (whether the decoded
    text is the text) and, if asked for, decoded_text. A null text counts as empty and gives no ids. Repeated rows give repeated
    rows, an empty table an empty result; other columns, whatever their names, are left out.
    """
    held = [f"held{k}" for k in range(len(keep))]
    names = ["key", *held, "token_ids", "lossless", *(["decoded_text"] if decoded else [])]

    def make():
        e = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = e.encode(batch.column(1))
            back = [e.decode(i) for i in ids]
            same = [b == (t.as_py() or "") for b, t in zip(back, batch.column(1))]
            made = [pa.array(ids, pa.binary()), pa.array(same, pa.bool_()), *([pa.array(back, pa.string())] if decoded else [])]
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *made], names)

        return step

    kinds = [f"{h} {docs.schema[c].dataType.simpleString()}" for h, c in zip(held, keep)]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(h) for h, c in zip(held, keep)))
    schema = [f"key {docs.schema[key].dataType.simpleString()}", *kinds, "token_ids binary", "lossless boolean", *(["decoded_text string"] if decoded else [])]
    out = map_batches(rows, ", ".join(schema), make)
    return out.select(F.col("key").alias(key), *(F.col(h).alias(c) for h, c in zip(held, keep)), *names[1 + len(keep) :])
