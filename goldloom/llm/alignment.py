"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet.

Texts are cut where both tokenizers always begin a token: at a single space between two characters that aren't white space.
Within a block, some texts of an Arrow batch, each different piece is encoded once by either tokenizer, and DuckDB works on the
block's tables: all pieces lie one after another on one axis of bytes, window sums turn token lengths into intervals, ends that
both have bound the groups, an ASOF join gives each A token its group and a range join each B token, and aggregates give each
piece's links and the number of the block's documents that hold a pair. Spark merges those partial counts. Each block then asks
for the counts of its own pairs, by a shuffled join, and meets the answers in a cogroup, which holds one block and no more.

A Python worker holds one block: BLOCK_BYTES of text, or one text that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldloom.llm.bpe import byte_letters
from goldloom.llm.common import arrow_batches, written

#: Bytes of text in a block, and pieces that are encoded as one text.
BLOCK_BYTES, TOGETHER = 3_000_000, 200
#: What the piece tokenizer writes for a space.
BLANK = "▁"
#: Nothing, or white space at an end: a text with such a part between single spaces is cut with care.
UNEVEN = r"^$|^[\pZ\x09-\x0D\x1C-\x1F\x{85}]|[\pZ\x09-\x0D\x1C-\x1F\x{85}]$"
BLOCKS = "kind int, block string, doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, pair_a array<int>, pair_b array<int>, pair_docs array<long>, links binary"

#: Tokens, pieces and (document, piece) rows of a block become intervals, groups, links and counts.
STEPS = (
    "CREATE OR REPLACE TEMP TABLE a AS SELECT n, id, sum(len) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS till FROM tokens_a",
    "CREATE OR REPLACE TEMP TABLE b AS SELECT n, id, sum(len) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS till FROM tokens_b",
    "CREATE OR REPLACE TEMP TABLE g AS SELECT till, lag(till, 1, 0) OVER (ORDER BY till) AS since, (row_number() OVER (ORDER BY till))::INT AS grp FROM a SEMI JOIN b USING (till)",
    "CREATE OR REPLACE TEMP TABLE gs AS SELECT g.grp, s.seg FROM g ASOF JOIN segs s ON g.till <= s.till",
    "CREATE OR REPLACE TEMP TABLE ga AS SELECT a.n, a.id, g.grp FROM a ASOF JOIN g ON a.till <= g.till",
    # The range join meets within stretches of 32 bytes, each of which lists the groups that reach into it.
    "CREATE OR REPLACE TEMP TABLE gx AS SELECT grp, since, till, unnest(range((since + 1) >> 5, (till >> 5) + 1)) AS stretch FROM g",
    "CREATE OR REPLACE TEMP TABLE gb AS SELECT b.n, b.id, gx.grp FROM b JOIN gx ON b.till >> 5 = gx.stretch AND b.till > gx.since AND b.till <= gx.till",
    """CREATE OR REPLACE TEMP TABLE links AS
       SELECT seg, x.id AS a, y.id AS b, sum(x.c * y.c)::BIGINT AS times
       FROM (SELECT grp, id, count(*) AS c FROM ga GROUP BY grp, id) x JOIN (SELECT grp, id, count(*) AS c FROM gb GROUP BY grp, id) y USING (grp) JOIN gs USING (grp)
       GROUP BY seg, x.id, y.id""",
    "CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, (row_number() OVER (ORDER BY a, b) - 1)::INT AS pair FROM (SELECT DISTINCT a, b FROM links)",
    "CREATE OR REPLACE TEMP TABLE numbered AS SELECT seg, pair, times FROM links JOIN pairs USING (a, b)",
)
DOCUMENTS = "SELECT pair, count(*) AS docs FROM (SELECT DISTINCT doc, pair FROM held JOIN numbered USING (seg)) GROUP BY pair ORDER BY pair"
LINKS = "SELECT seg, pair, times FROM numbered ORDER BY seg, pair"


class Tokens:
    """Token bytes of a tokenizer, and encodings of pieces; a piece is encoded with a space before it."""

    def __init__(self, raw: list[bytes], encode_texts, blank: str) -> None:
        self.encode_texts, self.blank = encode_texts, blank
        self.length = np.array([len(r) for r in raw], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.names = pa.array([str(i) for i in range(len(raw))])
        self.spaced = np.array([r[:1] == b" " for r in raw])
        #: Whether no token goes over a cut.
        self.cuts = not any(regex.search(r"\S ", r.decode("utf-8", "replace")) for r in raw)

    def encode(self, pieces: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has. The first pieces, plain of them, hold no space: many of
        them are encoded as one text, in which a token that begins with a space begins a piece."""
        groups = [pieces[k : k + TOGETHER] for k in range(0, plain, TOGETHER)] if plain else []
        groups = [g[: plain - k * TOGETHER] for k, g in enumerate(groups)]
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

        def singly(some: list[str]) -> None:
            got = self.encode_texts([self.blank + p for p in some])
            ids.extend(got)
            counts.append(np.array([len(g) for g in got], np.int64))

        for group, got in zip(groups, self.encode_texts([self.blank + " ".join(g) for g in groups])):
            starts = np.flatnonzero(self.spaced[got])
            if len(starts) == len(group) and not starts[0]:
                ids.append(got)
                counts.append(np.diff(starts, append=len(got)))
            else:
                singly(group)
        singly(pieces[plain:])
        return np.concatenate(ids), np.concatenate(counts)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        spots = np.repeat(self.offset[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[spots].tobytes()


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> Tokens:
    """A byte-level tokenizer of the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    letter, special = byte_letters(), {x.content for x in t.get_added_tokens_decoder().values()}
    vocab = t.get_vocab()
    raw = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        raw[i] = token.encode() if token in special else bytes(letter[c] for c in token)
    return Tokens(raw, lambda texts: [np.array(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)], " ")


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> Tokens:
    """A tokenizer of the sentencepiece library, which adds a space itself."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(s.get_piece_size()):
        p = s.id_to_piece(i)
        raw.append(bytes([int(p[1:-1], 16)]) if s.is_byte(i) else b"" if s.is_control(i) or s.is_unknown(i) else p.replace(BLANK, " ").encode())
    return Tokens(raw, lambda texts: [np.array(e, np.int32) for e in s.encode(texts, num_threads=1)] if texts else [], "")


def uneven_pieces(text: str) -> list[str]:
    """The pieces of any text: cut at single spaces between characters that aren't white space."""
    out: list[str] = []
    open_: list[str] = []
    for p in text.split(" "):
        # A space before p is a cut if what is open ends, and p begins, with something else than white space.
        if open_ and p and not p[0].isspace() and open_[-1] and not open_[-1][-1].isspace():
            out.append(" ".join(open_))
            open_ = []
        open_.append(p)
    return [*out, " ".join(open_)]


def all_pieces(texts: pa.Array, cuts: bool) -> tuple[list[str], int, list[np.ndarray]]:
    """Different pieces, those without a space first; how many these are; and the numbers of each text's pieces, in order.

    Null and empty texts, and texts with the letter that stands for a space, have none.
    """
    texts = pc.if_else(pc.fill_null(pc.match_substring(texts, BLANK), True), "", texts)
    lists = pc.split_pattern(texts, " ")
    parts = lists.flatten().dictionary_encode()
    words = parts.dictionary
    odd = pc.match_substring_regex(words, UNEVEN).to_numpy(zero_copy_only=False)
    words = words.to_pylist()
    at, offsets = parts.indices.to_numpy(), lists.offsets.to_numpy()
    uneven = np.logical_or.reduceat(np.append(odd[at], True), offsets[:-1]) if odd.any() else np.zeros(len(texts), bool)
    docs = [at[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    number, plain = {w: k for k, w in enumerate(words)}, len(words)
    spaced: dict[str, int] = {}
    for k, d in enumerate(docs):
        if not cuts or uneven[k]:
            text = texts[k].as_py()
            own = (uneven_pieces(text) if cuts else [text]) if text else []
            docs[k] = np.array([number[p] if p in number else spaced.setdefault(p, plain + len(spaced)) for p in own], np.int32)
    return [*words, *spaced], plain, docs


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def _squeezed(*columns: np.ndarray) -> bytes:
    """Numbers in columns of one length."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([c.astype("<i8") for c in columns]).tobytes())


def _columns(data: bytes, n: int) -> np.ndarray:
    """The n columns that _squeezed put into data."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(n, -1)


def _joined(values: pa.Array, counts: np.ndarray, mark: str) -> pa.Array:
    """Values joined by a mark, as many for each string as counts says."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values), mark)


class Block:
    """Some texts: their pieces and what DuckDB makes of them."""

    def __init__(self, con: duckdb.DuckDBPyConnection, a: Tokens, b: Tokens, texts: pa.Array) -> None:
        pieces, plain, self.docs = all_pieces(texts, a.cuts and b.cuts)
        used = np.zeros(len(pieces), bool)
        for d in self.docs:
            used[d] = True
        (ids_a, n_a), (ids_b, n_b) = a.encode(pieces, plain), b.encode(pieces, plain)
        sizes = pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64) + 1
        good = self._same(pieces, sizes, (a, ids_a, n_a), (b, ids_b, n_b))
        if not good[used].all():
            self.docs = [d if good[d].all() else d[:0] for d in self.docs]
        good &= used
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        segs = np.flatnonzero(good).astype(np.int32)
        times = [np.unique(d, return_counts=True) for d in self.docs]
        self.held = times
        tables = {
            "tokens_a": {"n": np.arange(len(ids_a), dtype=np.int32), "id": ids_a, "len": a.length[ids_a]},
            "tokens_b": {"n": np.arange(len(ids_b), dtype=np.int32), "id": ids_b, "len": b.length[ids_b]},
            "segs": {"seg": segs, "till": np.cumsum(sizes[segs])},
            "held": {"doc": np.repeat(np.arange(len(texts), dtype=np.int32), [len(s) for s, _ in self.held]), "seg": np.concatenate([np.zeros(0, np.int32), *(s for s, _ in self.held)])},
        }
        for name, columns in tables.items():
            con.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))
        for step in STEPS:
            con.execute(step)
        read = lambda sql: con.sql(sql).to_arrow_table()
        # Groups are numbered along the axis, from 1 on, so tokens in order are in order of groups.
        seg = read("SELECT seg FROM gs ORDER BY grp")["seg"].to_numpy()
        counts, sides = [], []
        for t, tokens in (("ga", a), ("gb", b)):
            grouped = read(f"SELECT grp, id FROM {t} ORDER BY n")
            counts.append(np.bincount(grouped["grp"].to_numpy(), minlength=len(seg) + 1)[1:])
            sides.append(_joined(tokens.names.take(grouped["id"].combine_chunks()), counts[-1], ","))
        self.sums = np.array([np.bincount(seg, w, len(pieces)) for w in (*counts, np.ones(len(seg)), counts[0] * counts[1])]).astype(np.int64)
        self.text = np.full(len(pieces), "", object)
        held = np.flatnonzero(self.sums[2])
        self.text[held] = _joined(pc.binary_join_element_wise(*sides, "|"), self.sums[2, held], ";").to_pylist()
        pairs = read("SELECT a, b FROM pairs ORDER BY pair")
        self.pairs = (pairs["a"].to_numpy(), pairs["b"].to_numpy(), read(DOCUMENTS))
        links = read(LINKS)
        self.links = [links[c].to_numpy() for c in ("seg", "pair", "times")]

    @staticmethod
    def _same(pieces: list[str], sizes: np.ndarray, *coded: tuple[Tokens, np.ndarray, np.ndarray]) -> np.ndarray:
        """Which pieces either tokenizer gives back byte for byte, with a space before them."""
        good = np.ones(len(pieces), bool)
        whole = "".join([" " + p for p in pieces]).encode()
        ends = np.cumsum(sizes)
        for tokens, ids, counts in coded:
            given, till = tokens.bytes_of(ids), np.cumsum(np.concatenate([[0], tokens.length[ids]]))[np.cumsum(counts)]
            if given == whole and (till == ends).all():
                continue
            starts = np.concatenate([[0], till])
            good &= [given[s:e] == whole[x - n : x] for s, e, x, n in zip(starts.tolist(), till.tolist(), ends.tolist(), sizes.tolist())]
        return good

    def rows(self, name: str, keys: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each document, and one with the block's pairs and links."""
        n = len(self.docs) + 1
        sums = [np.array([int(self.sums[k, s] @ c) if len(s) else 0 for s, c in self.held], np.int64) for k in range(4)]
        digests = [hashlib.sha256(";".join(self.text[d].tolist()).encode()).hexdigest() if len(d) else "" for d in self.docs]
        pair_docs = self.pairs[2]["docs"].to_numpy()
        only = lambda values, kind: pa.array([None] * (n - 1) + [values], kind)
        columns = {
            "kind": pa.array([0] * (n - 1) + [1], pa.int32()),
            "block": pa.array([name] * n),
            "doc_id": pa.concat_arrays([keys, pa.nulls(1, keys.type)]),
            **{c: pa.array([*s.tolist(), None], pa.int64()) for c, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums)},
            "groups_sha256": pa.array([*digests, None], pa.string()),
            # Pieces go up, in a document and in the list of links, so steps between them are small and compress.
            "held": pa.array([*(_squeezed(_steps(s), c) for s, c in self.held), None], pa.binary()),
            "pair_a": only(self.pairs[0], pa.list_(pa.int32())),
            "pair_b": only(self.pairs[1], pa.list_(pa.int32())),
            "pair_docs": only(pair_docs, pa.list_(pa.int64())),
            "links": only(_squeezed(_steps(self.links[0]), *self.links[1:]), pa.binary()),
        }
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def blocks(docs: DataFrame, a_path: str, b_path: str, text: str, key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents (kind 0) and of blocks (kind 1), written to the shared folder."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(a_path), piece_tokens(b_path)
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in _blocks(batch, block_bytes):
                with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
                    made = Block(con, a, b, rows.column(1))
                yield made.rows(f"{part}-{k}", rows.column(0), pa.schema(_schema(rows.column(0).type)))
                k += 1
                del made, rows
                pa.default_memory_pool().release_unused()

    arrow_batches(docs.sparkSession)
    return written(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, BLOCKS.format(key=kind)), "blocks")


def _schema(key: pa.DataType) -> list[tuple[str, pa.DataType]]:
    whole, raw = pa.int64(), pa.binary()
    numbers = [(c, whole) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return [("kind", pa.int32()), ("block", pa.string()), ("doc_id", key), *numbers, ("groups_sha256", pa.string()), ("held", raw), ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("pair_docs", pa.list_(whole)), ("links", raw)]


def asked_pairs(made: DataFrame) -> DataFrame:
    """(block, pair, a, b, docs): the pairs of each block, numbered from 0 on, and how many of its documents hold them."""
    rows = made.filter("kind = 1").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("pair", "x"))
    return rows.select("block", "pair", F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b"), F.col("x.pair_docs").alias("docs"))


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold an id pair linked, and whether no other pair of a is held by more."""
    counts = asked_pairs(made).groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = written(counts, "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return written(counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best")), "counts")


def _scores(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one block with n_best and count_sum."""
    own = rows.filter(pc.equal(rows["kind"], 1))
    docs = rows.filter(pc.equal(rows["kind"], 0))
    steps, pair, times = _columns(own["links"][0].as_py(), 3)
    seg = np.cumsum(steps)
    size = answers.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = answers["pair"].to_numpy()
    count[at], best[at] = answers["count"].to_numpy(), answers["best"].to_numpy().astype(np.int64)
    pieces = int(seg.max()) + 1 if len(seg) else 0
    sums, bests = np.zeros(pieces, np.int64), np.zeros(pieces, np.int64)
    np.add.at(sums, seg, times * count[pair])
    np.add.at(bests, seg, times * best[pair])
    n_best, count_sum = [], []
    for data in docs["held"]:
        steps, n = _columns(data.as_py(), 2)
        held = np.cumsum(steps)
        n_best.append(int(bests[held] @ n))
        count_sum.append(int(sums[held] @ n))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_path is a byte-level file of the tokenizers library, b_path a model of sentencepiece. Null and empty texts, and texts whose
    bytes a tokenizer doesn't give back, have no tokens: zeros and an empty string. Repeated rows are documents of their own, a
    null key stays null, an empty table gives an empty result; other columns are left out.
    """
    made = blocks(docs, a_path, b_path, text, key, block_bytes)
    counts = pair_counts(made)
    answers = asked_pairs(made).join(counts, ["a", "b"]).select(F.col("block").alias("asked_by"), "pair", "count", "best")
    kind = docs.schema[key].dataType.simpleString()
    rows = made.select("kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "links")
    met = rows.groupBy("block").cogroup(answers.groupBy("asked_by"))
    out = met.applyInArrow(_scores, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("doc_id", key)
