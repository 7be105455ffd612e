"""Phrases whose words stand together more often than their parts let expect.

Texts are split into pieces, and identical pieces of a language become one with a multiplicity. Pieces are packed into chunks of
bounded size, each with a dictionary of its words. DuckDB counts a chunk's weighted n-grams as pairs of numbers and deals them
by a hash of the phrase into buckets, which travel as compressed columns. Each bucket is counted by DuckDB, out of core where
the shared folder is mounted, and answers the chunks that asked which of their phrases are frequent. A chunk that meets its
answers counts longer phrases, but only those whose two shorter ones are frequent, since no other can be. The parts of frequent
phrases are looked up by shuffled requests, and scores are exact decimals.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldloom.llm.common import LOWER, UPPER, arrow_batches, local_path, shared_folder, written

#: Phrases in fewer places aren't candidates; a longer one with so many hundredths of a phrase's places drops it; rows for each language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Bytes of pieces in a chunk, of word numbers (4 each) in a bucket, the most buckets, and the parts a language's candidates are ranked in.
CHUNK_BYTES, BUCKET_BYTES, MOST_BUCKETS, PARTS = 6_000_000, 4_000_000, 1 << 15, 64
#: Chunks' worth of pieces that wait in a task, and rows that DuckDB is given at a time.
WAITING, TOGETHER = 3, 200_000
#: MB that DuckDB may hold in one task before it writes to disk.
MEMORY_MB = 300
MARKS = ".,;:!?\x0b\x0c\r"

CHUNK = "chunk string, lang string, n long, words array<string>, ids binary, sizes binary, times binary"
DEALT = "bucket int, chunk string, lang string, packed binary"
COUNTED = "chunk string, packed binary, lang string, phrase string, n_words int, f long"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, times): different pieces of each language, A-Z in lower case, and how often they occur.

    Words are separated by spaces, of which there may be several. A null language is und; null and empty texts have no pieces.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER + "\t" + MARKS, LOWER + " " + "\n" * len(MARKS))
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    return rows.select("lang", F.trim("piece").alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _chunk(lang: str, rows: pa.Table, name: str) -> list:
    """A chunk's columns: its words and their numbers piece by piece."""
    lists = pc.split_pattern(rows["piece"].combine_chunks(), " ")
    parts = lists.flatten()
    held = pc.not_equal(parts, "")
    words = parts.filter(held).dictionary_encode()
    sizes = np.add.reduceat(held.to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy()[:-1])
    times = rows["times"].to_numpy()
    return [name, lang, int(sizes.astype(np.int64) @ times), words.dictionary.to_pylist(), words.indices.to_numpy().astype("<i4").tobytes(), sizes.astype("<i4").tobytes(), times.astype("<i8").tobytes()]


def chunks(made: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pieces packed into chunks of one language each, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.RecordBatch]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal k
            row = _chunk(lang, pa.Table.from_batches(held.pop(lang)), f"{part}-{k}")
            k += 1
            size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang))
                held.setdefault(lang, []).append(own)
                size[lang] = size.get(lang, 0) + own.nbytes
                # Languages fill chunks of their own; what waits is bounded, too.
                if size[lang] >= chunk_bytes:
                    yield flush(lang)
            while sum(size.values()) >= WAITING * chunk_bytes:
                yield flush(max(size, key=size.get))
        for lang in [*held]:
            yield flush(lang)

    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())

    return written(made.mapInArrow(run, CHUNK), "chunks")


def _numbers(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words; and for each word in its pieces: its number, the piece it is in, and that piece's multiplicity."""
    ids, sizes, times = np.frombuffer(row["ids"], "<i4"), np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["times"], "<i8")
    return pa.array(row["words"], pa.string()), ids, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.repeat(times, sizes)


def _counted(con: duckdb.DuckDBPyConnection, row: dict, grams: list[dict[str, np.ndarray]], words: pa.Array, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's n-grams, counted by DuckDB as numbers of words and dealt into buckets by a hash of language and phrase.

    grams: for each n the columns w0, w1, ... (numbers of words) and weight.
    """
    con.register("words", pa.table({"id": pa.array(np.arange(len(words), dtype=np.int32)), "word": words}))
    con.register("own", pa.table({"lang": [row["lang"]]}))
    parts = []
    for columns in grams:
        n = len(columns) - 1
        con.register(f"grams{n}", pa.table({c: pa.array(v) for c, v in columns.items()}))
        at = [f"w{i}" for i in range(n)]
        phrase, joins = " || ' ' || ".join(f"x{i}.word" for i in range(n)), " ".join(f"JOIN words x{i} ON x{i}.id = w{i}" for i in range(n))
        # A pair's numbers go along, so that the answer needn't hold its words.
        a, b = ("w0", "w1") if n == 2 else ("-1", "-1")
        parts.append(f"SELECT {phrase} AS phrase, {n}::TINYINT AS n_words, {a}::INT AS a, {b}::INT AS b, f FROM (SELECT {', '.join(at)}, sum(weight)::BIGINT AS f FROM grams{n} GROUP BY ALL) {joins}")
    table = con.sql(f"SELECT (hash((SELECT lang FROM own) || chr(10) || phrase) % {buckets})::INT AS bucket, * FROM ({' UNION ALL '.join(parts)}) ORDER BY bucket, phrase").to_arrow_table()
    spot, rest = table["bucket"].to_numpy(), table.drop_columns(["bucket"]).combine_chunks()
    starts = np.flatnonzero(np.diff(spot, prepend=-1)).tolist()
    data = [_packed(rest.slice(s, e - s)) for s, e in zip(starts, [*starts[1:], len(spot)])]
    yield pa.RecordBatch.from_arrays([pa.array(spot[starts], pa.int32()), pa.array([row["chunk"]] * len(data)), pa.array([row["lang"]] * len(data)), pa.array(data, pa.binary())], ["bucket", "chunk", "lang", "packed"])


def _next_to(keep: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words are in one piece."""
    return np.flatnonzero(keep[: len(keep) - n + 1] == keep[n - 1 :]) if len(keep) >= n else np.zeros(0, np.int64)


def short_phrases(made: DataFrame, buckets: int) -> DataFrame:
    """Words and pairs of words of all chunks, dealt into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in _rows(batch)):
            words, ids, piece, weight = _numbers(row)
            at = _next_to(piece, 2)
            with _database(None) as con:
                yield from _counted(con, row, [{"w0": ids, "weight": weight}, {"w0": ids[at], "w1": ids[at + 1], "weight": weight[at]}], words, buckets)

    return made.mapInArrow(run, DEALT)


def long_phrases(made: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Three words whose first two and last two are frequent, of all chunks, dealt into buckets."""

    def run(rows: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch]:
        for row in rows.to_pylist():
            words, ids, piece, weight = _numbers(row)
            asked = [_unpacked(x.as_py()) for x in found["packed"]]
            key = lambda a, b: a.astype(np.int64) * len(words) + b
            frequent = np.unique(np.concatenate([np.zeros(0, np.int64), *(key(t["a"].to_numpy(), t["b"].to_numpy()) for t in asked)]))
            at = _next_to(piece, 3)
            first = np.isin(key(ids[:-1], ids[1:]), frequent) if len(ids) else np.zeros(0, bool)
            at = at[first[at] & first[at + 1]]
            if len(at):
                with _database(None) as con:
                    yield from _counted(con, row, [{"w0": ids[at], "w1": ids[at + 1], "w2": ids[at + 2], "weight": weight[at]}], words, buckets)

    met = made.select("chunk", "lang", "words", "ids", "sizes", "times").groupBy("chunk").cogroup(answers.select(F.col("chunk").alias("asked_by"), "packed").groupBy("asked_by"))
    return met.applyInArrow(lambda rows, found: _one_table(run(rows, found)), DEALT)


def _one_table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    kinds = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("lang", pa.string()), ("packed", pa.binary())])
    return pa.Table.from_batches(batches, kinds)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _database(spill: str | None) -> duckdb.DuckDBPyConnection:
    """A database in memory; with a folder to spill to, it holds MEMORY_MB at most."""
    if spill:
        os.makedirs(spill, exist_ok=True)
    conf: dict = {"threads": 1, "temp_directory": spill or ""}
    return duckdb.connect(config=conf | ({"memory_limit": f"{MEMORY_MB}MB", "preserve_insertion_order": False} if spill else {}))


def frequent_phrases(dealt: DataFrame, least: int) -> DataFrame:
    """Counts of frequent phrases (lang, phrase, n_words, f), and for each chunk its frequent pairs (chunk, packed: a, b).

    A bucket holds all of a phrase's partial counts. DuckDB adds them up, out of core if need be. Written to the shared folder.
    """
    spill = local_path(shared_folder(dealt.sparkSession, "spill"))
    kinds = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in COUNTED.split(", ")]

    own = lambda: spill and f"{spill}/{TaskContext.get().taskAttemptId()}"

    def answer(con: duckdb.DuckDBPyConnection, of: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        con.register("named", pa.table({"no": pa.array(range(len(of)), pa.int32()), "lang": [lang for _, lang in of]}))
        con.execute("CREATE TEMP TABLE spoken AS SELECT no, (dense_rank() OVER (ORDER BY lang))::INT AS tongue, lang FROM named")
        con.execute(f"CREATE TEMP TABLE often AS SELECT tongue, phrase, any_value(n_words) AS n_words, sum(f)::BIGINT AS f FROM t JOIN spoken USING (no) GROUP BY tongue, phrase HAVING sum(f) >= {least}")
        counts = con.sql("SELECT lang, phrase, n_words::INT AS n_words, f FROM often JOIN (SELECT DISTINCT tongue, lang FROM spoken) USING (tongue)").to_arrow_table()
        for b in counts.to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.string()), pa.nulls(len(b), pa.binary()), *b.columns], names)
        asked = con.sql("SELECT no, a, b FROM t JOIN spoken USING (no) SEMI JOIN often USING (tongue, phrase) WHERE b >= 0 ORDER BY no, a, b").to_arrow_table().combine_chunks()
        at = asked["no"].to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
        rest, data = asked.drop_columns(["no"]), []
        for s, e in zip(starts, [*starts[1:], len(at)]):
            data.append(_packed(rest.slice(s, e - s)))
        if data:
            yield pa.RecordBatch.from_arrays([pa.array([of[k][0] for k in at[starts].tolist()]), pa.array(data, pa.binary()), *(pa.nulls(len(data), t) for t in kinds[2:])], names)
        con.close()
        if spill:
            shutil.rmtree(own(), ignore_errors=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, con, of, held = None, None, [], []

        def put() -> None:
            if held:
                con.register("came", pa.concat_tables(held))
                con.execute("INSERT INTO t SELECT no, phrase, n_words, a, b, f FROM came")
                con.unregister("came")
                held.clear()

        for row in (r for batch in batches for r in _rows(batch)):
            if row["bucket"] != bucket:
                if con:
                    put()
                    yield from answer(con, of)
                bucket, con, of = row["bucket"], _database(own()), []
                con.execute("CREATE TEMP TABLE t (no INT, phrase VARCHAR, n_words TINYINT, a INT, b INT, f BIGINT)")
            came = _unpacked(row["packed"])
            held.append(came.append_column("no", pa.array(np.full(len(came), len(of), np.int32))))
            of.append((row["chunk"], row["lang"]))
            if sum(map(len, held)) >= TOGETHER:
                put()
        if con:
            put()
            yield from answer(con, of)

    return written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, COUNTED), "counted")


def candidates(counts: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, k, l, r, score) of phrases of two words or more, at their lowest-scoring cut.

    counts: (lang, phrase, n_words, f). Parts are looked up by requests that are shuffled to them.
    """
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = counts.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    asked = cuts.select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = asked.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    d = lambda c: F.col(c).cast("decimal(38,0)")
    score = met.withColumn("big", F.lit(1_000_000).cast("decimal(38,0)") * d("a") * d("a")).withColumn("under", d("l") * d("r"))
    best = score.select("lang", "phrase", "n_words", "a", F.struct(F.expr("big div under").alias("score"), "k", "l", "r").alias("cut"))
    return best.groupBy("lang", "phrase", "n_words", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "n_words", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def uncovered(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates whose words don't lie in any longer candidate with at least covered hundredths of their places."""
    words = F.split("phrase", " ")
    longer = found.filter("n_words > 2").select("lang", F.col("a").alias("over"), words.alias("w"), F.explode(F.expr("sequence(2, n_words - 1)")).alias("n"))
    inner = longer.select("lang", "over", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    return found.join(most, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * covered)).drop("over")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first candidates by score, a and phrase; candidates of a language are first ranked in parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def bucket_count(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, min(MOST_BUCKETS, -(-size // bucket_bytes)))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations of two or three words.

    Null and empty texts count nothing, a null language is und, repeated rows count as often as they come, an empty table gives
    an empty result; other columns take no part. Arithmetic is exact as long as a million times a squared has 38 digits at most.
    """
    arrow_batches(docs.sparkSession)
    made = chunks(pieces(docs, text, lang), chunk_bytes)
    size = made.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("size")).first()["size"]
    buckets = bucket_count(size)
    short = frequent_phrases(short_phrases(made, buckets), least)
    answers = short.filter("packed is not null").select("chunk", "packed")
    long = frequent_phrases(long_phrases(made, answers, buckets), least)
    columns = ("lang", "phrase", "n_words", "f")
    counts = written(short.filter("phrase is not null").select(*columns).unionByName(long.filter("phrase is not null").select(*columns)), "phrases")
    first = ranked(uncovered(written(candidates(counts), "candidates"), covered), top)
    totals = made.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
