"""Exact deduplication by a log-structured merge index of text digests.

A batch of documents is digested. Every task gathers digests in a memtable of a bounded number of rows, which holds the smallest
identifier and the number of rows of each digest, and flushes it as a sorted run. The runs of a batch are filed together
with a filter on their digests, as the newest run set of level 0. Where a level has FAN run sets they are merged into one of the
next level: the range of digests is dealt out, and each task merges its part and writes it sorted, the smallest identifier
staying. So an entry is rewritten once per level, and each level is FAN times as large as the one before.

A later batch asks the filter of each run set first; only digests that pass are joined with its entries. Hits are verified
byte by byte against the text that stays. Rows that fail (two texts, one digest) are grouped anew by digest and text, so the
outcome never rests on the digest.

No group meets in one task: memtables and verification pre-aggregate, and the few digests with more than a fixed share of all
rows are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.llm.common import SEPARATOR, discard, filter_over, likely_in, look_up, passing, written

#: Rows of a memtable, and run sets of a level that are merged into the next one.
MEMTABLE, FAN = 200_000, 4


def normal_text(text: Column) -> Column:
    """The text with each run of separators replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATOR, " ")


def digested(docs: DataFrame, digest_bytes: int = 32, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, digest) of every row."""
    sha = docs.select(F.col(key).alias("doc_id"), F.sha2(normal_text(F.col(text)).cast("binary"), 256).alias("text_sha256"))
    return sha.withColumn("digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))


def flush_runs(rows: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs (run, digest, keep_id, group_size), one for each memtable that a task fills; run counts a task's runs."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def flushed(held: list[pa.RecordBatch], run: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "min"), ("doc_id", "count", pc.CountOptions(mode="all"))]).sort_by("digest").combine_chunks()
        columns = [pa.array([run] * table.num_rows, pa.int32()), *(table[c].combine_chunks() for c in ("digest", "doc_id_min", "doc_id_count"))]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["run", "digest", "keep_id", "group_size"])

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        run = size = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, memtable - size)
                held.append(part)
                size, batch = size + part.num_rows, batch.slice(part.num_rows)
                if size == memtable:
                    yield flushed(held, run)
                    held, size, run = [], 0, run + 1
        if held:
            yield flushed(held, run)

    return rows.select("digest", "doc_id").mapInArrow(flush, f"run int, digest binary, keep_id {kind}, group_size long")


@dataclass(frozen=True)
class RunSet:
    """Entries (digest, keep_id, group_size) in sorted files, and a filter of fixed size on their digests."""

    entries: DataFrame
    filter: DataFrame

    @staticmethod
    def filed(entries: DataFrame) -> RunSet:
        kept = written(entries.select("digest", "keep_id", "group_size"), "runs")
        return RunSet(kept, written(filter_over(kept, "digest"), "filter"))

    def find(self, digests: DataFrame) -> DataFrame:
        """Entries of the given digests (no digest twice); what the filter clears isn't joined."""
        return passing(digests.select("digest"), "digest", self.filter).join(self.entries, "digest")


def merged(runs: list[DataFrame]) -> DataFrame:
    """One entry per digest of several runs, sorted: ranges of digests are dealt out and merged, each by one task.

    Memtables hold a digest once, so a frequent digest comes once per memtable, not once per row.
    """
    every = reduce(DataFrame.unionByName, (r.select("digest", "keep_id", "group_size") for r in runs))
    dealt = every.repartitionByRange("digest").groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return dealt.sortWithinPartitions("digest")


class Index:
    """The levels, from the newest to the oldest; each is a list of run sets."""

    def __init__(self, digest_bytes: int = 32, text: str = "text", key: str = "doc_id", memtable: int = MEMTABLE, fan: int = FAN) -> None:
        self.digest_bytes, self.text, self.key, self.memtable, self.fan = digest_bytes, text, key, memtable, fan
        self.levels: list[list[RunSet]] = [[]]
        self.docs: list[DataFrame] = []
        self.rows: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Files a batch; returns hits (digest, keep_id): its digests that were known before, with the smallest identifier so far."""
        rows = written(digested(docs, self.digest_bytes, self.text, self.key), "rows")
        own = RunSet.filed(flush_runs(rows, self.memtable))
        earlier = [s for level in self.levels for s in level]
        hits = own.entries.select("digest", "keep_id").limit(0)
        if earlier:
            asked = written(own.entries.select("digest").distinct(), "asked")
            found = reduce(DataFrame.unionByName, (s.find(asked).select("digest", "keep_id") for s in earlier))
            hits = written(found.groupBy("digest").agg(F.min("keep_id").alias("keep_id")), "hits")
        self.docs.append(docs.select(F.col(self.key).alias(self.key), F.col(self.text).alias(self.text)))
        self.rows.append(rows)
        self.levels[0].append(own)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan:
                self._push(k)
        return hits

    def _push(self, k: int) -> None:
        """Merges level k into one run set of the next level."""
        old, self.levels[k] = self.levels[k], []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(RunSet.filed(merged([s.entries for s in old])))
        for s in old:
            discard(s.entries)
            discard(s.filter)

    def compacted(self) -> DataFrame:
        """All entries, merged over all levels; the index then has this one run set."""
        sets = [s for level in self.levels for s in level]
        whole = RunSet.filed(merged([s.entries for s in sets]))
        self.levels = [[], [whole]]
        return whole.entries

    def result(self) -> DataFrame:
        """One row per row of all batches: key, keep_id, group_size, kept and text_sha256, hits verified byte by byte."""
        level = self.compacted()
        rows = reduce(DataFrame.unionByName, self.rows)
        docs = reduce(DataFrame.unionByName, self.docs)
        found = look_up(rows, level, "digest")
        wrong = written(false_hits(docs, level, self.digest_bytes, self.text, self.key), "wrong")
        if wrong.head(1):
            groups = wrong.groupBy("digest", "norm").agg(F.min("doc_id").alias("true_id"), F.count("*").alias("true_size"))
            true = wrong.join(groups, ["digest", "norm"]).select(F.col("doc_id").alias("id"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "true_id", "true_size").distinct()
            found = found.join(true, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")), "left").select("doc_id", "text_sha256", F.when(F.col("true_size").isNull(), F.col("keep_id")).otherwise(F.col("true_id")).alias("keep_id"), F.coalesce("true_size", "group_size").alias("group_size"))
        return found.select(F.col("doc_id").alias(self.key), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def false_hits(docs: DataFrame, level: DataFrame, digest_bytes: int = 32, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, digest, norm) of digests that stand for more than one text.

    A filter of fixed size over the digests of two and more rows keeps most other texts out of the shuffle. All texts of a
    digest are the same bytes if the smallest and the largest are; partial results leave each task, so a large group costs
    one row per task.
    """
    norm = docs.select(F.col(key).alias("doc_id"), normal_text(F.col(text)).alias("norm"))
    texts = norm.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), 1, digest_bytes))
    likely = likely_in(texts, "digest", level.filter("group_size > 1"))
    bad = written(likely.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest"), "bad")
    return likely.join(bad, "digest", "left_semi") if bad.head(1) else likely.filter("false")


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of separators is replaced by one space; null counts as empty, so
    null and empty texts form one group. Of equal texts the row with the smallest key stays; a null key comes after all others.
    Rows that repeat a key count one by one in group_size; of rows with one key and equal texts all are marked as kept. An
    empty table gives an empty result, and other columns are left out. digest_bytes shortens the digest, for tests of the
    verification.
    """
    index = Index(digest_bytes, text, key)
    index.add(docs)
    return index.result()
