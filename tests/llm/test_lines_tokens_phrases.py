"""Lines, alignment and collocations against brute force and hard cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from goldloom.llm import alignment, collocations, line_dedup
from goldloom.llm.bpe import byte_letters
from goldloom.llm.common import filter_words, split_by
from goldloom.llm.op12_align import op12_alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, line string, pos string, hash string, piece string, block string"


def frame(spark, rows, parts=3):
    """rows: (doc_id, text, lang); other columns have names that clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "l", "p", "h", "x", "b") for i, t, lang in rows], DOCS).repartition(parts)


# --- lines


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        at = lambda s: max(s, key=lambda x: (x is not None, x))
        stays = [x for x in lines if len(holders.get(key(x), ())) < 3 or at(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


def lines_of(docs):
    return sorted((tuple(r) for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()), key=repr)


def test_lines_brute_force(spark):
    rng = random.Random(4)
    shared = ["A line that many documents hold", "  a LINE that many documents hold\t", "another line of some twenty", "too short", "", " ", "Été à la plage de Saint-Malo", "été à la plage de saint-malo", "x" * 19, "y" * 20, "\x85 nineteen letters ..\x85"]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.6 else f"own line {rng.random()} of this document" for _ in range(rng.randint(0, 12))), "en") for i in range(120)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "\n\n", "en"), (203, "\r\n".join(shared * 50), None), (204, "\n".join(["a line that many documents hold"] * 5000), "de"), (205, "z" * 100_000, "de")]
    rows += [(5, shared[0], "en"), (5, shared[0], "en"), (None, shared[0] + "\n" + "y" * 20, "en"), (None, "y" * 20, "en")]
    assert lines_of(frame(spark, rows)) == brute_lines(rows)


def test_lines_edges(spark):
    assert lines_of(frame(spark, []).limit(0)) == []
    same = [(7, "the very same line in every row", "en")] * 4
    # Rows with one key are one document, and so are rows without a key.
    assert all(r[2] == 0 for r in lines_of(frame(spark, same)))
    assert all(r[2] == 0 for r in lines_of(frame(spark, [(None, "the very same line in every row", "en")] * 4)))


def test_lines_bitmaps_hold_no_text(spark):
    rows = [(i, "head\nthe line that all of them hold\nbody\nthe line that all of them hold\nthe line that all of them hold", "en") for i in range(4)]
    made = line_dedup.keep_bitmaps(frame(spark, rows))
    assert made.columns == ["doc_id", "row_hash", "n_dropped", "dropped"]
    assert {r["doc_id"]: [tuple(x) for x in r["dropped"]] for r in made.collect()} == {i: [(1, 1), (3, 4)] for i in range(3)}


def test_frequent_line_is_spread(spark):
    """A line of every document is dealt by document, too: no range holds most of its rows."""
    lines = spark.range(40_000).select(F.lit(b"h").alias("hash"), F.col("id").alias("doc_id"), F.lit(0).alias("pos"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = lines.repartitionByRange("hash", F.desc("doc_id")).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in dealt) < 20_000
        found = line_dedup.shared_lines(lines).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [(r["keeper"], r["group_size"]) for r in found] == [(39_999, 40_000)]


def test_filters_are_sized_by_a_count(spark):
    assert filter_words(0) == filter_words(1000) == 1 << 10
    assert filter_words(1_000_000) == 1 << 18 and filter_words(16_000_000) == 1 << 20 and filter_words(20_000_000) == 0
    rows, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 10).withColumnRenamed("id", "k")
    likely, clear = split_by(rows, "k", keys)
    got, out = {r["k"] for r in likely.collect()}, {r["k"] for r in clear.collect()}
    assert got | out == set(range(5000)) and not got & out and set(range(0, 5000, 10)) <= got and len(got) < 1500


# --- alignment


def brute_alignment(rows):
    """Whole texts, encoded by the libraries; all pairs of a group."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    letter, inverse = byte_letters(), {i: w for w, i in t.get_vocab().items()}
    a_bytes = lambda i: bytes(letter[c] for c in inverse[i])
    b_bytes = lambda i: bytes([int(s.id_to_piece(i)[1:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    made, held, links = [], Counter(), []
    for i, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes, a)) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
            a = b = []
        ends = []
        for ids, raw in ((a, a_bytes), (b, b_bytes)):
            at, e = 0, []
            for x in ids:
                at += len(raw(x))
                e.append(at)
            ends.append(e)
        groups, p, q, own = [], 0, 0, Counter()
        for cut in sorted({*ends[0]} & {*ends[1]}):
            p2, q2 = p + sum(e <= cut for e in ends[0][p : p + 4000]), q + sum(e <= cut for e in ends[1][q : q + 4000])
            groups.append((a[p:p2], b[q:q2]))
            own.update((x, y) for x in a[p:p2] for y in b[q:q2])
            p, q = p2, q2
        held.update({*own})
        links.append(own)
        text_form = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        made.append((i, len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(text_form.encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((*m[:5], sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), m[5]) for m, own in zip(made, links)), key=repr)


def test_alignment_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 4000 ORDER BY doc_id LIMIT 120").fetchall()
    got = alignment.aligned(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), A, B, block_bytes=20_000)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_alignment(docs)


def test_alignment_hard_texts(spark):
    rng = random.Random(3)
    parts = ["a", "b ", "  ", " ", "\n", "\t", "é", "▁", "漢字", " ", "　", "<s>", "<0x41>", "<|endoftext|>", "don't ", "xyz ", "\x00", "\U0001f642", "12", "...", "\x85", "é", " the"]
    texts = [None, "", " ", "   ", "a", "a b", "a  b", " a", "a ", "x" * 3000, " ".join(f"w{i % 97}" for i in range(900))] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    assert sorted(map(tuple, alignment.aligned(docs, A, B, block_bytes=3000).collect()), key=repr) == brute_alignment(rows)
    assert alignment.aligned(docs.limit(0), A, B).collect() == []


def test_alignment_query(spark):
    got = op12_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = got.collect()
    assert len(rows) == 200 and all(r["n_groups"] <= min(r["n_a"], r["n_b"]) and r["n_best"] <= r["n_links"] <= r["count_sum"] for r in rows)


# --- collocations


def brute_phrases(rows, least=10, covered=50, top=2000):
    import re

    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            count[lang].update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {p[i : i + 2] for p, a in found.items() if len(p) == 3 for i in (0, 1) if 100 * a >= covered * f[p[i : i + 2]]}
        scored = []
        for p, a in found.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if p not in hidden:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases_of(docs, **more):
    return sorted(map(tuple, collocations.collocations(docs, **more).collect()))


def test_phrases_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [*"abcde", "été", "Été", "Big", "data", "New", "York", "x'", "$$", "\U0001f642", " ", "￿"]
    sentence = lambda: (" " if rng.random() < 0.9 else "\t ").join(rng.choices(vocabulary, k=rng.randint(0, 9)))
    texts = ["".join(sentence() + rng.choice([". ", ", ", "\n", "!", "\x0b", "\r\n", " "]) for _ in range(rng.randint(0, 20))) for _ in range(150)]
    texts += ["New York City. " * 300, None, "", "...", " \t ", "word " * 5000, "q" * 100_000]
    rows = [(i, t, rng.choice(["en", "de", None, "", "a'b"])) for i, t in enumerate(texts)]
    want = brute_phrases(rows)
    assert phrases_of(frame(spark, rows), chunk_bytes=20_000) == want
    assert phrases_of(frame(spark, rows, 1)) == want


def test_phrases_edges(spark):
    assert phrases_of(frame(spark, []).limit(0)) == [] and phrases_of(frame(spark, [(1, None, None), (2, "", "en")])) == []
    rows = [(1, "one two. one two three", "en")] * 12
    assert phrases_of(frame(spark, rows)) == brute_phrases(rows)
    assert phrases_of(frame(spark, rows), top=1) == brute_phrases(rows, top=1)


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3_000_000_000_001), ("en", "b", 1, 2_999_999_999_999), ("en", "a b", 2, 2_999_999_999_998), ("en", "c", 1, 2_999_999_999_998), ("en", "a b c", 3, 2_999_999_999_997), ("en", "b c", 2, 2_999_999_999_997)], "lang string, phrase string, n_words int, f long")
    got = {r["phrase"]: (r["score"], r["k"]) for r in collocations.candidates(counts).collect()}
    f = {r["phrase"]: r["f"] for r in counts.collect()}
    score = lambda p, left, right: 10**6 * f[p] ** 2 // (f[left] * f[right])
    assert got == {"a b": (score("a b", "a", "b"), 1), "b c": (score("b c", "b", "c"), 1), "a b c": min((score("a b c", "a", "b c"), 1), (score("a b c", "a b", "c"), 2))}
