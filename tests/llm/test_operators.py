"""The text operators against brute force, round trips and hard cases."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from goldloom.llm import bpe, chat, exact_dedup, licenses, mixing, ngram_join, pieces, pii, quality, sstable, toxicity
from goldloom.llm.op2_sst import library_encoder, op2_token_shards
from goldloom.llm.op4_bpe import op4_bpe
from goldloom.llm.op5_toxicity import op5_toxicity
from goldloom.llm.op7_licenses import op7_licenses
from goldloom.llm.op8_chat import HARD, op8_chat
from goldloom.llm.op9_pii import op9_pii
from goldloom.llm.op10_join import op10_ngram_join
from goldloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, __word string, key string, bits long"
LONG = " ".join(f"w{i % 977} and" for i in range(30_000))
HARD_TEXTS = [None, "", "   ", "\n\t", "a", "one two three", "one  two\tthree", "one two three", LONG, LONG, "x" * 50_000, "\u00e9\U0001f600 <|endoftext|> \\h \\\\ </turn>\n### a: b", "\x85 \u2003x\u00a0y", "a" * 200 + "@" + "b" * 200]


def table(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "w", "x", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, oracle, name):
    if name == "pipeline":
        pytest.skip("checked on its own")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, got.select(*columns).toPandas().itertuples(index=False))) == sorted(map(repr, want.select(*columns).df().astype(got.select(*columns).limit(1).toPandas().dtypes.to_dict()).itertuples(index=False)))


# --- BPE and shards


def test_bpe_equals_library():
    e, t = bpe.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(1)
    parts = [*"ab c\n\t'sé12  漢🙂\r.,!_\x85\u2003", "<|endoftext|>", " the", "ing", "  "]
    texts = [t or "" for t in HARD_TEXTS] + ["".join(rng.choice(parts, rng.integers(0, 50))) for _ in range(3000)]
    for text, ids in zip(texts, e.encode(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert e.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_bpe_query(spark):
    t = Tokenizer.from_file(VOCABULARY)
    want = {}
    for doc_id, text in documents():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op4_bpe(spark, SF).collect()}
    assert got == want


def test_token_shards_query(spark):
    t, start, want = Tokenizer.from_file(VOCABULARY), 0, {}
    for doc_id, text in documents():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op2_token_shards(spark, SF).collect()} == want


def test_shard_lookup():
    w = sstable.ShardWriter(2)
    ids = {k: np.arange(k % 500, dtype="<u4").tobytes() for k in range(-50, 5000, 7)}
    for k in sorted(ids):
        w.add(k, ids[k])
    r = sstable.ShardReader.over(w.finish())
    assert len(r.index) > 1 and dict(r) == ids
    assert all(r.get(k) == v for k, v in ids.items())
    assert all(r.get(k) is None for k in range(-60, 5100) if k not in ids)


def test_pieces_forget_and_find():
    t = Tokenizer.from_file(VOCABULARY)
    calls = []

    def encode(texts):
        calls.extend(texts)
        return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]

    p = pieces.Pieces(encode, remembered=9, fresh=4, special=["<|endoftext|>"])
    rng = np.random.default_rng(8)
    parts = [*"ab c\n\t'sé12  漢🙂\r.,!_\x85\u2003\x01\x02:;?", "<|endoftext|>", " the", "ing", "  ", "\n\n", "3.14", "it's, ok."]
    for _ in range(40):
        texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(25)] + [None, ""]
        assert p(pa.array(texts, pa.string())) == [encode([x or ""])[0] for x in texts]
        assert len(p.fresh) < 4 and len(p.filed.pieces) <= 9 + 200
    p = pieces.Pieces(encode)
    calls.clear()
    p(["the cat, the dog.\nthe end"] * 3)
    p(["the dog, the cat.\nthe end"])
    assert sorted(calls) == sorted([" cat", " the", " dog", " end", ",", ".", "the", "\nthe"])
    p.forget()
    assert not p.fresh and not len(p.filed.pieces) and p(["the cat"]) == encode(["the cat"])
    assert p([]) == [] and pieces.Pieces(encode, special=["a b"])(["a b c"]) == encode(["a b c"])


def test_shards_with_null_and_repeated_keys(spark, tmp_path):
    keys = [None, None, 5, 5, 5, -3, *range(100, 400)]
    rows = [(k, f"text {i} " * (400 if k == 5 else 3)) for i, k in enumerate(keys)]
    path = f"file://{tmp_path}/s"
    shards = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, library_encoder(VOCABULARY), partitions=4)
    assert shards.count() > 1 and shards.agg(F.sum("n_docs")).first()[0] == len(rows)
    back = sorted(((r["start"], r["key"], r["n_ids"]) for r in sstable.read_shards(shards, path).collect()))
    assert [k for _, k, _ in back] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [s for s, _, _ in back] == list(np.cumsum([0, *(n for _, _, n in back[:-1])]))
    t = Tokenizer.from_file(VOCABULARY)
    ids = lambda text: np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
    wanted = [None, 5, -3, 100, 399, 400, 7, -(1 << 63)]
    got = [(r["key"], bytes(r["token_ids"])) for r in sstable.lookup(shards, path, wanted).collect()]
    assert sorted(got, key=repr) == sorted(((k, ids(x)) for k, x in rows if k in wanted), key=repr)
    assert sstable.lookup(shards, path, []).count() == 0
    # A shard whose range doesn't hold the key isn't opened.
    for name in [r["file"] for r in shards.filter(~F.lit(sstable.key_bytes(-3)).between(F.col("first"), F.col("last"))).collect()]:
        (tmp_path / "s" / name).unlink()
    assert [bytes(r["token_ids"]) for r in sstable.lookup(shards, path, [-3]).collect()] == [ids(rows[5][1])]


def test_repeated_key_over_blocks():
    w = sstable.ShardWriter(2)
    body = np.arange(60_000, dtype="<u4").tobytes()
    for k in (1, 2, 2, 2, 2, 2, 2, 2, 3):
        w.add(k, body)
    r = sstable.ShardReader.over(w.finish())
    assert len(r.index) > 2 and len(r.get_all(2)) == 7 and len(r.get_all(3)) == 1 and r.get_all(4) == []


def test_shards_hard_cases(spark, tmp_path):
    for texts in (HARD_TEXTS, []):
        path = f"file://{tmp_path}/{len(texts)}"
        shards = sstable.write_shards(table(spark, texts), path, library_encoder(VOCABULARY), partitions=3)
        assert sstable.read_shards(shards, path).count() == len(texts)


# --- duplicates


def brute_groups(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, size = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    return {i: (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_duplicates(spark, digest_bytes):
    texts = [*HARD_TEXTS, *(f"text {i % 40}" for i in range(400))]
    got = exact_dedup.exact_duplicates(table(spark, texts), digest_bytes=digest_bytes)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()} == brute_groups(texts)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_exact_index_takes_batches(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i) if i % 13 else None, f"text  {int(rng.integers(0, 60))}") for i in rng.permutation(600)]
    batches = [spark.createDataFrame(rows[k : k + 60], "doc_id long, text string").repartition(2) for k in range(0, 600, 60)]
    index, seen = exact_dedup.Index(memtable=20, fan=3), {}
    for k, batch in enumerate(batches):
        hits = {bytes(r["digest"]): r["keep_id"] for r in index.add(batch).collect()}
        own = [(i, hashlib.sha256(t.replace("  ", " ").encode()).digest()) for i, t in rows[60 * k : 60 * k + 60]]
        assert hits == {d: seen[d] for _, d in own if d in seen}
        for i, d in own:
            seen[d] = min((x for x in (seen.get(d), i) if x is not None), default=None)
        assert all(len(level) < 3 for level in index.levels)
    assert len(index.levels) == 3
    runs = exact_dedup.flush_runs(exact_dedup.digested(batches[0].coalesce(1)), 20).collect()
    assert {r["run"] for r in runs} != {0} and all(bytes(a["digest"]) < bytes(b["digest"]) for a, b in zip(runs, runs[1:]) if a["run"] == b["run"])
    sizes = Counter(t for _, t in rows)
    least = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in sizes}
    want = sorted(((i, least[t], sizes[t], i == least[t]) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in index.result().collect()), key=repr) == want


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_ngram_join(spark, sf).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_ngram_join_groups_of_near_copies(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts = list(HARD_TEXTS)
    for size, edits in ((120, 2), (60, 9), (30, 0)):
        base = rng.choice(vocabulary, 150)
        for _ in range(size):
            copy = base.copy()
            copy[rng.integers(0, 150, edits)] = "changed"
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, rng.integers(5, 120))) for _ in range(100)]
    texts += [" ".join(rng.choice(vocabulary[:4], rng.integers(1, 9))) for _ in range(200)]
    for n, num in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(table(spark, texts), n, num, 100).collect()}
        assert got == brute_components(list(enumerate(texts)), n, num, 100)
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0


def test_prefix_holds_shared_shingles():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        size = int(rng.integers(7, 200))
        a = rng.permutation(400)[:size]
        b = np.concatenate([a[: size - int(rng.integers(0, size * 0.1 + 1))], 400 + np.arange(int(rng.integers(0, size * 0.1 + 1)))])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            order = rng.permutation(800)
            first = [sorted(x, key=lambda v: order[v])[: ngram_join.prefix_length(len(x), 85, 100)] for x in (a, b)]
            if all(first):
                assert len(set(first[0]) & set(first[1])) >= 1 + min(len(a), len(b)) // ngram_join.SHARE


@pytest.mark.parametrize(("n", "num", "size"), [(4, 85, 9), (5, 80, 8)])
def test_ngram_join_links_shortest_texts(spark, n, num, size):
    w = "a b c d e f g h i j".split()
    texts = [" ".join(w[:size]), " ".join(w[: size + 1]), " ".join(w[: size - 1]), "z " + " ".join(w[:size])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(table(spark, texts), n, num, 100).collect()}
    assert got == brute_components(list(enumerate(texts)), n, num, 100)
    assert got[0][1] == got[1][1] == got[3][1] == 0


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_ngram_join_every_small_edit(spark, n, num):
    texts = []
    for size in range(1, 12 + n):
        w = [f"v{size}x{k}" for k in range(size)]
        texts += [" ".join(x) for x in (w, ["new", *w], [*w, "new"], w[1:], w[:-1])]
        texts += [" ".join([*w[:k], "new", *w[k + 1 :]]) for k in range(size)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(table(spark, texts), n, num, 100).collect()}
    assert got == brute_components(list(enumerate(texts)), n, num, 100)


def test_ngram_join_repeated_and_null_keys(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice([f"v{i}" for i in range(500)], 80)) for _ in range(6)]
    texts = [t if k % 3 else t + " end" for t in base for k in range(5)] + [None, "", "short", "short"] + base[:1] * 2
    keys = [int(k) if k else None for k in rng.integers(0, 9, len(texts))]
    keys[-1] = keys[-2] = 7
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    want = brute_components(list(enumerate(texts)), 4, 85, 100)
    least, rows = {}, defaultdict(list)
    for i, (_, c) in want.items():
        rows[c].append(keys[i])
    least = {c: min((k for k in ks if k is not None), default=None) for c, ks in rows.items()}
    result = ngram_join.jaccard_components(docs, 4, 85, 100).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in result), key=order) == sorted(((keys[i], n, least[c]) for i, (n, c) in want.items()), key=order)
    # Of each component with a text one row stays, or all rows that are the same.
    assert all(r["doc_id"] == r["component_id"] for r in result if r["kept"])
    assert len({(r["doc_id"], r["row_hash"]) for r in result if r["kept"] and r["n_shingles"]}) == len({c for _, (n, c) in want.items() if n})


def test_prefix_meets_every_size():
    for num in (80, 85):
        for a in range(1, 60):
            for b in range(a, 90):
                for common in range(1, a + 1 if b > a else a):
                    if 100 * common >= num * (a + b - common):
                        # The last place that the first shared shingles can have in either set.
                        need = 1 + a // ngram_join.SHARE
                        assert all(ngram_join.prefix_length(s, num, 100) >= s - common + need for s in (a, b))


# --- quality, mixing


def test_quality_hard_cases(spark):
    got = {r["doc_id"]: r for r in quality.quality(table(spark, HARD_TEXTS)).collect()}
    assert len(got) == len(HARD_TEXTS) and not got[0]["kept"] and got[8]["n_words"] == 60_000 and got[8]["base_failed"]
    assert quality.quality(table(spark, [])).count() == 0


def test_repeated_windows(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60))) for _ in range(200)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        assert got[i] == len({j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})


def test_mix(spark):
    sources = ["a"] * 400 + ["b"] * 40 + [None] * 60 + ["c"] * 5 + ["zero"] * 3
    texts = ["w " * (1 + i % 7) for i in range(505)] + ["", None, " "]
    rows = mixing.mix(table(spark, texts, sources)).collect()
    total = sum(r["size"] for r in rows)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1], by[r["source"]][2] = r["target"], r["source_size"]
    assert math.isclose(sum(t for _, t, _ in by.values()), total) and sum(t for t, _, _ in by.values()) <= total
    assert all(abs(taken - target) <= 8 and target <= 3 * size for taken, target, size in by.values())
    mixed = mixing.apply_mix(table(spark, texts, sources))
    assert mixed.columns == table(spark, []).columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(table(spark, [])).count() == 0


# --- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert (toxic.predicted == 1).mean() > 0.7 and (got[got.toxic == 0].predicted == 1).mean() < 0.02


real = toxicity.written


def test_toxicity_hard_cases(spark):
    docs, labels = table(spark, HARD_TEXTS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scores = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert len(scores) == len(HARD_TEXTS) and all(0 <= s < 0.5 for s in scores)
    assert toxicity.score(table(spark, []), model).count() == 0


def brute_toxicity(rows, labels, seed=1):
    """Scores by dense matrices: rows (doc_id, text), labels {doc_id: toxic}. The sample must hold all rows of the fold."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def parts(w):
        w = w.lower()
        if len(w) < 40:
            return [w] + [w[:k] + "*" for k in (4, 5, 6, 7) if len(w) >= k]
        return [w[i : i + k] + "*" for i in range(len(w)) for k in (4, 5, 6, 7) if len(w) >= i + k]

    def holds(t, stem):
        n = sum(parts(w).count(stem) for w in words(t))
        total = sum(1 if len(w) < 40 else len(w) // 6 for w in words(t))
        return [n >= 1, n >= 2, n >= 3, n >= 2 and n * 300 >= total, n >= 2 and n * 100 >= total]

    fold = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    p_rows = [t for i, t in rows if fold(i) and labels.get(i) == 1]
    # A confirmed text is in both samples, as others are drawn from all.
    u_rows = [t for i, t in rows if fold(i)]
    known = [v for i, v in labels.items() if fold(i)]
    seen = Counter(s for t in p_rows for s in {s for w in words(t) for s in parts(w)})
    stems = sorted((s for s, n in seen.items() if n >= 4), key=lambda s: (-seen[s], s))
    x_p, x_u = (np.array([[b for s in stems for b in holds(t, s)] for t in side], float) for side in (p_rows, u_rows))
    kept = toxicity.marking(np.append(x_p.sum(0), len(x_p)), np.append(x_u.sum(0), len(x_u)))
    as_rows = lambda x: sorted((np.flatnonzero(r) for r in x[:, kept]), key=lambda r: r.astype("<i4").tobytes())
    x_p, x_u = (np.array([[float(k in r) for k in range(len(kept))] for r in map(set, map(np.ndarray.tolist, as_rows(x)))]) for x in (x_p, x_u))
    prior = sum(known) / len(known)
    rng, w, b = np.random.default_rng(seed), np.zeros(len(kept)), math.log(prior / (1 - prior))
    m, v, t = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    steps = max(1, len(x_u) // 512)
    for _ in range(40):
        order_p, order_u = rng.permutation(len(x_p)), rng.permutation(len(x_u))
        for s in range(steps):
            a, c = x_p[order_p[s::steps]], x_u[order_u[s::steps]]
            z_a, z_c = a @ w + b, c @ w + b
            grad = lambda x, slope: np.append(x.T @ slope, slope.sum())
            negative = np.log1p(np.exp(z_c)).mean() - prior * np.log1p(np.exp(z_a)).mean()
            other = grad(c, sigmoid(z_c) / len(c)) - grad(a, prior * sigmoid(z_a) / len(a))
            g = grad(a, prior * (sigmoid(z_a) - 1) / len(a)) + other if negative >= 0 else -other
            g[:-1] += 1e-3 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
    score = lambda t: sigmoid(np.array([x for s in stems for x in holds(t, s)], float)[kept] @ w + b)
    return {i: float(score(t)) for i, t in rows}


def test_toxicity_equals_dense_version(spark):
    rng = np.random.default_rng(11)
    plain, bad = [f"word{i}" for i in range(60)], ["nastyword", "vileness", "hatefully", "x" * 45]
    rows, labels = [], {}
    for i in range(700):
        toxic = i % 6 == 0
        words = [*rng.choice(plain, 15), *(rng.choice(bad, 4) if toxic else [])]
        rows.append((i, " ".join(rng.permutation(words))))
        if i % 2 == 0:
            labels[i] = int(toxic)
    rows += [(700, None), (701, ""), (702, "NASTYWORD " * 30), (703, "pq" * 200 + "nastyword" + "qp" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame([(i, 0, v) for i, v in labels.items()], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got == pytest.approx(brute_toxicity(rows, labels), rel=1e-6)
    assert got[702] > 0.5 > got[700] == got[701]
    # Text without spaces counts wherever its words are.
    run = "pq" * 50_000
    ends = spark.createDataFrame([(0, run), (1, run + "nastywordvileness"), (2, "nastyword" + run + "vileness" + run)], "doc_id long, text string")
    tail = {r["doc_id"]: r["score"] for r in toxicity.score(ends, model).collect()}
    assert tail[1] == tail[2] > tail[0] == got[700]


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_P", 6)
    monkeypatch.setattr(toxicity, "MAX_U", 9)
    seen = []
    monkeypatch.setattr(toxicity, "written", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    # One key has most of the rows; rows that are equal count once.
    rows = [(1 if i % 2 else i, f"word{i % 40} nastyword") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    sample = dict(seen)["sample"]
    assert sample.filter("p").count() == 6 and sample.filter("not p").count() == 9


# --- licenses, personal data


def test_licenses_query(spark):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    got = {r["doc_id"]: r for r in op7_licenses(spark, SF).collect()}
    for doc_id, text in documents():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_rules(spark):
    assert sum(map(len, licenses.signatures().values())) > 300
    labels = lambda t: [d.label for d in licenses.detect(licenses.normalised(t.encode()))]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert labels("Released under the MIT License or CC-BY-SA 4.0") == ["mit", "cc-by-sa"]
    assert labels("nothing here") == []
    assert licenses.scan(table(spark, HARD_TEXTS)).count() == len(HARD_TEXTS) and licenses.scan(table(spark, [])).count() == 0


def expansions(parsed):
    """Strings of a parsed regular expression: each alternative, options with and without."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            tails = [chr(arg)]
        elif op == "IN":
            tails = [chr(v) if str(o) == "LITERAL" else "x" for o, v in arg]
        elif op == "BRANCH":
            tails = [t for branch in arg[1] for t in expansions(branch)]
        elif op == "SUBPATTERN":
            tails = expansions(arg[3])
        else:
            assert op == "MAX_REPEAT"
            tails = [t * k for k in {arg[0], min(arg[1], 1)} for t in expansions(arg[2])]
        out = [a + t for a in out for t in dict.fromkeys(tails)]
    return out


def test_license_names_pass_their_keywords():
    for label, keyword, name in licenses.FAMILIES:
        for text in expansions(re._parser.parse(name)):
            words = f" {text} "
            assert f" {keyword}" in words, (label, text)
            assert re.search(f"(?<= )(?:{name})(?= )".encode(), words.encode()), (label, text)
            assert licenses.detect(words.encode()), (label, text)


def test_written_license_rules_pass_their_keywords():
    for rows, before in ((licenses.IDENTIFIERS, "spdx license identifier "), (licenses.BODIES, ""), (licenses.ADDRESSES, "https www ")):
        for label, keyword, pattern in rows:
            for text in expansions(re._parser.parse(pattern)):
                words = f" {before}{text} "
                found = licenses.detect(re.sub(" +", " ", words).encode())
                assert f" {keyword}" in words and label in {d.label for d in found}, (label, text)
    rules = [r for v in licenses.signatures().values() for r in v]
    assert len({r.pattern.pattern for r in rules}) == len(rules)


def test_license_places_and_containment():
    text = "x y Apache License 2.0 z " * 3 + "SPDX-License-Identifier: GPL-2.0-or-later"
    found = licenses.detect(licenses.normalised(text.encode()))
    assert [(d.label, d.start, d.end) for d in found] == [("apache-2.0", 7 * k + 2, 7 * k + 6) for k in range(3)] + [("gpl-2.0", 21, 29)]
    rng = np.random.default_rng(9)
    for _ in range(200):
        spans = [licenses.Detection("a", "b", int(s), int(s + n), 0, 1.0) for s, n in zip(rng.integers(0, 30, 25), rng.integers(1, 9, 25))]
        taken = []
        for d in spans:
            if not any(t.start <= d.start and d.end <= t.end for t in taken):
                taken.append(d)
        assert licenses._uncontained(spans) == taken


def test_license_scan_of_a_long_text_is_linear():
    text = licenses.normalised(b"word mit license word released under the apache license 2.0 " * 20_000)
    start = time.perf_counter()
    assert len(licenses.detect(text)) == 40_000
    assert time.perf_counter() - start < 20


def test_license_rules_in_other_forms():
    labels = lambda t: [d.label for d in licenses.detect(licenses.normalised(t.encode()))]
    for text in ("Alle Rechte vorbehalten.", "Todos los derechos reservados", "Tous droits réservés", "TOUS DROITS RÉSERVÉS", "tous droits re\u0301serve\u0301s", "Tous droits reserves"):
        assert labels(f"(c) 2020 X. {text}") == ["reserved"]
    assert labels("under the FreeBSD License") == ["bsd-2-clause"]
    assert labels("Creative Commons Attribution-Non-Commercial-ShareAlike 4.0") == ["cc-by-nc-sa"]
    assert labels("Creative Commons Attribution-Non-Commercial-NoDerivs 4.0") == ["cc-by-nc-nd"]


def brute_spans(text):
    def passes(kind, m):
        digits = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m[0])] for k, p in patterns.items()}


def check_spans(got, text):
    want = brute_spans(text)
    assert [got[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
    joined = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
    assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert [s for s in got["spans"].split(",") if s.split(":")[0] in want] == [s for s in joined.split(",") if s]


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in op9_pii(spark, SF).collect()}
    for doc_id, text in documents():
        check_spans(got[doc_id], text or "")


def test_pii_hard_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    parts = ["1.2.3.4", "256.1.1.1", "007.0.0.1", "a.b@c.d_e@f.gh", "@", "x@y", "é", "🙂", " ", "-", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "+", "5", ".", "9" * 25, "DE89 3704 0044 0532 0130 00", "DE00 3704 0044 0532 0130 00", "born 1980-02-31", "born 1980-02-28", "\n"]
    texts = [*HARD_TEXTS, "1" * 100_000, "+1" + " " * 50_000, "a@" + "b." * 20_000 + "c", *("".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(400))]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        check_spans(got[i], t or "")
    assert "iban" in "".join(r["spans"] for r in got.values()) and pii.find_pii(table(spark, [])).count() == 0


def test_pii_finds_secrets(spark):
    yes = ['x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "API_KEY: abcd1234efgh5678", "password=hunter2hunter2", "AKIA" + "ABCD1234EFGH5678", "TOKEN = '9233A8ECF7C5B09F'", "é🙂 secret: a1" + "b" * 30]
    no = ["a token of thanks", "token = yes", "password: correcthorsebattery", "the key is 12", "broken = 04dbebab91ab85687d33"]
    got = [r["spans"] for r in pii.find_pii(table(spark, yes + no)).orderBy("doc_id").collect()]
    found = [{s["kind"]: (s["start"], s["end"]) for s in spans} for spans in got]
    assert all({"secret", "key_id"} & set(f) for f in found[: len(yes)]) and not any({"secret", "key_id"} & set(f) for f in found[len(yes) :])
    assert found[0]["secret"] == (2, 51) and found[5]["secret"] == (3, 3 + len("secret: a1") + 30)


# --- chat


def test_chat_escapes(spark):
    texts = [HARD, "\\", "\\\\h", "\\h###", "#####", "</turn>\n### a: ", "a: b", "", "\\c\\e", "x\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape(chat.escape_role(F.col("t"))).alias("b")).collect():
        assert r["t"] == r["a"] == r["b"]


def test_chat_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "user", None), (1, 4, "assistant", "</turn>"), (1, 5, "user", "tail"), (2, 0, None, "x"), (None, 0, "assistant", "n")]
    schema = "conv_id long, turn long, role string, text string"
    examples = chat.format_conversations(spark.createDataFrame(rows, schema))
    got = [(r["conv_id"], r["text"][r["loss_start"] : r["loss_end"]]) for r in examples.orderBy("conv_id", "example").collect()]
    assert got == [(None, "n"), (1, chat_escape(HARD)), (1, "\\e"), (1, ""), (2, "")]
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in examples.filter("last").select("conv_id", chat.read_turns(F.col("text")).alias("turns")).collect()}
    assert turns[1] == [(r or "", t or "") for _, _, r, t in rows[:6]] and turns[2] == [("", "x")]
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_chat_of_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(2000)]
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = sum(len(f"### {r}: {t}</turn>\n") for _, _, r, t in rows)
    sizes = examples.agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most"), F.sum(F.col("loss_end") - F.col("loss_start")).alias("loss")).first()
    assert (sizes["n"], sizes["most"], sizes["loss"]) == (1000, whole, sum(len(t) for _, _, r, t in rows if r == "assistant"))


def chat_escape(text):
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")


def test_chat_query_has_hard_conversation(spark):
    assert op8_chat(spark, SF).filter("conv_id = -7").first()["n_turns"] == 2


#: Ways in which people name licenses, and what is meant; None: no license is named.
NAMED_LICENSES = (
    ("GPLv2+", "gpl-2.0"), ("licensed under GPLv3+", "gpl-3.0"), ("Apache2", "apache-2.0"), ("BSD-3 license", "bsd-3-clause"), ("under the GPLv2 or later", "gpl-2.0"), ("LGPLv2.1+", "lgpl-2.1"),
    ("AGPLv3", "agpl-3.0"), ("Apache-2.0", "apache-2.0"), ("MIT licence", "mit"), ("the MIT License", "mit"), ("BSD-2-Clause", "bsd-2-clause"), ("released under Apache2 license", "apache-2.0"),
    ("2-clause BSD", "bsd-2-clause"), ("GPL3", "gpl-3.0"), ("MPL2", "mpl-2.0"), ("CC BY-SA 4.0", "cc-by-sa"), ("GNU GPL v3", "gpl-3.0"), ("gpl version 2", "gpl-2.0"), ("Apache License, Version 2.0", "apache-2.0"),
    ("a gplv4x word", None), ("an apache helicopter 2", None), ("bsd 3 times", None), ("the 3-clause sentence", None), ("we commit and permit 2 things", None),
)


def test_named_licenses():
    found = [({d.label for d in licenses.detect(licenses.normalised(t.encode()))}, label) for t, label in NAMED_LICENSES]
    hits = sum(label in got for got, label in found if label)
    assert hits >= 0.9 * sum(label is not None for _, label in found)
    # Labels that aren't meant: none where no license is named, and no other version where one is.
    assert not any(got for got, label in found if not label) and hits >= 0.9 * sum(len(got) for got, _ in found)
