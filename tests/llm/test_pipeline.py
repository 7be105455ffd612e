"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_operators import DOCS, HARD_TEXTS, brute_components, table
from tokenizers import Tokenizer

import corpus_pipeline
from goldloom.llm import toxicity

SF = "/root/testdata/sf0.001"
NULLS_FIRST = lambda v: (v is not None, v or 0)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs or out["documents"], SF)
        path = str(tmp_path_factory.mktemp("stage") / "t.parquet")
        docs.write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return {k: v.toPandas() for k, v in out.items()}


def test_columns_and_toxic(stages):
    names = list(stages)
    assert all(list(stages[n].columns) == list(stages["documents"].columns) for n in names[:-1])
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df().set_index("doc_id").toxic
    dropped = set(stages["documents"].doc_id) - set(stages["toxicity"].doc_id)
    known = [labels[i] for i in dropped if i in labels.index]
    assert not known or sum(known) / len(known) > 0.8


def test_exact(stages):
    norm = lambda d: [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in d.text]
    before, after = stages["toxicity"].sort_values("doc_id"), stages["exact dedup"]
    first = {}
    for i, t in zip(before.doc_id, norm(before)):
        first.setdefault(t, i)
    assert sorted(after.doc_id) == sorted(first.values())


def test_near(stages):
    before, after = stages["exact dedup"], stages["n-gram Jaccard join"]
    found = brute_components(list(zip(before.doc_id, before.text)), 5, 80, 100)
    assert sorted(after.doc_id) == sorted(i for i, (_, c) in found.items() if i == c)


def test_toxic_texts_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sorted(stages["toxicity"].doc_id) == sorted(i for i, s in scores.items() if s < 0.5)


def brute_mix(rows, seed=1):
    """How often each (doc_id, source, text) is taken."""
    docs = [((s is None, s or ""), hashlib.md5(f"{seed}:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), NULLS_FIRST(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), (i, s, t)) for i, s, t in rows]
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[0]] += d[3]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_weight = total - sum(3 * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and weight[s] * rest > 3 * sizes[s] * open_weight}
        if not more:
            break
        full |= more
    target = {s: 3.0 * sizes[s] if s in full else weight[s] * rest / open_weight for s in sizes}
    done, copies = defaultdict(int), []
    for s, order, key, size, row in sorted(docs, key=lambda d: d[:4]):
        done[s] += size
        copies += [((c * sizes[s] + done[s]) / target[s], s, order, key, size, row) for c in range(3) if target[s]]
    taken, upto = Counter(), 0
    for *_, size, row in sorted(copies, key=lambda c: c[:4]):
        upto += size
        if upto <= total:
            taken[row] += 1
    return taken


def test_mix(stages):
    before, after = stages["n-gram Jaccard join"], stages["mixing"]
    rows = lambda d: zip(d.doc_id, d.source, d.text)
    assert Counter(rows(after)) == brute_mix(list(rows(before)))


def test_encoding(stages):
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    before, after = stages["mixing"], stages["BPE"]
    want = Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, x in zip(before.doc_id, before.text))
    assert Counter(zip(after.doc_id, map(bytes, after.token_ids))) == want
    assert after.lossless.all() and (after.n_tokens == after.token_ids.map(len) // 4).all()


def test_null_and_repeated_keys(spark):
    rng = np.random.default_rng(12)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 60)) for _ in range(12)]
    texts = [*base, *(t + " end" for t in base), *base[:6], None, None, "", "lone word", "lone word"]
    keys = [None if k % 7 == 0 else int(k % 11) for k in range(len(texts))]
    rows = [(i, t, "en", [None, "a", "b"][k % 3], 1, "w", "x", "k", 1) for k, (i, t) in enumerate(zip(keys, texts))]
    docs = spark.createDataFrame(rows + rows[:3], DOCS).repartition(3)
    names = lambda d: [(r["doc_id"], r["source"], r["text"]) for r in d.collect()]
    assert Counter(names(corpus_pipeline.toxicity(spark, docs, SF))) == Counter(names(docs))

    exact, groups = names(corpus_pipeline.exact(spark, docs, SF)), defaultdict(list)
    for i, _, t in names(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    assert sorted(((i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, _, t in exact), key=repr) == sorted(((least(ids), t) for t, ids in groups.items()), key=repr)

    near = names(corpus_pipeline.near(spark, docs, SF))
    members = defaultdict(list)
    every = names(docs)
    for k, (n, c) in brute_components([(k, t) for k, (_, _, t) in enumerate(every)], 5, 80, 100).items():
        members[c if n else (k, "empty")].append(every[k])
    assert len([r for r in near if r[2] and r[2].strip()]) == sum(isinstance(c, int) for c in members)
    assert Counter(r[0] for r in near if r[2] and r[2].strip()) == Counter(least([i for i, _, _ in m]) for c, m in members.items() if isinstance(c, int))
    assert Counter(r for r in near if not r[2]) == Counter({r: 1 for r in every if not r[2]})

    assert Counter(names(corpus_pipeline.mixing(spark, docs, SF))) == brute_mix(names(docs))
    assert corpus_pipeline.encoding(spark, docs, SF).count() == docs.count()


def test_hard_tables(spark):
    for texts in (HARD_TEXTS, []):
        docs = table(spark, texts)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if name != "mixing":
                kept = docs.count()
                assert kept == before.count() if name in ("toxicity", "BPE") else kept <= before.count()
            assert bool(texts) == bool(docs.count())
