"""Runs that go on after a failure, files one by one against all at once, growing components, stored tables and blocks."""

import itertools
import json
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from goldloom.functions import similarity
from goldloom.operators import blocking, cluster, mapping, matching, serving
from goldloom.operators.store import BucketTable
from goldloom.operators.tables import Conflict
from goldloom.plans import catalogue, pipeline, runs
from goldloom.plans import rules as R
from goldloom.streaming import incremental

COLUMNS = [("PESEL", "PESEL"), ("Imie", "First_Name"), ("Nazwisko", "Last_Name"), ("DataUrodzenia", "Birth_Date"), ("Adres", "Street")]
SCHEMA = "PESEL string, Imie string, Nazwisko string, DataUrodzenia string, Adres string"
PEOPLE = [(f"{44051400000 + k * 13:011d}", f"Imie{chr(97 + k)}", f"Nazw{chr(97 + k)}isko", f"19{40 + k}-0{1 + k % 9}-1{k % 9}", f"ul. Polna {k}, 00-950 Warszawa") for k in range(12)]


def source(spark, n, who):
    rows = [(*PEOPLE[k][:4], PEOPLE[k][4].replace("Polna", "Nowa") if n == 3 else PEOPLE[k][4]) for k in who]
    return pipeline.Source(spark.createDataFrame(rows, SCHEMA), COLUMNS, ["PESEL", "CEIDG", "KNF_AGENT"][n - 1], 1, n, ["PESEL"], f"2024-0{n}-01")


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def state_of(out):
    """What doesn't depend on the order of loads: addresses and groups are numbered as they come, links keep their history."""
    groups = out["groups"].join(out["members"], "group_id").select("component", "group_key", "id")
    active = out["links"].filter("valid_to is null").join(out["addresses"], "address_id").drop("address_id", "valid_from")
    return {"groups": rows_of(groups), "active": rows_of(active)} | {t: rows_of(out[t]) for t in ("labels", "dimension", "owners")}


def test_one_by_one_as_all_at_once_and_resumed(spark, tmp_path, monkeypatch):
    files = [source(spark, 1, range(0, 7)), source(spark, 3, [1, 3, 4, 8, 9])]
    want = state_of(pipeline.run_all(spark, files, "PERSON", f"file://{tmp_path}/whole"))
    path = f"file://{tmp_path}/one"
    pipeline.run_all(spark, files[:1], "PERSON", path)

    # The second run is killed before several steps, and called again each time.
    real, pending = runs.Run.step, {"LABELS", "LINKS"}

    def dying(self, name, rows_in, make, *a, **k):
        if name in pending:
            pending.remove(name)
            raise RuntimeError(f"killed at {name}")
        return real(self, name, rows_in, make, *a, **k)

    monkeypatch.setattr(runs.Run, "step", dying)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="killed"):
            pipeline.run_all(spark, files[1:], "PERSON", path)
    last = pipeline.run_all(spark, files[1:], "PERSON", path)
    assert state_of(last) == want
    # The second file's records met those of the first, which didn't meet each other again; the groups that they touch were loaded.
    assert last["candidates"].filter(F.col("right_id") < 3 * pipeline.FILE_ROWS).count() == 0 and last["records"].count() == 12
    assert 5 <= last["matched"].count() < last["dimension"].count()

    log = runs.run_log(spark, path, "PERSON").collect()
    assert {r["run"] for r in log} == {"files-1-1-1", "files-3-3-1"} and {(r["run_status"], r["status"]) for r in log} == {("DONE", "SUCCESS")}
    assert {r["records_out"] for r in log if r["step"] == "STAGING"} == {7, 5} and {r["attempts"] for r in log} == {1}
    with pytest.raises(ValueError, match="loaded already"):
        pipeline.run_all(spark, files[1:], "PERSON", path)


def test_failed_step_is_noted_and_tried_again(spark, tmp_path, monkeypatch):
    path, one = f"file://{tmp_path}", source(spark, 1, [0, 1])
    broken = pipeline.Source(one.rows.withColumn("Imie", F.raise_error(F.lit("broken"))), COLUMNS, "PESEL", 1, 1, ["PESEL"])
    with pytest.raises(Exception, match="broken"):
        pipeline.run_source(spark, broken.rows, COLUMNS, "PERSON", 1, 1, path, ["PESEL"])
    assert [(r["step"], r["status"], r["run_status"], "broken" in r["error"]) for r in runs.run_log(spark, path, "PERSON").collect()] == [("STAGING", "FAILED", "FAILED", True)]
    log = pipeline.Log()
    kept = pipeline.run_source(spark, one.rows, COLUMNS, "PERSON", 1, 1, path, ["PESEL"], log=log)
    assert kept["staging"].count() == 2 and pipeline.batch_status(log) == "STAGING_LOADED"
    assert {r["step"]: r["attempts"] for r in runs.run_log(spark, path, "PERSON").collect()} == {"STAGING": 2, "PREPROCESSED": 1, "VALIDATION": 1}
    # Its steps are read, not made again.
    monkeypatch.setattr(pipeline.mapping, "stage", lambda *a: pytest.fail("made again"))
    assert pipeline.run_source(spark, one.rows, COLUMNS, "PERSON", 1, 1, path, ["PESEL"])["validation"].count() == kept["validation"].count()
    with pytest.raises(Conflict, match="part of the unfinished run"):
        runs.Run(spark, path, "PERSON", [1, 2])
    other = runs.Run(spark, path, "PERSON", [7])
    other.finish()
    with pytest.raises(Conflict, match="was done after"):
        runs.Run(spark, path, "PERSON", [1])


def test_growing_components(spark):
    rng = random.Random(8)
    labels, links, members = spark.createDataFrame([], "id long, component long"), [], set()
    for _ in range(4):
        new = {rng.randrange(400) for _ in range(60)}
        pairs = [tuple(sorted(rng.sample(sorted(members | new), 2))) for _ in range(25)]
        before = {r["id"]: r["component"] for r in labels.collect()}
        labels, touched = cluster.grow_components(labels, spark.createDataFrame(pairs, "left_id long, right_id long"), spark.createDataFrame([(i,) for i in new], "id long"))
        links, members = links + pairs, members | new
        whole = cluster.connected_components(spark.createDataFrame(links, "left_id long, right_id long"), spark.createDataFrame([(i,) for i in members], "id long"))
        after = {r["id"]: r["component"] for r in labels.collect()}
        assert after == {r["id"]: r["component"] for r in whole.collect()}
        hit = {r["component"] for r in touched.collect()}
        assert all(after[i] in hit for i in new) and all(after[i] in hit for i, old in before.items() if after[i] != old)


def test_stored_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    row = lambda i, v: (i, None if i % 50 == 49 else f"k{i}", v)
    made = lambda rows: spark.createDataFrame(rows, "a long, b string, v string")
    table = BucketTable.create(made([row(i, f"v{i}") for i in range(6000)]), path, ["a", "b"], file_rows=30)
    files = len(table.state()["files"])
    assert table.state()["buckets"] == 200
    change = [row(7, "new"), row(49, "new"), row(100, None), row(8, "v8")]
    did = table.upsert(made(change))
    # Of four rows one is as it was; at most three of 200 files are written anew.
    assert did["changed"] == 3 and did["new"] == 0 and did["rewritten"] <= 3 and did["files"] == files
    assert table.upsert(made(change)) == did | {"rewritten": 0, "added": 0, "changed": 0}
    assert {(r["a"], r["v"]) for r in table.read().filter("a in (7, 8, 49, 100)").collect()} == {(7, "new"), (8, "v8"), (49, "new"), (100, None)}
    assert table.read(1).filter("v = 'new' or v is null").count() == 0
    did = table.upsert(made([row(9000, "x")]), remove=made([row(5, ""), row(49, ""), row(70_000, "")]))
    assert did["new"] == 1 and did["changed"] == 2 and table.read().count() == 5999
    with pytest.raises(ValueError, match="repeat a key"):
        table.upsert(made([row(1, "x"), row(1, "y")]))
    with pytest.raises(Conflict):
        table._commit(table.state(1), [])


def test_stored_table_puts_files_together(spark, tmp_path):
    made = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "a long, v long")
    table = BucketTable.create(made(), f"file://{tmp_path}/t", ["a"])
    assert table.read().count() == 0 and table.upsert(made()) == {"version": 1, "files": 0, "rewritten": 0, "added": 0, "changed": 0, "new": 0}
    sizes = [table.upsert(made(i))["files"] for i in range(10)]
    assert max(sizes) == 8 and table.read().count() == 10


KEYS = (("name:4", "city"), ("code", "city"), ("name|city", "code"))


def brute_pairs(rows, scope):
    least = R.LEAST_PREFIX

    def values(r, part, short):
        name, _, cut = part.partition(":")
        for column in name.split("|"):
            v = (r[{"name": 1, "city": 2, "code": 3}[column]] or "").strip()
            if v and (not cut or len(v) >= least):
                yield v[: least if short else int(cut)] if cut else v

    def keys(r, short):
        chosen = [k for k in KEYS if any(":" in p for p in k)] if short else KEYS
        return {(n, x) for n, k in enumerate(chosen) for x in itertools.product(*(list(values(r, p, short)) for p in k))}

    exact = lambda r: len((r[1] or "").strip()) == least
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (not scope or 2 in (a[4], b[4])) and (keys(a, False) & keys(b, False) or (exact(a) or exact(b)) and keys(a, True) & keys(b, True))}


@pytest.mark.parametrize("scoped", [False, True])
def test_blocks_brute_force(spark, scoped):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "anna", "ann", "annabel", "bob", "bo", "bobby"]), rng.choice("xyz"), rng.choice(["1", "2", None]), i % 3) for i in range(150)]
    records = spark.createDataFrame(rows, "id long, name string, city string, code string, raw int")
    for block in (2000, 7):
        got = [tuple(r) for r in blocking.candidate_pairs(records, "id", KEYS, F.col("raw") == 2 if scoped else None, block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, scoped)


def test_frequent_key_is_spread(spark):
    """A key of 1 % of the records: its pairs are dealt to all tasks, and no distinct is needed."""
    records = spark.range(40_000).select("id", F.when(F.col("id") % 100 == 0, "hot").otherwise(F.concat(F.lit("k"), F.floor(F.col("id") / 7))).alias("k"))
    pairs = blocking.candidate_pairs(records, "id", (("k",),), block=20)
    sizes = sorted(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == pairs.count() and sum(sizes) >= 400 * 399 // 2
    dealt = [n for n in sizes if n > 5000]
    assert len(dealt) >= 4 and dealt[-1] <= 2 * dealt[len(dealt) // 2]
    assert "HashAggregate(keys=[left_id" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_stream_batches_become_runs(spark, tmp_path, monkeypatch):
    path, loaded = f"file://{tmp_path}/runs", []

    def run_all(session, sources, entity, where):
        loaded.append((sources[0].raw_file, sources[0].rows.count()))
        runs.Run(session, where, entity, [sources[0].raw_file]).finish()

    monkeypatch.setattr(incremental.pipeline, "run_all", run_all)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"PESEL": "1"}\n{"PESEL": "2"}\n')
    load = incremental.load_runs([("PESEL", "PESEL")], "PESEL", "PERSON", path, ["PESEL"], first=5)
    follow = lambda: incremental.follow(spark, str(tmp_path / "in"), "PESEL string", str(tmp_path / "seen"), load).awaitTermination()
    follow()
    (tmp_path / "in/b.json").write_text('{"PESEL": "3"}\n')
    follow()
    # A batch that comes again is known.
    load(spark.createDataFrame([("3",)], "PESEL string"), 1)
    assert loaded == [(5, 2), (6, 1)]


def test_preprocessing_stamp(spark):
    made = json.loads(spark.range(1).select(mapping.preprocessing_stamp().alias("s")).first()["s"])
    assert {k: v for k, v in made.items() if k != "generated_at_utc"} == {"text": "trim_uppercase", "phone": "e164_when_possible", "address": "regex_split"}
    assert len(made["generated_at_utc"]) == 19


def test_deep_pages_are_as_shallow_ones(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 11).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 97).alias("_place"))
    order = [F.col("g").desc(), F.col("_place"), F.col("id")]
    for offset in (0, 37, 1500, 2990, 3000):
        shallow, deep = (serving.page(rows, order, 50, offset, d).collect() for d in (10_000, 0))
        assert shallow == deep and len(deep) == min(50, 3000 - offset)


def _copied(spark, tmp_path, name, key, copies, shift):
    """A table of sf0.001 with copies of its rows, whose keys are shifted."""
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    many = rows.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(key, (F.col(key) + F.col("_n") * shift).cast("long")).drop("_n")
    many.repartition(1).write.parquet(f"{tmp_path}/{name}.parquet")


def test_persons_have_no_budget(spark, tmp_path):
    """2,100 persons of one PESEL make more than R.MAX_PAIRS pairs, which these queries' SQL has, too."""
    _copied(spark, tmp_path, "customer", "c_custkey", 14, 400 * 150)
    customers = spark.read.parquet(f"{tmp_path}/customer.parquet")
    customers.withColumn("c_custkey", F.col("c_custkey") * 400).write.parquet(f"{tmp_path}/one/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/one/nation.parquet")
    found = {name: catalogue.QUERIES[name](spark, f"{tmp_path}/one") for name in ("match_persons", "scoped_pairs", "incremental_groups")}
    assert customers.count() == 2100 and found["match_persons"].count() > R.MAX_PAIRS
    files = [r[0] for r in customers.select(F.col("c_custkey") * 400 % 3).collect()]
    old = sum(f != 2 for f in files)
    assert found["scoped_pairs"].count() <= 2100 * 2099 // 2 - old * (old - 1) // 2
    assert found["incremental_groups"].count() == 2100


def _written(spark, run):
    """Bytes of run's files below the shared folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(f.stat().st_size for f in Path(base).rglob("*") if f.is_file())
    before = size()
    run()
    return size() - before


@pytest.mark.parametrize("name", ["match_stage1", "match_decisions", "match_stage2", "stage2_flag", "pair_comparison", "candidate_list", "lev_similarity", "blocking_pairs_union", "blocking_pairs_exact"])
def test_copies_are_compared_once(spark, tmp_path, name):
    """Copies of all parts: nothing written or shuffled grows with pairs, only with parts; the rows are those of the SQL."""
    _copied(spark, tmp_path, "part", "p_partkey", 12, 2000)
    query, sql = catalogue.QUERIES[name], catalogue.SQL[name]
    folder = str(tmp_path)
    got = []
    bytes_written = _written(spark, lambda: got.extend(tuple(r) for r in query(spark, folder).collect()))
    assert bytes_written < 200_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    want = con.execute(sql).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(left_id" not in plan and "hashpartitioning(right_id" not in plan


def test_units_scoped_brute_force(spark):
    """Many records that are alike, in units smaller and larger than the least, scoped or not, each pair once."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["anna", "ann", "bob"]), rng.choice("xy"), rng.choice(["1", None]), i % 3) for i in range(120)]
    records = spark.createDataFrame(rows, "id long, name string, city string, code string, raw int")
    for scoped in (False, True):
        for block in (2000, 12):
            scope = F.col("raw") == 2 if scoped else None
            units = blocking.candidate_units(records, "id", KEYS, {"name": F.col("name")}, scope, block)
            got = [tuple(r) for r in blocking.expand(units.select("l_ids", "r_ids", F.col("l.name").alias("l"), F.col("r.name").alias("r")), "l", "r").collect()]
            assert len(got) == len(set(got)) and {g[:2] for g in got} == brute_pairs(rows, scoped)
            assert all(g[2:] == (rows[g[0]][1], rows[g[1]][1]) for g in got)
            assert blocking.weighed(units).agg(F.sum("pairs")).first()[0] == len(got)


def test_spanning_links_connect_the_same(spark):
    units = spark.createDataFrame([([1, 4], [1, 4]), ([2, 6], [3]), ([3], [2, 6]), ([3], [7]), ([8], [9])], "l_ids array<long>, r_ids array<long>").repartition(3)
    of = lambda pairs: {r["id"]: r["component"] for r in cluster.connected_components(pairs).collect()}
    assert of(cluster.spanning_links(units)) == of(blocking.expand(units)) == {1: 1, 4: 1, 2: 2, 6: 2, 3: 2, 7: 2, 8: 8, 9: 8}


@pytest.mark.parametrize("most", [500, 3])
def test_fields_look_up_or_cut(spark, monkeypatch, most):
    """Few values: no edit distance by pair; many: without the ends that all share. Both as of whole texts."""
    monkeypatch.setattr(matching, "MOST_VALUES", most)
    names = ["Customer#0012x", "Customer#0013x", "customer#00x", "Customer#00 x", None, " ", "Customer#0x", "Customer#00ŁÓx"]
    records = spark.createDataFrame([(i, "b", n) for i, n in enumerate(names * 2)], "id long, k string, n string")
    rules = (R.FieldRule("Name", 0.75, R.SEMI_FIXED, ("n",)),)
    fields = matching.Fields(records, rules, rules)
    units = fields.units("id", (("k",),))
    both = matching.once(units, ["l_ids", "r_ids"], {"lev": fields.similarity(rules[0]), "jw": fields.similarity(rules[0], "jaro_winkler")})
    got = {(r[0], r[1]): (r[2], r[3]) for r in blocking.expand(both, "lev", "jw").collect()}
    a, b = (records.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "n"))) for s in "ab")
    shown = lambda how: F.when((F.trim("a_n") != "") & (F.trim("b_n") != ""), how(F.col("a_n"), F.col("b_n")))
    pairs = a.join(b, F.col("a_id") < F.col("b_id")).select("a_id", "b_id", shown(similarity.levenshtein), shown(similarity.jaro_winkler))
    assert got == {(r[0], r[1]): (r[2], r[3]) for r in pairs.collect()}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert ("levenshtein(" in plan) == (most == 3)
