"""Known values, shapes of sources and properties of the engine."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from goldloom.functions import address, checks, dates, fuzzy, similarity, text
from goldloom.operators import blocking, cluster, constraints, mapping, matching, serving, survivorship, tables, validation
from goldloom.plans import catalogue, pipeline
from goldloom.plans import rules as R
from goldloom.sources import files, registers, relational, teryt, xlsx
from goldloom.streaming import incremental

c = F.col

_FIRST = "ADAM ANNA EWA JAN MARIA PIOTR TOMASZ ZOFIA OLGA MAREK".split()
_LAST = "NOWAK KOWALSKI WOJCIK LEWANDOWSKI ZIELINSKI SZYMANSKI MAZUR KROL DUDA BARAN".split()


def _draw(salt, n):
    return F.pmod(F.xxhash64("entity", F.lit(salt)), F.lit(n))


def _pick(words: list[str], salt: int):
    return F.element_at(F.array(*map(F.lit, words)), (_draw(salt, len(words)) + 1).cast("int"))


def with_check_digit(body, weights: tuple[int, ...], rule: str):
    total = checks.weighted(body, weights)
    return F.concat(body, ((10 - total % 10) % 10 if rule == "pesel" else total % 11 % 10).cast("string"))


def made_persons(spark, entities: int, copies: int = 2, typo_rate: int = 50):
    """entities x copies preprocessed rows with entity; one in typo_rate last names lacks its last letter in a copy."""
    base = spark.range(entities).select(F.col("id").alias("entity"))
    year, month, day = 50 + _draw(1, 50), 1 + _draw(2, 12), 1 + _draw(3, 28)
    body = F.format_string("%02d%02d%02d%04d", year, month, day, F.pmod(F.col("entity"), F.lit(10000)))
    rows = base.select("entity", with_check_digit(body, checks.PESEL_WEIGHTS, "pesel").alias("PESEL_Normalized"), _pick(_FIRST, 4).alias("First_Name_Normalized"), F.concat(_pick(_LAST, 5), F.col("entity").cast("string")).alias("Last_Name_Normalized"), F.make_date((1900 + year).cast("int"), month.cast("int"), day.cast("int")).alias("Birth_Date"), F.concat(F.lit("user"), F.col("entity"), F.lit("@example.org")).alias("Email_Normalized"))
    copied = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    typo = (F.col("copy") > 0) & (_draw(6, typo_rate) == 0)
    last = F.when(typo, F.expr("left(Last_Name_Normalized, length(Last_Name_Normalized) - 1)")).otherwise(F.col("Last_Name_Normalized"))
    return copied.withColumn("Last_Name_Normalized", last).withColumn("Preprocessed_ID", F.col("entity") * copies + F.col("copy"))


def one(spark, make, *values):
    """make's value for each text."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", make(c("v")).alias("x")).orderBy("i").collect()]


def test_checks(spark):
    assert one(spark, checks.pesel, "44051401359", "44051401358", None, "x") == [True, False, False, False]
    assert one(spark, checks.nip, "8567346215", "8567346216", "") == [True, False, False]
    assert one(spark, checks.regon, "590096454", "590096455", "5900964541") == [True, False, False]
    assert one(spark, checks.lei, "529900T8BM49AURSDO55", "529900T8BM49AURSDO54") == [True, False]
    assert one(spark, checks.id_card, "ABA300000", "ABA300001") == [True, False]
    assert one(spark, checks.pesel_birth_date, "44051401359", "02270803628", "44133201359") == [dt.date(1944, 5, 14), dt.date(2002, 7, 8), None]
    assert one(spark, checks.person_name, "ŻÓŁĆ-NOWAK", "jan", "A1") == [True, False, False]


def test_dates(spark):
    got = one(spark, dates.lenient_date, "2024-05-01", "2024-05-13", "20240501", "01.05.2024", "13/05/2024", "2024-05-01T10:00:00Z", "202405011230", "nothing", "", None)
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 5, 13), dt.date(2024, 5, 1), dt.date(2024, 5, 1), dt.date(2024, 5, 13), dt.date(2024, 5, 1), dt.date(2024, 5, 1), None, None, None]
    assert one(spark, lambda v: dates.lenient_date(v, "ISO"), "2024-05-01") == [dt.date(2024, 5, 1)]


def test_text(spark):
    assert one(spark, text.text_key, "  łódź \t x ", " ", None) == ["ŁÓDŹ X", None, None]
    assert one(spark, text.city, "Tczew 83-110 Tczew", "Nowy Sącz Nowy Sącz", "Opole") == ["TCZEW", "NOWY SĄCZ", "OPOLE"]
    assert one(spark, text.postal_code, "12345", "12-345", "ab 1") == ["12-345", "12-345", "AB 1"]
    assert one(spark, text.phone, "600 100 200", "48600100200", "+1 555 0100", "x") == ["+48600100200", "+48600100200", "+15550100", None]
    assert one(spark, text.website, "https://www.Example.pl/a", "http://x.pl") == ["example.pl/a", "x.pl"]
    assert one(spark, text.legal_form, "Alfa spółka z ograniczoną odpowiedzialnością", "Beta S.A.", "Gamma sp. z o.o.", "Delta") == ["SP. Z O.O.", "S.A.", "SP. Z O.O.", None]
    assert one(spark, text.short_name, "Gamma, sp. z o.o.", "Delta") == ["Gamma", "Delta"]
    assert one(spark, text.json_list, '["a"]', "x, y", '"z"', " ") == [["a"], ["x", "y"], ["z"], None]
    assert one(spark, text.json_key, '{"b":1,"a":2}', "x") == ['{"A":2,"B":1}', "X"]
    assert one(spark, text.sanitize, "a b​ c ") == ["ab c"]


def test_addresses(spark):
    split = lambda v: address.split_address(v, *[F.lit(None).cast("string")] * 5)
    got = one(spark, split, "ul. Polna 5 m. 3, 00-950 Warszawa", "Warszawa, al. Jana 7A", "12", "os. Leśne 4/2", "00-950 Warszawa, Polna 1", None)
    rows = [(r["street"], r["building"], r["apartment"], r["city"], r["postal_code"]) for r in got]
    assert rows == [("UL Polna", "5", "3", "WARSZAWA", "00-950"), ("AL Jana", "7A", None, "WARSZAWA", None), (None, "12", None, None, None), ("OS Leśne", "4", "2", None, None), ("UL Polna", "1", None, "WARSZAWA", "00-950"), (None,) * 5]


def test_similarity(spark):
    assert round(similarity.jaro_winkler_pair("martha", "marhta"), 4) == 0.9611 and similarity.jaro_winkler_pair("", "") == 1.0 and similarity.jaro_winkler_pair("a", "") == 0.0
    assert one(spark, lambda v: F.round(similarity.levenshtein(v, F.lit("Łódź")), 4), "ŁÓDŹ", "LODZ") == [1.0, 0.25]


def test_decisions(spark):
    df = spark.createDataFrame([(0.96, [], [], []), (0.96, [], ["PESEL"], ["PESEL"]), (0.6, ["NIP"], [], []), (0.91, [], [], []), (0.91, [], ["City"], []), (0.75, [], ["a", "b", "c"], ["a", "b", "c"]), (0.55, [], [], []), (0.1, [], [], [])], "s double, strong array<string>, conf array<string>, block array<string>")
    got = [r["d"] for r in df.select(matching.decide_stage1(c("s"), c("strong"), c("conf"), c("block")).alias("d")).collect()]
    assert got == ["AUTO_MERGE", "REVIEW", "AUTO_MERGE", "AUTO_MERGE", "REVIEW", "NO_MATCH", "CANDIDATE", "NO_MATCH"]


def test_short_prefix_blocks(spark):
    rows = spark.createDataFrame([(1, "ABC", "X"), (2, "ABCD", "X"), (3, "ABCE", "X"), (4, "AB", "X")], "id long, name string, city string")
    assert {(r["left_id"], r["right_id"]) for r in blocking.candidate_pairs(rows, "id", (("city", "name:4"),)).collect()} == {(1, 2), (1, 3)}
    with pytest.raises(blocking.TooManyPairs):
        blocking.entity_pairs(spark.range(5).select(c("id").alias("Preprocessed_ID"), F.lit("1").alias("NIP_Normalized")), "PARTY", max_pairs=3)


def test_survivor_labels(spark):
    rows = [(1, 1, "a", 0, 0.5, None, "PASS"), (1, 2, "b", 1, 0.9, None, "ERROR"), (2, 3, "a", 1, 0.5, None, None), (2, 4, "b", 0, 0.5, None, None), (3, 5, "a", 0, 0.5, None, None), (3, 6, "b", 0, 0.9, None, None), (4, 7, "a", 0, 0.5, dt.datetime(2024, 1, 1), None), (4, 8, "b", 0, 0.5, None, None), (5, 9, "a", 0, 0.5, None, None), (5, 10, "b", 0, 0.5, None, None), (6, 11, " ", 0, 0.5, None, None), (6, 12, "b", 0, 0.5, None, None)]
    df = spark.createDataFrame(rows, "group_id int, member_id int, value string, rank int, trust double, import_ts timestamp, status string")
    got = {r["group_id"]: (r["value"], r["rule"]) for r in survivorship.survivors(df, ["group_id"]).collect()}
    assert got == {1: ("a", "PASSED_VALIDATION"), 2: ("b", "SOURCE_PRIORITY"), 3: ("b", "TRUST_LEVEL"), 4: ("a", "NEWEST_IMPORT"), 5: ("a", "INPUT_ORDER_FALLBACK"), 6: ("b", "NON_EMPTY_VALUE")}


def test_slots_and_drift(spark):
    src = spark.createDataFrame([("", "", "", "Ewa", "Kot", "44051401359", "z")], "CzlonekZarzadu1_Imie string, CzlonekZarzadu1_Nazwisko string, CzlonekZarzadu1_PESEL string, Prokurent2_Imie string, Prokurent2_Nazwisko string, Prokurent2_PESEL string, extra string")
    m = [(f"{p}_{f}", t) for p in ("CzlonekZarzadu1", "Prokurent2") for f, t in (("Imie", "First_Name"), ("Nazwisko", "Last_Name"), ("PESEL", "PESEL"))]
    r = mapping.map_columns(src, m, "PERSON").first()
    assert (r["canon_First_Name"], r["canon_Last_Name"], r["canon_PESEL"]) == ("Ewa", "Kot", "44051401359")
    people = json.loads(src.select(mapping.related_persons(src).alias("x")).first()["x"])
    assert people == [{"role_group": "PROXY", "slot": 2, "first_name": "Ewa", "last_name": "Kot", "pesel": "44051401359"}]
    assert mapping.drift(src, [("absent", "City")]) == (["absent"], ["extra"])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿A,B\n1,\"x, y\"\n,z\n".encode())
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/a.csv").collect()] == [("1", "x, y"), (None, "z")]
    (tmp_path / "a.json").write_text('[{"a": 1, "n": {"b": "x"}}]')
    assert files.read_json(spark, f"file://{tmp_path}/a.json").select("n.b").first()[0] == "x"
    (tmp_path / "a.xml").write_text('<r><record><field name="nip">007</field></record><record><field name="k">v</field></record></r>')
    assert sorted((r["nip"] or "", r["k"] or "") for r in files.read_xml(spark, f"file://{tmp_path}/a.xml").collect()) == [("", "v"), ("007", "")]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"/><row r="2"><c r="A2" t="inlineStr"><is><t> A </t></is></c><c r="C2" t="inlineStr"><is><t>C</t></is></c></row><row r="3"><c r="A3"><v>5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert list(xlsx.records(str(tmp_path / "a.xlsx"))) == [("5", None)]
    assert [r.asDict() for r in files.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [{"A": "5", "C": None}]
    assert files.count_records(spark, f"file://{tmp_path}/a.csv") == 2 and files.count_lines(spark, f"file://{tmp_path}/a.csv") == 3
    landed = files.land(spark, f"file://{tmp_path}/a.csv", "krs")
    assert landed.count() == 1 and files.land(spark, f"file://{tmp_path}/a.*", "vat", landed).count() == 3
    for bad in ("x", "a.txt"):
        with pytest.raises(ValueError):
            files.file_type(bad)
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "RawFile_ID int, n int, v string")
    files.replace_scope(rows, f"file://{tmp_path}/t", ["RawFile_ID"])
    files.replace_scope(rows.filter("RawFile_ID = 2").withColumn("v", F.lit("c")), f"file://{tmp_path}/t", ["RawFile_ID"])
    assert {(r["RawFile_ID"], r["v"]) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(ValueError):
        files.refuse_reload(rows, 1)


def test_relational(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "CLIENT_ACCOUNT": make([(1, "ORG", "Alfa", 9), (2, "PERSON", "Jan Kot", None)], "CUST_UID int, SUBJECT_KIND string, PARTY_LABEL string, ORG_UNIT_ID int"),
        "ORG_UNIT": make([(9, "U")], "ORG_UNIT_ID int, UNIT_LABEL string"),
        "CUSTOMER_IDENTIFIER": make([(1, "NIP", "123")], "CUST_UID int, REF_KIND string, REF_VALUE string"),
        "CUSTOMER_ADDRESS": make([(1, "SEAT", "a", "b", "c", "d", "PL")], "CUST_UID int, LOC_ROLE string, LINE_1 string, LINE_2 string, CITY_HINT string, POST_AREA string, ISO_MARKET string"),
        "CLIENT_CONTACT_LOG": make([(1, "EMAIL", "x@y.pl", 1), (1, "PHONE", "6", 0)], "CUST_UID int, CHANNEL_CODE string, CONTACT_PAYLOAD string, IS_CONFIRMED int"),
        "PAYMENT_ACCOUNT": make([(1, "acc", 1)], "CUST_UID int, CLEARING_REF string, IS_ACTIVE int"),
        "CONTRACT_PARTY": make([(5, 1), (6, 1)], "DEAL_ID int, CUST_UID int"),
        "AGENT_ASSIGNMENT": make([(7, 1, "Ewa", "Lis", "44", "L", "AGENT", None, None)], "ASSIGNMENT_ID int, CUST_UID int, GIVEN_TXT string, FAMILY_TXT string, NATIONAL_REF string, LICENSE_TOKEN string, ROLE_BUCKET string, VALID_SINCE date, VALID_UNTIL date"),
        "RELATED_CLIENT": make([(8, 1, 2, "OWNER", None, None)], "RELATION_ID int, PARENT_UID int, CHILD_UID int, LINK_BUCKET string, VALID_SINCE date, VALID_UNTIL date"),
    }
    row = relational.find_extract("insurance_core", "default", "party").build(tables.__getitem__).first()
    assert (row["nip"], row["email"], row["phone"], row["contract_count"], row["account"]) == ("123", "x@y.pl", None, 2, "acc")
    assert json.loads(row["Related_Persons_JSON"])[0]["GIVEN_TXT"] == "Ewa" and json.loads(row["Related_Parties_JSON"])[0]["child_name"] == "Jan Kot"
    people = {(r["first_name"], r["last_name"]) for r in relational.person_main(tables.__getitem__).collect()}
    assert people == {("Ewa", "Lis"), ("Jan", "Kot")} and len(relational.list_extracts()) == 2
    with pytest.raises(ValueError):
        relational.find_extract("KRS", "x", "PARTY")


def test_snapshots_and_appends(spark, tmp_path):
    rows = relational.run_sql(spark, "SELECT id, CASE WHEN id > 0 THEN 'x' END AS v FROM range(3)")
    landed = files.land_snapshot(rows.coalesce(1), f"file://{tmp_path}/raw", "insurance_core")
    kept = landed.select("file_hash").collect()
    assert [bytes(r["content"]).decode().splitlines() for r in landed.collect()] == [['{"id":0,"v":null}', '{"id":1,"v":"x"}', '{"id":2,"v":"x"}']]
    again = files.land_snapshot(rows.coalesce(1), f"file://{tmp_path}/raw2", "insurance_core", spark.createDataFrame(kept, "file_hash string"))
    assert again.count() == 0
    for n in (1, 2):
        files.append(rows.withColumn("RawFile_ID", F.lit(n)), f"file://{tmp_path}/stage", ["RawFile_ID"])
    stored = spark.read.parquet(f"file://{tmp_path}/stage")
    assert stored.count() == 6
    with pytest.raises(ValueError):
        files.refuse_reload(stored, 2)
    files.refuse_reload(stored, 3)


def test_teryt(spark, tmp_path):
    assert teryt.load(spark, str(tmp_path)) is None
    (tmp_path / "simc.CSV").write_text("NAZWA;SYM\nSieradz;S1\n")
    (tmp_path / "ulic.csv").write_text("SYM;CECHA;NAZWA_1;NAZWA_2\nS1;ul.;Żółkiewskiego;Stanisława\n")
    rows = spark.createDataFrame([("SIERADZ", "UL ŻÓŁKIEWSKIEGO STANISŁAWA"), ("SIERADZ", "UL STANISŁAWA ŻÓŁKIEWSKIEGO"), ("SIERADZ", "UL INNA"), ("LAS", "UL ŻÓŁKIEWSKIEGO"), (None, "UL ŻÓŁKIEWSKIEGO"), (None, None)], "City_Normalized string, Street_Normalized string")
    got = {(r[0], r[1]): (r["city_known"], r["street_known"]) for r in validation.with_teryt(rows, teryt.load(spark, str(tmp_path))).collect()}
    assert list(map(got.get, [tuple(r) for r in rows.collect()])) == [(True, True), (True, True), (True, False), (False, False), (True, True), (True, True)]


def test_end_to_end(spark, tmp_path):
    src = spark.createDataFrame([("44051401359", "Jan", "Kowalski", "1944-14-05", "M", "ul. Polna 5, 00-950 Warszawa", "j@x.pl"), ("1", "Ewa", "Lis", "", "K", "", "bad")], "PESEL string, Imie string, Nazwisko string, DataUrodzenia string, Plec string, Adres string, Email string")
    columns = [("PESEL", "PESEL"), ("Imie", "First_Name"), ("Nazwisko", "Last_Name"), ("DataUrodzenia", "Birth_Date"), ("Plec", "Sex"), ("Adres", "Street"), ("email", "Email_Address")]
    log = pipeline.Log()
    kept = pipeline.run_source(spark, src, columns, "PERSON", 1, 7, f"file://{tmp_path}", ["PESEL"], log=log)
    assert pipeline.batch_status(log) == "STAGING_LOADED" and log.frame(spark).filter("status = 'SUCCESS'").count() == 3
    status = {(r["Preprocessed_ID"], r["rule_code"]): r["status"] for r in kept["validation"].collect()}
    assert status[(2, "PERSON_PESEL_CHECKSUM")] == "PASS" and status[(1, "PERSON_PESEL_CHECKSUM")] == "ERROR" and status[(1, "PERSON_EMAIL_SYNTAX")] == "ERROR"
    assert pipeline.entity_types("krs") == ("PARTY", "PERSON") and pipeline.entity_types("VAT", "person") == ("PERSON",)


def test_clusters_of_generated_register(spark):
    people = made_persons(spark, 60, 3).withColumn("source_code", F.lit("PESEL")).withColumn("trust", F.lit(None).cast("double")).withColumn("import_ts", F.lit(None).cast("timestamp"))
    assert people.filter(checks.pesel(c("PESEL_Normalized"))).count() == 180
    _, _, labels = pipeline.match_and_group(people, "PERSON")
    joined = labels.join(people.select(c("Preprocessed_ID").alias("id"), "entity"), "id")
    assert joined.groupBy("entity").agg(F.count_distinct("component").alias("n")).filter("n > 1").count() == 0
    assert joined.groupBy("component").agg(F.count_distinct("entity").alias("n")).filter("n > 1").count() == 0
    assert {len(r["members"]) for r in cluster.entity_groups(labels).collect()} == {3}
    empty = spark.createDataFrame([], "dim_id long, " + ", ".join(f"{f} string" for f in R.PERSON_FIELDS))
    loaded = pipeline.golden_load(people, labels, "PERSON", empty)
    assert loaded["dimension"].count() == 60 and loaded["lineage"].filter("attribute = 'PESEL'").count() == 60
    again = pipeline.golden_load(people, labels, "PERSON", loaded["dimension"])
    assert again["changes"].count() == 0 and again["matched"].filter("action = 'CREATED'").count() == 0


def test_registers(spark, tmp_path):
    made = {n: registers.register(spark, n, 1000).cache() for n in registers.REGISTERS}
    assert len(made) == 10 and all(df.count() == 1000 for df in made.values())
    share = lambda a, b: made[a].join(made[b].select("entity"), "entity").count()
    assert share("KRS", "VAT") == 300 and share("PESEL", "KNF_AGENT") == 50
    valid = lambda n, column, check: made[n].filter(check(c(f"`{column}`"))).count()
    assert all(950 <= v < 1000 for v in (valid("PESEL", "PESEL", checks.pesel), valid("VAT", "nip", checks.nip), valid("REGON", "regon", checks.regon), valid("GLEIF", "LEI", checks.lei)))
    assert 0 < made["PESEL"].filter("Email not like '%@%' and Email <> ''").count() < 40
    small = made["PESEL"].filter("row < 20")
    rows = lambda df: sorted((r["PESEL"] or "", r["Nazwisko"] or "", r["Plec"] or "") for r in df.collect())
    for kind in files.FILE_TYPES:
        path = f"file://{tmp_path}/p.{kind}"
        registers.write_register(small, path, kind)
        back = spark.read.json(path) if kind == "json" else files.read_any(spark, path)
        assert rows(back) == rows(small), kind


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"v": 1}\n{"v": 2}\n')
    seen = []
    for _ in range(2):
        incremental.follow(spark, f"file://{tmp_path}/in", "v int", f"file://{tmp_path}/state", lambda df, n: seen.append(df.count())).awaitTermination()
    assert seen == [2]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_share(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def brute_partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    parts = lambda x, n: {x[max(0, e - n) : e] for e in range(1, len(x) + n)} | {x[max(0, e - n) :] for e in range(len(x), len(x) + n)}
    scores = [brute_share(a, p) for p in parts(b, len(a))]
    return max(scores + [brute_share(b, p) for p in parts(a, len(b))] if len(a) == len(b) else scores)


def brute_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    same = " ".join(sorted(x & y))
    if same and (x <= y or y <= x):
        return 100.0
    left, right = ((same + " " + " ".join(sorted(s))).strip() for s in (x - y, y - x))
    head = len(same) + 1 if same else 0
    scores = [100.0 * (1 - (len(left) + len(right) - 2 * (head + common(left[head:], right[head:]))) / (len(left) + len(right)))]
    return max(scores + [100.0 * (1 - (len(s) - len(same)) / (len(s) + len(same))) for s in (left, right)] if same else scores)


def test_fuzzy_known_values():
    assert fuzzy.share("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert fuzzy.partial_score("this is a test", "this is a test!") == 100
    assert fuzzy.token_set_score("fuzzy fuzzy was a bear", "fuzzy was a bear") == 100
    assert fuzzy.token_set_score("", "a") == 0 and fuzzy.partial_score("", "a") == 0 and fuzzy.partial_score("", "") == 100
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert fuzzy.partial_score(a, b) == pytest.approx(brute_partial(a, b)), (a, b)
        assert fuzzy.token_set_score(a, b) == pytest.approx(brute_token_set(a, b)), (a, b)


def test_fuzzy_search_tries_every_part(spark):
    query = "the of and in"
    texts = ["x" * k + "the of and in" + "y" * 9 for k in range(9)] + ["zz" * k + "thx of abd on z" for k in range(4)] + ["of and", "", "nothing of the kind stands here", None]
    rows = [(i, "The And Of In" if i == 5 else "plain", t) for i, t in enumerate(texts)]
    want = {i: max(brute_token_set(query, a), brute_partial(query, b or "")) for i, a, b in rows}
    found = serving.fuzzy_search(spark.createDataFrame(rows, "i int, title string, content string"), query, "title", "content").collect()
    got = {r["i"]: r["score"] for r in found}
    assert got == pytest.approx({i: s for i, s in want.items() if s >= 55}) and all(got[i] == 100 for i in range(9))
    assert [r["score"] for r in found] == sorted(got.values(), reverse=True)


def test_fuzzy_search_query(spark):
    sf = "/root/testdata/sf0.001"
    query = "the of and in"
    want = {r["item_id"]: max(brute_token_set(query, f"the item {r['item_id']}"), brute_partial(query, r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r["item_id"]: r["score"] for r in catalogue.QUERIES["fuzzy_search"](spark, sf).collect()}
    assert got == pytest.approx({i: s for i, s in want.items() if s >= 55})


def test_similarities_are_computed_once(spark):
    pairs = spark.createDataFrame([(1, 2)], "left_id long, right_id long")
    schema = "Preprocessed_ID long, " + ", ".join(f"{r.sources[0]} string" for r in R.PERSON_RULES)
    records = spark.createDataFrame([], schema)
    scored = matching.score_pairs(pairs, records, R.PERSON_RULES).filter("score >= 0.5 and decision <> 'NO_MATCH'")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("levenshtein(") == len(R.PERSON_RULES)


def test_rules_take_the_first_column_with_a_value(spark):
    records = spark.createDataFrame([(1, " ", "Jan"), (2, "JAN", None), (3, None, "Stra\u00dfe"), (4, None, "STRASSE")], "Preprocessed_ID long, First_Name_Normalized string, First_Name string")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "left_id long, right_id long")
    assert [r["score"] for r in matching.score_pairs(pairs, records, R.PERSON_RULES).collect()] == [1.0, 1.0]


def test_rule_tables():
    weights = {"PERSON": 24, "PARTY": 56}
    assert {k: len(v) for k, v in R.RULES.items()} == weights
    assert {r.name for r in R.PERSON_RULES if r.decisive} == {"PESEL", "Serial_Number_ID_Card", "Serial_Number_Passport"}
    assert {r.name for r in R.PARTY_RULES if r.decisive} == {"NIP", "REGON", "KRS", "LEI", "Decision_Number", "Register_Number", "Validation_Authority_Entity_ID"}
    assert round(sum(r.weight for r in R.PERSON_RULES), 2) == 9.26 and all(r.decisive == (r.role == R.STRONG) for v in R.RULES.values() for r in v)
    assert [r.sources for r in R.PARTY_RULES if r.name == "Bank_Accounts_JSON"] == [("Bank_Accounts_Normalized_JSON", "Bank_Accounts_JSON")]


def test_numbered(spark):
    rows = spark.range(1000).select(((c("id") * 7919) % 1000).alias("v")).repartition(7)
    got = tables.numbered(rows, ["v"], "n").collect()
    assert len(got) == 1000 and all(r["n"] == r["v"] + 1 for r in got)
    assert tables.numbered(rows.limit(0), ["v"], "n").count() == 0


def test_stored_groups(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, component long")
    first = cluster.store_groups(cluster.entity_groups(labels))
    assert sorted(map(tuple, first["members"].collect())) == [(1, 1), (1, 2), (2, 3), (3, 4)]
    moved = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, component long")
    second = cluster.store_groups(cluster.entity_groups(moved), first["groups"])
    assert sorted(map(tuple, second["members"].collect())) == [(1, 1), (1, 2), (4, 3), (4, 4)]
    assert sorted(r["action"] for r in second["changes"].collect()) == ["DELETE", "DELETE", "INSERT", "KEEP"]


def test_constraints(spark):
    rows = spark.createDataFrame([("PERSON", 1, 2, 0.5, "REVIEW", "[]", None), ("X", 3, 2, 1.5, "NO_MATCH", "[", "{}")], "entity_type string, left_id int, right_id int, score double, decision string, strong_json string, conflict_json string")
    checks = constraints.candidates()
    assert {r["constraint"]: r["rows"] for r in constraints.violations(rows, checks).collect()} == {n: int(n != "conflict_json") for n in checks}
    assert constraints.enforce(rows.limit(1), checks).count() == 1
    with pytest.raises(constraints.ConstraintError):
        constraints.enforce(rows, checks)


def test_golden_load_of_parties(spark):
    rows = [
        (1, 1, "KRS", None, "2024-03-01", "ALFA", "N1", "K1", "Polna", "Opole", "00-001"),
        (2, 1, "VAT", None, "2024-02-01", "ALFA SP", "N1", None, "Lesna", "Opole", None),
        (3, 2, "REGON", None, "2024-01-01", None, "N2", None, None, None, None),
        (4, 3, "REGON", None, "2024-04-01", "BETA", "N3", None, "Polna", "Opole", "00-001"),
    ]
    schema = "Preprocessed_ID long, RawFile_ID int, source_code string, trust double, ts string, Name_Normalized string, NIP_Normalized string, KRS_Normalized string, Street_Normalized string, City_Normalized string, Postal_Code_Normalized string"
    firms = spark.createDataFrame(rows, schema).withColumn("import_ts", c("ts").cast("timestamp"))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, component long")
    loaded = pipeline.golden_load(firms, labels, "PARTY", pipeline.empty_golden(spark, "PARTY"))
    assert [(r["group_id"], r["missing_fields"]) for r in loaded["rejects"].collect()] == [(3, ["Name"])]
    dims = {r["dim_id"]: r["Name"] for r in loaded["dimension"].collect()}
    assert dims == {1: "ALFA", 2: "BETA"}
    places = {r["address_id"]: (r["Street"], r["City"], r["Postal_Code"]) for r in loaded["addresses"].collect()}
    # The address comes from VAT before KRS, its missing code from KRS.
    assert sorted(places.values()) == [("Lesna", "Opole", "00-001"), ("Polna", "Opole", "00-001")]
    links = {r["dim_id"]: (places[r["address_id"]][0], str(r["valid_from"]), r["valid_to"]) for r in loaded["links"].collect()}
    assert links == {1: ("Lesna", "2024-02-01", None), 2: ("Polna", "2024-04-01", None)}
    assert {(r["dim_id"], r["rule"]) for r in loaded["link_lineage"].collect()} == {(1, "ADDRESS_LINK_FROM_SOURCE_PRIORITY"), (2, "ADDRESS_LINK_FROM_NON_EMPTY_VALUE")}
    assert {(r["identity_type"], r["identity_value"], r["party_id"]) for r in loaded["identities"].collect()} == {("NIP", "N1", 1), ("KRS", "K1", 1), ("NIP", "N3", 2)}
    state = pipeline.after(loaded, "PARTY")
    again = pipeline.golden_load(firms, labels, "PARTY", state)
    for name in ("dimension", "addresses", "links", "identities"):
        assert sorted(map(tuple, again[name].collect()), key=repr) == sorted(map(tuple, getattr(state, name).select(*again[name].columns).collect()), key=repr), name
    assert again["changes"].count() == 0
    # One group moves: its old link is closed, a new one opened; the other raw file is out of scope.
    moved = firms.filter("Preprocessed_ID = 4").withColumn("Street_Normalized", F.lit("Nowa")).withColumn("RawFile_ID", F.lit(9)).withColumn("import_ts", F.lit("2024-05-01").cast("timestamp"))
    both = firms.filter("Preprocessed_ID < 4").unionByName(moved)
    third = pipeline.golden_load(both, labels, "PARTY", state, raw_file=9)
    assert third["matched"].count() == 1 and third["addresses"].count() == 3
    assert sorted((r["dim_id"], str(r["valid_from"]), str(r["valid_to"])) for r in third["links"].collect()) == [(1, "2024-02-01", "None"), (2, "2024-04-01", "2024-05-01"), (2, "2024-05-01", "None")]


def test_validate_parties(spark):
    columns = [n for n in mapping_columns(spark) if n not in ("Preprocessed_ID", "RawFile_ID")]
    values = {"NIP_Normalized": "5260250274", "REGON_Normalized": "1", "KRS_Normalized": "0000012345", "Email_Normalized": "a@b.pl", "Name_Normalized": "ALFA"}
    row = {"Preprocessed_ID": 1, "RawFile_ID": 1} | {n: values.get(n) for n in columns}
    done = spark.createDataFrame([row], ", ".join(f"{n} {'date' if n.endswith('_Date') else 'long' if n.endswith('_ID') and n in ('Preprocessed_ID', 'RawFile_ID') else 'string'}" for n in row))
    got = {r["rule_code"]: r["status"] for r in validation.validate_parties(done).collect()}
    assert got["PARTY_NIP_CHECKSUM"] == "PASS" and got["PARTY_REGON_CHECKSUM"] == "ERROR" and got["PARTY_KRS_FORMAT"] == "PASS" and got["PARTY_LEI_CHECKSUM"] == "PASS"
    assert got["PARTY_NAME_STRING"] == "PASS" and sum(k.endswith("_DATE_RANGE") for k in got) == 5 and len(got) == 11
    domains = spark.createDataFrame([("b.pl", False)], "domain string, resolves boolean")
    checked = {r["rule_code"]: r["status"] for r in validation.with_domain_check(validation.validate_parties(done), domains).collect()}
    assert checked["PARTY_EMAIL_SYNTAX"] == "ERROR" and checked["PARTY_NIP_CHECKSUM"] == "PASS"


def mapping_columns(spark):
    staged = spark.createDataFrame([], ", ".join(f"{n} {'date' if n.endswith('_Date') else 'string'}" for n in R.PARTY_COLUMNS))
    staged = staged.select(F.lit(1).cast("long").alias("Staging_ID"), F.lit(1).alias("ImportBatch_ID"), F.lit(1).cast("long").alias("RawFile_ID"), "*")
    return mapping.preprocess(staged, "PARTY").columns


def test_run_of_all_stages(spark, tmp_path):
    columns = [("PESEL", "PESEL"), ("Imie", "First_Name"), ("Nazwisko", "Last_Name"), ("DataUrodzenia", "Birth_Date"), ("Adres", "Street")]
    schema = "PESEL string, Imie string, Nazwisko string, DataUrodzenia string, Adres string"
    one = spark.createDataFrame([("44051401359", "Jan", "Kowalski", "1944-14-05", "ul. Polna 5, 00-950 Warszawa"), ("02070803628", "Ewa", "Lis", "", "")], schema)
    two = spark.createDataFrame([("44051401359", "Jan", "Kowalsky", "1944-14-05", "ul. Nowa 7, 00-950 Warszawa")], schema)
    sources = [pipeline.Source(one, columns, "PESEL", 1, 1, ["PESEL"], "2024-01-01"), pipeline.Source(two, columns, "CEIDG", 1, 2, ["PESEL"], "2024-02-01")]
    log = pipeline.Log()
    out = pipeline.run_all(spark, sources, "PERSON", f"file://{tmp_path}/run", log=log)
    assert out["records"].count() == 3 and out["labels"].select("component").distinct().count() == 2
    names = {(r["PESEL"], r["Last_Name"]) for r in out["dimension"].collect()}
    assert names == {("44051401359", "KOWALSKI"), ("02070803628", "LIS")}
    assert out["links"].count() == 1 and out["addresses"].filter("Street like '%NOWA%'").count() == 1  # the contact register goes first for addresses
    assert pipeline.batch_status(log) == "STAGING_LOADED" and all(r["status"] == "SUCCESS" for r in log.rows)
    with pytest.raises(ValueError, match="loaded already"):
        pipeline.run_all(spark, sources[:1], "PERSON", f"file://{tmp_path}/run")
    failed = pipeline.Log()
    bad = pipeline.Source(one.withColumn("PESEL", F.raise_error(F.lit("broken"))), columns, "PESEL", 1, 3, ["Imie"])
    with pytest.raises(Exception, match="broken"):
        pipeline.run_all(spark, [bad], "PERSON", f"file://{tmp_path}/run", log=failed)
    assert pipeline.batch_status(failed) == "FAILED" and failed.rows[0]["error"]
    assert pipeline.batch_status(pipeline.Log()) == "NEW" and pipeline.batch_status(pipeline.Log([{"step": "X", "status": "STARTED"}])) == "PROCESSING"


def test_catalogue_has_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES) - {"fuzzy_search"}
