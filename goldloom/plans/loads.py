"""Queries of whole golden loads and of stored tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.operators import blocking, cluster, constraints, mapping, matching, serving, store, tables
from goldloom.plans import pipeline, runs
from goldloom.plans import rules as R
from goldloom.plans.registry import query

c = F.col

# --- persons: three sources, 400 groups

_PERSON_ROWS = """r AS (SELECT c_custkey AS id, c_custkey % 400 AS grp, CASE c_custkey % 3 WHEN 0 THEN 'PESEL' WHEN 1 THEN 'CEIDG' ELSE 'KNF_AGENT' END AS src,
 DATE '2024-01-01' + (c_custkey % 5)::INT AS day, lpad((c_custkey % 400)::VARCHAR, 11, '0') AS pesel,
 CASE WHEN c_custkey % 4 > 0 THEN upper(c_name) END AS first_name, CASE WHEN c_custkey % 7 > 0 THEN upper(n_name) END AS city, lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-001' AS code
 FROM customer JOIN nation ON n_nationkey = c_nationkey),
ranked AS (SELECT *, CASE src WHEN 'PESEL' THEN 0 WHEN 'CEIDG' THEN 1 ELSE 3 END AS by_name, CASE src WHEN 'CEIDG' THEN 0 WHEN 'PESEL' THEN 1 ELSE 3 END AS by_address, -epoch(day)::BIGINT AS age FROM r)"""


def _persons(t) -> DataFrame:
    k = c("c_custkey")
    rows = t("customer").join(t("nation"), c("n_nationkey") == c("c_nationkey"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 5).cast("int"))
    return rows.select(
        k.alias("Preprocessed_ID"),
        F.lit(1).alias("RawFile_ID"),
        F.when(k % 3 == 0, "PESEL").when(k % 3 == 1, "CEIDG").otherwise("KNF_AGENT").alias("source_code"),
        F.lit(None).cast("double").alias("trust"),
        day.cast("timestamp").alias("import_ts"),
        F.lpad((k % 400).cast("string"), 11, "0").alias("PESEL_Normalized"),
        F.when(k % 4 > 0, F.upper("c_name")).alias("First_Name_Normalized"),
        F.when(k % 7 > 0, F.upper("n_name")).alias("City_Normalized"),
        F.concat(F.lpad((k % 90).cast("string"), 2, "0"), F.lit("-001")).alias("Postal_Code_Normalized"),
    )


@query(f"""WITH {_PERSON_ROWS}, best AS (SELECT grp, arg_min(pesel, [by_name, age, id]) AS "PESEL", arg_min(first_name, [by_name, age, id]) AS "First_Name",
 arg_min(city, [by_address, age, id]) AS "City", arg_min(code, [by_address, age, id]) AS "Postal_Code",
 coalesce(arg_min(day, [by_address, age, id]) FILTER (city IS NOT NULL), arg_min(day, [by_address, age, id])) AS day FROM ranked GROUP BY grp),
dims AS (SELECT *, row_number() OVER (ORDER BY grp) AS dim_id FROM best),
places AS (SELECT "City", "Postal_Code", row_number() OVER (ORDER BY "City" NULLS FIRST, "Postal_Code" NULLS FIRST) AS address_id FROM (SELECT DISTINCT "City", "Postal_Code" FROM best))
SELECT dim_id, "PESEL", "First_Name", address_id, d."City", d."Postal_Code", day::VARCHAR AS valid_from
FROM dims d JOIN places p ON d."City" IS NOT DISTINCT FROM p."City" AND d."Postal_Code" IS NOT DISTINCT FROM p."Postal_Code" """)
def golden_load_person(t):
    people = _persons(t)
    labels = people.select(c("Preprocessed_ID").alias("id"), (c("Preprocessed_ID") % 400).alias("component"))
    loaded = pipeline.golden_load(people, labels, "PERSON", pipeline.empty_golden(people.sparkSession, "PERSON"))
    rows = loaded["dimension"].join(loaded["links"].filter("valid_to is null"), "dim_id").join(loaded["addresses"], "address_id")
    return rows.select("dim_id", "PESEL", "First_Name", "address_id", "City", "Postal_Code", c("valid_from").cast("string").alias("valid_from"))


_SIM = "CASE WHEN a.{0} IS NOT NULL AND b.{0} IS NOT NULL THEN 1 - levenshtein(lower(a.{0}), lower(b.{0})) / greatest(length(a.{0}), length(b.{0})) END"


_PERSON_SIMS = f"""{_PERSON_ROWS}, sims AS (SELECT a.id AS left_id, b.id AS right_id, ({_SIM.format('first_name')})::DOUBLE AS f, ({_SIM.format('city')})::DOUBLE AS t, ({_SIM.format('code')})::DOUBLE AS k FROM r a JOIN r b ON a.pesel = b.pesel AND a.id < b.id),
scored AS (SELECT *, round((1.0::DOUBLE + coalesce(f * 0.65::DOUBLE, 0) + coalesce(t * 0.12::DOUBLE, 0) + coalesce(k * 0.18::DOUBLE, 0)) / (1.0::DOUBLE + CASE WHEN f IS NULL THEN 0 ELSE 0.65::DOUBLE END + CASE WHEN t IS NULL THEN 0 ELSE 0.12::DOUBLE END + CASE WHEN k IS NULL THEN 0 ELSE 0.18::DOUBLE END), 4) AS score, coalesce(f < 0.6, FALSE) AS differs FROM sims),
matched AS (SELECT left_id, right_id, score, CASE WHEN score >= 0.95 OR NOT differs THEN 'AUTO_MERGE' WHEN score >= 0.7 THEN 'REVIEW' ELSE 'CANDIDATE' END AS decision FROM scored WHERE score >= 0.5)"""


@query(f"WITH {_PERSON_SIMS} SELECT * FROM matched")
def match_persons(t):
    return matching.stage1(_persons(t), "PERSON", max_pairs=0).select("left_id", "right_id", "score", "decision")


def _file() -> Column:
    """A record's file, one of three; of these the last one is new, the others are history."""
    return c("Preprocessed_ID") % 3


@query(f"WITH {_PERSON_SIMS} SELECT * FROM matched WHERE left_id % 3 = 2 OR right_id % 3 = 2")
def scoped_pairs(t):
    return matching.stage1(_persons(t), "PERSON", scope=_file() == 2, max_pairs=0).select("left_id", "right_id", "score", "decision")


@query(f"""WITH RECURSIVE {_PERSON_SIMS}, links AS (SELECT left_id AS a, right_id AS b FROM matched WHERE decision = 'AUTO_MERGE' UNION SELECT right_id, left_id FROM matched WHERE decision = 'AUTO_MERGE'),
reach(id, other) AS (SELECT id, id FROM r UNION SELECT x.id, l.b FROM reach x JOIN links l ON x.other = l.a)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def incremental_groups(t):
    people = _persons(t)
    fields = matching.Fields(people, R.RULES["PERSON"])
    labels = people.sparkSession.createDataFrame([], "id long, component long")
    for n in range(3):
        known = people.filter(n >= _file())
        scored = matching.score_units(fields.where(n >= _file()), R.BLOCKING["PERSON"], scope=_file() == n)
        merged = matching.passing(scored).filter("decision = 'AUTO_MERGE'")
        labels, _ = cluster.grow_components(labels, tables.kept(cluster.spanning_links(merged), "links"), known.filter(_file() == n).select(c("Preprocessed_ID").alias("id")))
    return labels


@query("""SELECT f AS raw_file, step, 'SUCCESS' AS status, CASE WHEN step <> 'STAGING' THEN n ELSE 0 END AS records_in, CASE WHEN step <> 'VALIDATION' THEN n ELSE 0 END AS records_out
FROM (SELECT c_custkey % 2 + 1 AS f, count(*) AS n FROM customer GROUP BY 1), (VALUES ('STAGING'), ('PREPROCESSED'), ('VALIDATION')) s(step)""")
def stored_run_log(t):
    rows, columns = t("customer"), [("c_custkey", "Source_Record_ID"), ("c_name", "First_Name"), ("c_phone", "Phone_Number")]
    spark, path = rows.sparkSession, f"{tables.shared_folder(rows)}/runs-{uuid.uuid4().hex}"
    for n in range(2):
        pipeline.run_source(spark, rows.filter(c("c_custkey") % 2 == n), columns, "PERSON", 1, n + 1, path, ["c_custkey"])
    log = runs.run_log(spark, path, "PERSON")
    # Staging has no step before it; a record has several rows of validation.
    out = F.when(c("step") != "VALIDATION", c("records_out")).otherwise(0)
    return log.select("raw_file", "step", "status", F.coalesce("records_in", F.lit(0)).alias("records_in"), out.alias("records_out"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 1 THEN 'changed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 500 = 1 THEN 2 ELSE 1 END AS load FROM orders WHERE o_orderkey % 700 <> 5 OR o_orderkey % 500 = 1
UNION ALL SELECT -1 - p_partkey, 'new', 2 FROM part""")
def stored_table_upsert(t):
    rows = t("orders").select("o_orderkey", c("o_orderstatus").alias("status"), F.lit(1).alias("load"))
    table = store.BucketTable.create(rows, f"{tables.shared_folder(rows)}/table-{uuid.uuid4().hex}", ["o_orderkey"])
    changed = rows.filter("o_orderkey % 500 = 1").select("o_orderkey", F.lit("changed").alias("status"), F.lit(2).alias("load"))
    new = t("part").select((-1 - c("p_partkey")).alias("o_orderkey"), F.lit("new").alias("status"), F.lit(2).alias("load"))
    table.upsert(changed.unionByName(new), remove=rows.filter("o_orderkey % 700 = 5"))
    return table.read()


# --- parties: groups without a name are rejected, two groups may share a NIP

_PARTY_ROWS = """r AS (SELECT s_suppkey AS id, s_suppkey % 60 AS grp, CASE s_suppkey % 3 WHEN 0 THEN 'KRS' WHEN 1 THEN 'REGON' ELSE 'VAT' END AS src,
 CASE WHEN s_suppkey % 60 % 10 > 0 THEN upper(s_name) END AS name, 'N' || (s_suppkey % 60 % 40) AS nip, 'R' || s_suppkey AS regon FROM supplier),
ranked AS (SELECT *, CASE src WHEN 'KRS' THEN 0 WHEN 'REGON' THEN 1 ELSE 3 END AS by_name, CASE src WHEN 'VAT' THEN 0 WHEN 'REGON' THEN 1 ELSE 3 END AS by_nip, CASE src WHEN 'REGON' THEN 0 WHEN 'VAT' THEN 1 ELSE 3 END AS by_regon FROM r),
best AS (SELECT grp, arg_min(name, [by_name, id]) AS name, arg_min(nip, [by_nip, id]) AS nip, arg_min(regon, [by_regon, id]) AS regon FROM ranked GROUP BY grp),
taken AS (SELECT *, min(grp) OVER (PARTITION BY nip) AS owner FROM best WHERE name IS NOT NULL),
dims AS (SELECT *, dense_rank() OVER (ORDER BY owner) AS party_id FROM taken),
ids AS (SELECT party_id, 'NIP' AS identity_type, nip AS identity_value FROM dims UNION SELECT party_id, 'REGON', regon FROM dims),
last AS (SELECT party_id, name AS "Name" FROM dims QUALIFY row_number() OVER (PARTITION BY party_id ORDER BY grp DESC) = 1)"""


def _parties(t) -> DataFrame:
    k = c("s_suppkey")
    return t("supplier").select(
        k.alias("Preprocessed_ID"),
        F.lit(1).alias("RawFile_ID"),
        F.when(k % 3 == 0, "KRS").when(k % 3 == 1, "REGON").otherwise("VAT").alias("source_code"),
        F.lit(None).cast("double").alias("trust"),
        F.lit(None).cast("timestamp").alias("import_ts"),
        F.when(k % 60 % 10 > 0, F.upper("s_name")).alias("Name_Normalized"),
        F.concat(F.lit("N"), (k % 60 % 40).cast("string")).alias("NIP_Normalized"),
        F.concat(F.lit("R"), k.cast("string")).alias("REGON_Normalized"),
    )


def _loaded_parties(t) -> dict[str, DataFrame]:
    firms = _parties(t)
    labels = firms.select(c("Preprocessed_ID").alias("id"), (c("Preprocessed_ID") % 60).alias("component"))
    return pipeline.golden_load(firms, labels, "PARTY", pipeline.empty_golden(firms.sparkSession, "PARTY"))


@query(f"""WITH {_PARTY_ROWS} SELECT party_id, "Name", identity_type, identity_value FROM ids JOIN last USING (party_id)""")
def golden_load_party(t):
    loaded = _loaded_parties(t)
    names = loaded["dimension"].select(c("dim_id").alias("party_id"), "Name")
    return loaded["identities"].join(names, "party_id").select("party_id", "Name", "identity_type", "identity_value")


@query(f"""WITH {_PARTY_ROWS} SELECT grp AS group_id, 'Name' AS missing, 'OPEN' AS status FROM best WHERE name IS NULL""")
def golden_load_rejects(t):
    return _loaded_parties(t)["rejects"].select("group_id", F.array_join("missing_fields", ",").alias("missing"), "status")


# --- parties by all their keys and rules

_FIRM_COLUMNS = {"NIP": "nip", "REGON": "regon", "Name": "name", "Legal_Entity_Type": "legal", "City": "city", "Country": "land", "Website": "site"}
_FIRM_RULES = tuple(r for r in R.RULES["PARTY"] if r.name in _FIRM_COLUMNS)
_FIRM_SIM = ", ".join(f"({_SIM.format(column)})::DOUBLE AS {column}" for column in _FIRM_COLUMNS.values())
_FIRM_TOTAL = " + ".join(f"coalesce({_FIRM_COLUMNS[r.name]} * {r.weight!r}::DOUBLE, 0)" for r in _FIRM_RULES)
_FIRM_WEIGHT = " + ".join(f"CASE WHEN {_FIRM_COLUMNS[r.name]} IS NULL THEN 0 ELSE {r.weight!r}::DOUBLE END" for r in _FIRM_RULES)
_FIRMS = """f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN 'N' || s_suppkey % 40 END AS nip, CASE WHEN s_suppkey % 4 = 1 THEN 'R' || s_suppkey % 30 END AS regon,
 upper(n_name) || ' ' || s_suppkey % 9 AS name, CASE s_suppkey % 3 WHEN 0 THEN 'S.A.' WHEN 1 THEN 'SP. Z O.O.' END AS legal, 'TOWN' || s_suppkey % 7 AS city, substr(n_name, 1, 2) AS land, CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_suppkey % 50 || '.pl' END AS site
 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
pairs AS (SELECT a.id AS left_id, b.id AS right_id FROM f a JOIN f b ON a.id < b.id AND (a.nip = b.nip OR a.regon = b.regon OR a.site = b.site OR substr(a.name, 1, 4) = substr(b.name, 1, 4) AND (a.city = b.city OR a.land = b.land OR a.legal = b.legal)))"""


@query(f"""WITH {_FIRMS}, sims AS (SELECT left_id, right_id, {_FIRM_SIM} FROM pairs JOIN f a ON a.id = left_id JOIN f b ON b.id = right_id),
scored AS (SELECT *, CASE WHEN {_FIRM_WEIGHT} = 0 THEN 0 ELSE round(({_FIRM_TOTAL}) / ({_FIRM_WEIGHT}), 4) END AS score, coalesce(nip = 1, FALSE) OR coalesce(regon = 1, FALSE) AS strong, coalesce(nip < 1, FALSE) OR coalesce(regon < 1, FALSE) AS critical,
 coalesce(nip < 1, FALSE)::INT + coalesce(regon < 1, FALSE)::INT + coalesce(name < 0.6, FALSE)::INT + coalesce(legal < 0.6, FALSE)::INT + coalesce(land < 1, FALSE)::INT AS n FROM sims),
decided AS (SELECT left_id, right_id, score, n::BIGINT AS conflicts, CASE WHEN NOT strong AND n >= 3 THEN 'NO_MATCH' WHEN score >= 0.95 AND NOT critical THEN 'AUTO_MERGE' WHEN strong AND n = 0 THEN 'AUTO_MERGE' WHEN score >= 0.9 AND n = 0 THEN 'AUTO_MERGE'
 WHEN score >= 0.7 THEN 'REVIEW' WHEN score >= 0.5 THEN 'CANDIDATE' ELSE 'NO_MATCH' END AS decision FROM scored)
SELECT * FROM decided WHERE decision <> 'NO_MATCH' AND score >= 0.5""")
def match_parties(t):
    k = c("s_suppkey")
    text_of = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    firms = t("supplier").join(t("nation"), c("n_nationkey") == c("s_nationkey")).select(
        k.alias("Preprocessed_ID"),
        F.when(k % 3 > 0, text_of("N", 40)).alias("NIP_Normalized"),
        F.when(k % 4 == 1, text_of("R", 30)).alias("REGON_Normalized"),
        F.concat(F.upper("n_name"), F.lit(" "), (k % 9).cast("string")).alias("Name_Normalized"),
        F.when(k % 3 == 0, "S.A.").when(k % 3 == 1, "SP. Z O.O.").alias("Legal_Entity_Type_Normalized"),
        text_of("TOWN", 7).alias("City_Normalized"),
        F.substring("n_name", 1, 2).alias("Country_Normalized"),
        F.when(k % 2 == 0, F.concat(text_of("w", 50), F.lit(".pl"))).alias("Website_Normalized"),
    )
    units = matching.passing(matching.score_units(matching.Fields(firms, R.RULES["PARTY"]), R.BLOCKING["PARTY"]))
    return blocking.expand(units.withColumn("conflicts", c("n_conflicts")), "score", "conflicts", "decision")


@query("""SELECT p_partkey, to_json([x for x in [
 CASE WHEN p_partkey % 3 > 0 THEN {relationship_group: 'PARTY_SHAREHOLDER', slot: 1, name: p_name, krs: lpad(p_partkey::VARCHAR, 10, '0')} END,
 CASE WHEN p_partkey % 2 = 1 THEN {relationship_group: 'PARTY_SHAREHOLDER', slot: 2, name: p_brand, krs: NULL} END] if x IS NOT NULL]) AS related FROM part WHERE p_partkey % 6 > 0 AND NOT (p_partkey % 3 = 0 AND p_partkey % 2 = 0)""")
def related_parties_json(t):
    k = c("p_partkey")
    rows = t("part").select("p_partkey", F.when(k % 2 == 1, c("p_brand")).alias("WspolnikPodmiot2_Nazwa"), F.when(k % 3 > 0, c("p_name")).alias("WspolnikPodmiot1_Nazwa"), F.when(k % 3 > 0, F.lpad(k.cast("string"), 10, "0")).alias("WspolnikPodmiot1_KRS"))
    found = rows.select("p_partkey", mapping.related_parties(rows).alias("related")).filter("related is not null")
    # Written in one form: a slot's fields in the order of the SQL, nulls spelled out.
    slots = F.from_json("related", "array<struct<relationship_group:string,slot:int,name:string,krs:string>>")
    return found.select("p_partkey", F.to_json(slots, {"ignoreNullFields": "false"}).alias("related"))


@query(f"""WITH {_PERSON_ROWS}, best AS (SELECT grp, arg_min(city, [by_address, age, id]) AS "City", arg_min(code, [by_address, age, id]) AS "Postal_Code" FROM ranked GROUP BY grp),
dims AS (SELECT *, row_number() OVER (ORDER BY grp) AS dim_id FROM best)
SELECT dim_id, 'RESIDENCE' AS address_type, "City", "Postal_Code", TRUE AS active FROM dims""")
def address_lists(t):
    people = _persons(t)
    labels = people.select(c("Preprocessed_ID").alias("id"), (c("Preprocessed_ID") % 400).alias("component"))
    loaded = pipeline.golden_load(people, labels, "PERSON", pipeline.empty_golden(people.sparkSession, "PERSON"))
    rows = serving.address_list(loaded["links"], loaded["addresses"], "dim_id", pipeline.ADDRESS_TYPE["PERSON"])
    return rows.select("dim_id", "address_type", "City", "Postal_Code", c("valid_to").isNull().alias("active"))


# --- reads of stored tables


@query("""SELECT o_custkey AS dim_id, o_orderkey AS lineage_id, o_orderpriority AS attribute, r_name AS source_code FROM orders JOIN region ON r_regionkey = o_orderkey % 7""")
def lineage_list(t):
    entries = t("orders").select(c("o_custkey").alias("dim_id"), c("o_orderkey").alias("lineage_id"), c("o_orderpriority").alias("attribute"), (c("o_orderkey") % 7).alias("source_id"))
    sources = t("region").select(c("r_regionkey").alias("source_id"), c("r_name").alias("source_code"))
    return serving.lineage_list(entries, sources, "dim_id").select("dim_id", "lineage_id", "attribute", "source_code")


@query("""SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 40""")
def paged_total(t):
    return serving.page_with_total(t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), [c("c_custkey")], 20, 40)


@query("SELECT o_orderkey, o_totalprice, o_seventh FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 7 AS o_seventh FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 1200")
def deep_page(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", (c("o_orderkey") % 7).alias("o_seventh"))
    return serving.page(rows, [c("o_totalprice").desc(), c("o_orderkey")], 40, 1200, deep=1000)


@query("""SELECT 'PERSON' AS entity_type, c_custkey AS record_id, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ' ' || c_mktsegment END AS display_name, c_custkey::VARCHAR AS primary_identifier FROM customer
UNION ALL SELECT 'PARTY', s_suppkey, s_name, NULL FROM supplier""")
def golden_summaries(t):
    k = c("c_custkey")
    persons = t("customer").select(k.alias("dim_id"), F.when(k % 5 > 0, c("c_name")).alias("First_Name"), F.lit("").alias("Second_Name"), F.when(k % 2 > 0, c("c_mktsegment")).alias("Last_Name"), k.cast("string").alias("PESEL"))
    return serving.golden_summary(persons, t("supplier").select(c("s_suppkey").alias("dim_id"), c("s_name").alias("Name")))


@query("""SELECT 'dates' AS "constraint", count(*) FILTER (l_partkey % 5 < l_orderkey % 9 - 2) AS rows FROM lineitem
UNION ALL SELECT 'no_self', count(*) FILTER (l_partkey % 50 = l_suppkey % 50) FROM lineitem""")
def constraint_violations(t):
    day = lambda n: F.date_add(c("l_shipdate").cast("date"), n.cast("int"))
    rows = t("lineitem").select((c("l_partkey") % 50).alias("parent_id"), (c("l_suppkey") % 50).alias("child_id"), day(c("l_orderkey") % 9 - 2).alias("valid_from"), day(c("l_partkey") % 5).alias("valid_to"))
    return constraints.violations(rows, constraints.relationships())


@query("""SELECT o_clerk AS field, count(*) AS rows FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'conflict' WHEN 2 THEN 'text' ELSE 'none' END AS o_clerk FROM orders) GROUP BY 1""")
def field_categories(t):
    k = c("o_orderkey") % 4
    name = F.when(k == 0, "NIP_Normalized").when(k == 1, "Related_Persons_Normalized_JSON").when(k == 2, "name").otherwise("Country")
    category = serving.field_category(name, F.array(F.lit("NIP")), F.array(F.lit("Related_Persons"), F.lit("NIP")), F.array(F.lit("Name")))
    return t("orders").select(F.coalesce(category, F.lit("none")).alias("field")).groupBy("field").agg(F.count("*").alias("rows"))


@query("""SELECT count(*) AS groups, count(*) FILTER (n > 3) AS conflicts, round(count(*) FILTER (n > 3) / count(*), 6) AS share FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)""")
def dq_conflict_share(t):
    owners = t("orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n"))
    return owners.agg(F.count("*").alias("groups"), F.count_if(c("n") > 3).alias("conflicts")).withColumn("share", F.round(c("conflicts") / c("groups"), 6))
