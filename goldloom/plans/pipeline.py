"""The whole run: landing, staging, preprocessing, validation, matching, groups, golden load; with a log of stages."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldloom.operators import cluster, constraints, golden, mapping, matching, tables, validation
from goldloom.plans import rules as R
from goldloom.plans.runs import Log, Run, batch_status  # noqa: F401
from goldloom.sources.files import source_code

# What a source holds, where it doesn't say.
ENTITY_OF_SOURCE = {"GLEIF": ("PARTY",), "KNF_PIENIADZ_ELEKTRONICZNY": ("PARTY",), "PESEL": ("PERSON",), "REGON": ("PARTY",), "VAT": ("PARTY",), "INSURANCE_CORE": ("PARTY",), "CEIDG": ("PARTY", "PERSON"), "KRS": ("PARTY", "PERSON"), "KNF_AGENT": ("PARTY", "PERSON"), "KNF_PRACOWNIK_AGENTA": ("PARTY", "PERSON"), "KNF_FIRMY_INWESTYCYJNE": ("PARTY", "PERSON")}


def entity_types(source: str, wanted: str | None = None) -> tuple[str, ...]:
    if wanted and wanted.upper() not in ("AUTO", "BOTH"):
        return (R.entity_type(wanted),)
    return ("PARTY", "PERSON") if wanted and wanted.upper() == "BOTH" else ENTITY_OF_SOURCE[source_code(source)]


#: Most rows of a raw file.
FILE_ROWS = 10**10


@dataclass(frozen=True)
class Source:
    """A raw file to be run: its rows, its column mapping and where it comes from."""

    rows: DataFrame
    columns: list[tuple[str, str]]
    code: str
    batch: int
    raw_file: int
    order_by: list[str]
    import_ts: str | None = None


def run_source(spark: SparkSession, source: DataFrame, columns: list[tuple[str, str]], entity: str, batch: int, raw_file: int, path: str, order_by: list[str], teryt: validation.Teryt | None = None, log: Log | None = None, run: Run | None = None) -> dict[str, DataFrame]:
    """Stages one raw file up to validation; each table is written below path, in a partition of its raw file."""
    run = run or Run(spark, path, entity, [raw_file], log)
    kept: dict[str, DataFrame] = {}

    def step(name: str, before: int | None, make) -> DataFrame:
        kept[name] = run.step(name.upper(), before, make, raw_file, f"{path}/{entity}/{name}/RawFile_ID={raw_file}")
        return kept[name]

    staged = step("staging", None, lambda: mapping.stage(mapping.map_columns(source, columns, entity), entity, batch, raw_file, order_by))
    count = run.log.rows[-1]["records_out"]
    if count >= FILE_ROWS:
        raise ValueError(f"raw file {raw_file} has {count} rows; at most {FILE_ROWS - 1} can be told apart")
    done = step("preprocessed", count, lambda: mapping.preprocess(staged, entity).withColumn("Rules_JSON", mapping.preprocessing_stamp()))
    step("validation", count, lambda: validation.validate_persons(staged, done, None, teryt) if entity == "PERSON" else validation.validate_parties(done, teryt))
    return kept


def match_and_group(records: DataFrame, entity: str, max_pairs: int = R.MAX_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage 1 pairs, stage 2 pairs, and groups' labels (id, component) with singletons."""
    first = matching.stage1(records, entity, max_pairs=max_pairs)
    second = matching.stage2(first, records, R.JW_RULES[entity])
    labels = cluster.connected_components(second.filter("decision = 'AUTO_MERGE'"), records.select(F.col("Preprocessed_ID").alias("id")))
    return first, second, labels


@dataclass(frozen=True)
class Golden:
    """What a golden load reads and leaves, of one entity type.

    dimension: dim_id and the golden columns (for parties those of their leading identities, too); addresses: address_id and the
    address columns; links: dim_id, address_id, valid_from, valid_to; identities: identity_type, identity_value, party_id.
    """

    dimension: DataFrame
    addresses: DataFrame
    links: DataFrame
    identities: DataFrame


#: The kind of address that a golden record is linked with.
ADDRESS_TYPE = {"PERSON": "RESIDENCE", "PARTY": "REGISTERED"}


def dimension_fields(entity: str) -> dict[str, tuple[str, ...]]:
    leading = {k: R.IDENTITY_COLUMNS[k] for k in R.PARTY_IDENTITIES} if entity == "PARTY" else {}
    return R.GOLDEN_FIELDS[entity] | leading


def empty_golden(spark: SparkSession, entity: str) -> Golden:
    columns = ", ".join(f"{f} string" for f in dimension_fields(entity))
    address = ", ".join(f"{f} string" for f in R.ADDRESS_COLUMNS)
    make = lambda schema: spark.createDataFrame([], schema)
    return Golden(make(f"dim_id long, {columns}"), make(f"address_id long, {address}"), make("dim_id long, address_id long, valid_from date, valid_to date"), make("identity_type string, identity_value string, party_id long"))


def in_scope(grouped: DataFrame, raw_file: int | None, group: int | None) -> DataFrame:
    """Rows of the groups that a load is about: all, one, or those with a member from a raw file, with all their members."""
    if group is not None:
        grouped = grouped.filter(F.col("group_id") == group)
    if raw_file is not None:
        grouped = grouped.join(grouped.filter(F.col("RawFile_ID") == raw_file).select("group_id").distinct(), "group_id", "left_semi")
    return grouped


def golden_load(records: DataFrame, labels: DataFrame, entity: str, existing: DataFrame | Golden, statuses: DataFrame | None = None, raw_file: int | None = None, group: int | None = None, groups_of: DataFrame | None = None) -> dict[str, DataFrame]:
    """The golden tables after a load: dimension, addresses, links and identities; with rejects, lineage, changes, matched,
    address_lineage, link_lineage and identity_lineage. fresh_dimension, fresh_addresses and fresh_identities are the rows that
    the load puts in place of those with the same key.

    records: preprocessed rows with source_code, trust and import_ts; labels: id and component, the record's group. Of groups
    that meet in one dimension the last one (by id) that has an address gives the link; the addresses of all are kept. With
    groups_of (group_id) the load is about these groups.
    """
    spark = records.sparkSession
    known = existing if isinstance(existing, Golden) else replace(empty_golden(spark, entity), dimension=existing)
    fields = dimension_fields(entity)
    grouped = records.join(labels.select(F.col("id").alias("Preprocessed_ID"), F.col("component").alias("group_id")), "Preprocessed_ID")
    grouped = in_scope(grouped, raw_file, group)
    if groups_of is not None:
        grouped = grouped.join(groups_of.select("group_id"), "group_id", "left_semi")
    chosen = golden.survivors_of(grouped, entity, fields, statuses)
    groups = grouped.select("group_id").distinct().join(golden.pivot_survivors(chosen, list(fields)), "group_id", "left")
    accepted, rejects = golden.accept(groups, ["Name"] if entity == "PARTY" else [])
    ids = list(R.PERSON_IDENTITIES if entity == "PERSON" else R.PARTY_IDENTITIES)
    matched = tables.kept(golden.match_dimension(accepted, known.dimension, ids, "dim_id"), "matched")
    dimension = golden.upsert(matched, known.dimension, "dim_id", list(fields))
    owners = matched.select("group_id", "dim_id")
    out = {"dimension": dimension, "rejects": rejects, "lineage": golden.lineage(chosen, matched, "dim_id"), "changes": golden.changes(known.dimension, dimension, "dim_id", list(fields)), "matched": matched}
    out["fresh_dimension"] = golden.last_of(matched, "dim_id", list(fields))
    return out | _addresses(grouped, owners, entity, known, statuses) | _identities(grouped, owners, entity, known, statuses)


def _addresses(grouped: DataFrame, owners: DataFrame, entity: str, known: Golden, statuses: DataFrame | None) -> dict[str, DataFrame]:
    columns = list(R.ADDRESS_COLUMNS)
    chosen = golden.survivors_of(grouped, entity, R.ADDRESS_COLUMNS, statuses).join(owners, "group_id")
    wanted = golden.pivot_survivors(chosen, columns)
    placed = tables.kept(golden.address_dimension(wanted, known.addresses, columns), "placed")
    new = placed.select("address_id", *columns).join(known.addresses.select("address_id"), "address_id", "left_anti").distinct()
    leading = golden.leading_address(chosen)
    starts = leading.select("group_id", "dim_id", "rule", "source", "trust", "status", golden.effective_from(F.col("import_ts")).alias("effective_from"))
    last = Window.partitionBy("dim_id").orderBy(F.col("group_id").desc())
    linked = placed.select("group_id", "address_id").join(starts, "group_id").withColumn("n", F.row_number().over(last)).filter("n = 1")
    links = golden.link_addresses(known.links, linked.select("dim_id", "address_id", "effective_from"), "dim_id")
    link_lineage = linked.select("dim_id", "address_id", "source", F.concat(F.lit("ADDRESS_LINK_FROM_"), "rule").alias("rule"), golden.trust_score(F.col("trust")).alias("trust_score"), golden.quality_score(F.col("status")).alias("quality_score"))
    address_lineage = golden.lineage(chosen, placed.select("group_id", "address_id"), "address_id")
    return {"addresses": known.addresses.select("address_id", *columns).unionByName(new), "fresh_addresses": new, "links": links, "link_lineage": link_lineage, "address_lineage": address_lineage}


def _identities(grouped: DataFrame, owners: DataFrame, entity: str, known: Golden, statuses: DataFrame | None) -> dict[str, DataFrame]:
    """A party's identities; persons have theirs in the dimension."""
    if entity == "PERSON":
        return {"identities": known.identities, "fresh_identities": known.identities.limit(0)}
    chosen = golden.survivors_of(grouped, entity, R.IDENTITY_COLUMNS, statuses).join(owners, "group_id")
    wanted = chosen.select(F.col("field").alias("identity_type"), F.col("value").alias("identity_value"), F.col("dim_id").alias("party_id"), F.col("group_id").alias("seq"))
    entry = ["identity_type", "identity_value"]
    last = Window.partitionBy(*entry).orderBy(F.col("seq").desc())
    rows = chosen.select(F.col("field").alias("identity_type"), F.col("value").alias("identity_value"), F.col("group_id").alias("seq"), "source", "rule", golden.trust_score(F.col("trust")).alias("trust_score"), golden.quality_score(F.col("status")).alias("quality_score"))
    lineage = rows.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "seq")
    return {"identities": golden.identity_bridge(known.identities, wanted), "fresh_identities": golden.last_owners(wanted), "identity_lineage": lineage}


def after(loaded: dict[str, DataFrame], entity: str) -> Golden:
    """What the next load reads: the stored columns alone."""
    allowed = {
        "dimension": ["dim_id", *dimension_fields(entity)],
        "addresses": ["address_id", *R.ADDRESS_COLUMNS],
        "links": ["dim_id", "address_id", "valid_from", "valid_to"],
        "identities": ["identity_type", "identity_value", "party_id"],
    }
    return Golden(*(tables.kept(golden.known_fields(loaded[n], columns), n) for n, columns in allowed.items()))


#: Steps of a run behind the golden load's, which later runs read.
GOLDEN = ("dimension", "addresses", "links", "identities")


def run_all(spark: SparkSession, sources: list[Source], entity: str, path: str, existing: Golden | None = None, teryt: validation.Teryt | None = None, log: Log | None = None, max_pairs: int = R.MAX_PAIRS) -> dict[str, DataFrame]:
    """All stages over raw files: staging, preprocessing, validation of each, then matching, groups and the golden load.

    New records are matched with each other and with those of all earlier runs below path; pairs of earlier records are known.
    Components grow by the new links, and the golden load is about the groups that they touch and those that share a dimension
    with these. So files that are loaded one by one give the same groups as all at once; and the same dimensions, unless a
    later record joins groups that had a dimension each: then the one with the smaller id goes on, and the other stays as it is.

    A raw file that an earlier run has loaded is refused. A step that fails is noted as FAILED and ends the run; called again
    with the same raw files, the run goes on behind its last finished step. existing is what the first run starts from.
    """
    run = Run(spark, path, entity, [s.raw_file for s in sources], log)
    done = [(s, run_source(spark, s.rows, s.columns, entity, s.batch, s.raw_file, path, s.order_by, teryt, run=run)) for s in sources]
    tag = lambda s, df: df.withColumns({"source_code": F.lit(source_code(s.code)), "trust": F.lit(None).cast("double"), "import_ts": F.lit(s.import_ts).cast("timestamp")})
    # A row's number is its own only within its raw file.
    own = lambda s, df: df.withColumn("Preprocessed_ID", F.col("Preprocessed_ID") + F.lit(s.raw_file * FILE_ROWS))
    union = lambda frames: reduce(DataFrame.unionByName, frames)

    def step(name: str, make, key: list[str] | None = None) -> DataFrame:
        return run.step(name.upper(), run.log.rows[-1]["records_out"], make, key=key)

    def with_history(name: str, new: DataFrame) -> DataFrame:
        old = run.all_of(name.upper())
        return new if old is None else old.unionByName(new)

    fresh = step("records", lambda: union(tag(s, own(s, k["preprocessed"])) for s, k in done))
    records = with_history("records", fresh)
    statuses = with_history("statuses", step("statuses", lambda: union(own(s, k["validation"]) for s, k in done).select("Preprocessed_ID", "field_name", "status")))
    ids = fresh.select(F.col("Preprocessed_ID").alias("id"))
    scope = F.floor(F.col("Preprocessed_ID") / FILE_ROWS).isin([s.raw_file for s in sources]) if run.base else None
    rules = {k: v for k, v in constraints.candidates().items() if k in ("decision", "score", "pair_order")}
    first = step("candidates", lambda: constraints.enforce(tables.kept(matching.stage1(records, entity, scope=scope, max_pairs=max_pairs), "candidates"), rules))
    second = step("second", lambda: matching.stage2(first, records, R.JW_RULES[entity]))

    before = run.last("LABELS")
    known = before if before is not None else spark.createDataFrame([], "id long, component long")
    grown: list[tuple[DataFrame, DataFrame]] = []

    def grow() -> tuple[DataFrame, DataFrame]:
        if not grown:
            grown.append(cluster.grow_components(known, second.filter("decision = 'AUTO_MERGE'"), ids))
        return grown[0]

    labels = step("labels", lambda: grow()[0])
    touched = step("touched", lambda: grow()[1])
    out = {"records": records, "statuses": statuses, "candidates": first, "second": second, "labels": labels}
    out["groups"], out["members"], out["group_changes"] = _stored_groups(run, step, known, labels, touched)

    owners = run.last("OWNERS")
    scoped = touched.select(F.col("component").alias("group_id"))
    if owners is not None:
        # Names of touched groups before this run, the dimensions these had, and all groups with one of those.
        was = known.join(labels.join(touched, "component", "left_semi").select("id"), "id", "left_semi").select(F.col("component").alias("group_id")).distinct()
        dims = owners.join(was, "group_id", "left_semi").select("dim_id").distinct()
        current = labels.select(F.col("component").alias("group_id")).distinct()
        scoped = scoped.unionByName(owners.join(dims, "dim_id", "left_semi").select("group_id").join(current, "group_id", "left_semi")).distinct()
    start = Golden(*(run.last(n.upper()) for n in GOLDEN)) if run.base else existing or empty_golden(spark, entity)
    made: list[dict[str, DataFrame]] = []

    def load() -> dict[str, DataFrame]:
        if not made:
            made.append(golden_load(records, labels, entity, start, statuses, groups_of=scoped))
            constraints.enforce(made[0]["links"], constraints.links())
        return made[0]

    # Tables that go on from run to run are changed by key; only files with a changed row are written anew.
    keys = {"dimension": ["dim_id"], "addresses": ["address_id"], "identities": ["identity_type", "identity_value"], "lineage": ["dim_id", "attribute"]}
    names = [*GOLDEN, "rejects", "lineage", "changes", "matched", "address_lineage", "link_lineage", *(["identity_lineage"] if entity == "PARTY" else [])]
    allowed = {"dimension": ["dim_id", *dimension_fields(entity)], "addresses": ["address_id", *R.ADDRESS_COLUMNS]}
    for name in names:
        # The first run stores whole tables, later ones what they change.
        part = f"fresh_{name}" if run.base and name in keys and name != "lineage" else name
        out[name] = step(name, lambda name=name, part=part: golden.known_fields(load()[part], allowed[name]) if name in allowed else load()[part], keys.get(name))
    new = out["matched"].select("group_id", "dim_id")
    rest = None if owners is None else owners.join(new.select("group_id"), "group_id", "left_anti").join(labels.select(F.col("component").alias("group_id")).distinct(), "group_id", "left_semi")
    out["owners"] = step("owners", lambda: new if rest is None else rest.select("group_id", "dim_id").unionByName(new))
    run.finish()
    return out


def _stored_groups(run: Run, step, known: DataFrame, labels: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored groups (group_id, group_key, component), their members (group_id, id) and the run's changes (group_key, action).

    Only groups that the run touches are made anew; a group with the same members keeps its id.
    """
    spark = labels.sparkSession
    empty = "group_id long, group_key string, component long", "group_id long, id long"
    old, old_members = (t if t is not None else spark.createDataFrame([], s) for t, s in zip((run.last("GROUPS"), run.last("MEMBERS")), empty))
    was = known.join(labels.join(touched, "component", "left_semi").select("id"), "id", "left_semi").select("component").distinct()
    made: list[dict[str, DataFrame]] = []

    def fresh() -> dict[str, DataFrame]:
        if not made:
            top = old.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top")).first()["top"]
            found = tables.kept(cluster.entity_groups(labels.join(touched, "component", "left_semi")), "touched")
            stored = cluster.store_groups(found, old.join(was, "component", "left_semi"), top)
            stored["groups"] = stored["groups"].join(found.select("group_key", "component"), "group_key")
            made.append(stored)
        return made[0]

    groups = step("groups", lambda: old.join(was, "component", "left_anti").unionByName(fresh()["groups"]))
    gone = old.join(was, "component", "left_semi").select("group_id")
    members = step("members", lambda: old_members.join(gone, "group_id", "left_anti").unionByName(fresh()["members"]))
    changes = step("group_changes", lambda: fresh()["changes"])
    return groups, members, changes
