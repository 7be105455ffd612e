"""Reads of golden records: search, detail, lineage, history, validation and match results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldloom.functions import fuzzy
from goldloom.operators import blocking, matching
from goldloom.operators.tables import numbered
from goldloom.plans import rules as R

DEFAULT_LIMIT, MAX_LIMIT = 50, 200


#: From this offset on, a page is found by counted ranges.
DEEP_OFFSET = 10_000


def page(rows: DataFrame, order: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0, deep: int = DEEP_OFFSET) -> DataFrame:
    """limit rows behind the first offset ones in an order that should be total.

    A small offset takes the first offset + limit rows of each partition. A deep one would bring all rows before it to one task;
    there, rows are dealt into ranges, the ranges are counted, and only the range that holds the page gives rows.
    """
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset 0 or more")
    if offset < deep:
        return rows.orderBy(*order).offset(offset).limit(limit)
    place = "_place"
    while place in rows.columns:
        place = f"_{place}"
    found = numbered(rows, order, place).filter(F.col(place).between(offset + 1, offset + limit))
    return found.orderBy(place).limit(limit).select(*rows.columns)


def page_with_total(rows: DataFrame, order: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page of rows with the column total, the number of all rows, which the page's limits don't change."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, order, limit, offset).join(F.broadcast(total))


def matches_tokens(search: str | None, columns: list[str]) -> Column:
    """Every word of a search is part of some column, without regard to case; % and _ are plain characters."""
    plain = lambda t: t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    tokens = (search or "").split()
    one = lambda t: reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").ilike(f"%{plain(t)}%"), F.lit(False)) for c in columns))
    return reduce(lambda a, b: a & b, map(one, tokens), F.lit(True))


def search_parties(parties: DataFrame, identities: DataFrame, wanted: dict[str, str], name: str | None = None) -> DataFrame:
    """Distinct parties with one of the wanted identities (type to value) or whose name contains name.

    With a wanted identity, parties without identities aren't found by name either: the join is an inner one.
    """
    wanted = {k: v for k, v in wanted.items() if v}
    named = F.col("name").ilike(f"%{name}%") if name else None
    if not wanted:
        return parties.filter(named).distinct() if named is not None else parties.distinct()
    hit = reduce(lambda a, b: a | b, ((F.col("identity_type") == k) & (F.col("identity_value") == v) for k, v in wanted.items()))
    joined = parties.join(identities.select("party_id", "identity_type", "identity_value"), "party_id")
    return joined.filter(hit if named is None else hit | named).select(*parties.columns).distinct()


def golden_list(persons: DataFrame, parties: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Persons, then parties, by id: one order over both, then a page. Both have (id, name)."""
    both = persons.select(F.lit(0).alias("k"), F.lit("PERSON").alias("kind"), "id", "name").unionByName(parties.select(F.lit(1).alias("k"), F.lit("PARTY").alias("kind"), "id", "name"))
    return page(both, [F.col("k"), F.col("id")], limit, offset).drop("k")


def detail(dim: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """dim with an array of its children's rows, sorted; empty without any."""
    rest = [c for c in children.columns if c != key]
    kind = children.select(F.struct(*rest)).schema[0].dataType.simpleString()
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    return dim.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def provenance(lineage: DataFrame, key: str) -> DataFrame:
    """(key, map of attribute to struct<source, rule>), the later lineage row winning."""
    last = lineage.groupBy(key, "attribute").agg(F.max_by(F.struct("source", "rule"), "lineage_id").alias("s"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "s")))).alias("provenance"))


def lineage_list(lineage: DataFrame, sources: DataFrame, key: str, record_id: int | None = None) -> DataFrame:
    """Lineage entries of a record (of all, without one) in order of lineage_id, with their source's code.

    lineage: key, lineage_id, attribute, source_id and the columns of an entry; sources: source_id, source_code. Entries of a
    source that isn't known go.
    """
    wanted = lineage if record_id is None else lineage.filter(F.col(key) == record_id)
    return wanted.join(sources.select("source_id", "source_code"), "source_id").orderBy(key, "lineage_id")


def golden_summary(persons: DataFrame, parties: DataFrame) -> DataFrame:
    """(entity_type, record_id, display_name, primary_identifier): a person's name is that of its parts which it has."""
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    name = F.nullif(F.concat_ws(" ", *(blank_to_null(F.col(c)) for c in ("First_Name", "Second_Name", "Last_Name"))), F.lit(""))
    people = persons.select(F.lit("PERSON").alias("entity_type"), F.col("dim_id").alias("record_id"), name.alias("display_name"), F.col("PESEL").alias("primary_identifier"))
    firms = parties.select(F.lit("PARTY").alias("entity_type"), F.col("dim_id").alias("record_id"), F.col("Name").alias("display_name"), F.lit(None).cast("string").alias("primary_identifier"))
    return people.unionByName(firms)


def address_list(links: DataFrame, addresses: DataFrame, owner: str, kind: str) -> DataFrame:
    """A record's addresses: owner, address_type, the address's columns, valid_from and valid_to."""
    rest = [c for c in addresses.columns if c != "address_id"]
    joined = links.join(addresses, "address_id")
    return joined.select(owner, "address_id", F.lit(kind).alias("address_type"), *rest, "valid_from", "valid_to")


def candidate_list(candidates: DataFrame, second: DataFrame | None = None, decision: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page of scored pairs, best score first, ties by ids, with total and passed, whether stage 2 kept the pair."""
    kept = filtered(candidates, decision=decision)
    listed = page_with_total(kept, [F.col("score").desc(), F.col("left_id"), F.col("right_id")], limit, offset)
    if second is None:
        return listed.withColumn("passed", F.lit(True))
    # At most MAX_LIMIT pairs are asked for.
    asked = F.broadcast(listed.select("left_id", "right_id"))
    found = second.select("left_id", "right_id").join(asked, ["left_id", "right_id"], "left_semi").distinct().withColumn("found", F.lit(True))
    flagged = listed.join(found, ["left_id", "right_id"], "left")
    return flagged.withColumn("passed", F.coalesce("found", F.lit(False))).drop("found").orderBy(F.col("score").desc(), "left_id", "right_id")


def candidate_page(fields: matching.Fields, keys: tuple[tuple[str, ...], ...], id_column: str, decision: str, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """candidate_list straight from records, with pairs made only of the scores that the page reaches down to.

    Scores have four digits, so how many pairs have each is a short list.
    """
    wanted = F.col("decision") == decision.strip().upper()
    counts = matching.passing(matching.count_decisions(fields, keys, id_column)).filter(wanted)
    scores = counts.select("score", "pairs").orderBy(F.col("score").desc()).collect()
    total, seen, least = sum(r["pairs"] for r in scores), 0, 0.0
    for r in scores:
        seen, least = seen + r["pairs"], r["score"]
        if seen >= offset + limit:
            break
    best = matching.passing(matching.score_units(fields, keys, id_column)).filter(wanted & (F.col("score") >= least))
    pairs = blocking.expand(matching.stage2_units(best, fields), "stage1_score", "passed").withColumnRenamed("stage1_score", "score")
    order = [F.col("score").desc(), F.col("left_id"), F.col("right_id")]
    return page(pairs.withColumn("total", F.lit(total).cast("long")), order, limit, offset)


def field_category(field: Column, strong: Column, conflicts: Column, texts: Column) -> Column:
    """How a compared field counts: strong, conflict or text, the first that holds; null where none does.

    Names are compared in upper case, without _Normalized and _JSON.
    """
    upper = lambda names: F.transform(F.coalesce(names, F.array().cast("array<string>")), F.upper)
    plain = F.upper(F.replace(F.replace(field, F.lit("_Normalized"), F.lit("")), F.lit("_JSON"), F.lit("")))
    holds = lambda names: F.array_contains(upper(names), plain)
    return F.when(holds(strong), "strong").when(holds(conflicts), "conflict").when(holds(texts), "text")


def history(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.col("change_date").desc(), F.col("change_id").desc())


def filtered(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns equal the wanted values, trimmed and in upper case; None leaves a column alone."""
    for c, v in wanted.items():
        if v is not None:
            rows = rows.filter(F.col(c) == v.strip().upper())
    return rows


def highlight(rule: Column) -> Column:
    """What a rule's result is shown as."""
    return F.when(rule.startswith("ADDR_TERYT_"), "teryt").when(rule.rlike("CHECKSUM|KRS_FORMAT"), "identifier").otherwise("plain")


def tone(status: Column) -> Column:
    s = F.upper(status)
    return F.when(s.isin("PASS", "SUCCESS", "AUTO_MERGE", "OK"), "good").when(s.isin("REVIEW", "WARNING", "CANDIDATE", "STARTED", "PROCESSING"), "warn").when(s.isin("ERROR", "FAILED", "NO_MATCH"), "bad").otherwise("neutral")


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of all tables in one plan."""
    return reduce(lambda a, b: a.unionByName(b), (t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, t in tables.items()))


def fuzzy_search(docs: DataFrame, query: str, title: str, content: str, threshold: float = 55.0) -> DataFrame:
    """docs with score (0 to 100) of at least threshold, best first: the better of the titles' word sets and the best part of the
    content, by the formulas of goldloom.functions.fuzzy. Null texts count as empty."""
    score = F.greatest(fuzzy.token_set(F.lit(query), F.col(title)), fuzzy.partial(F.lit(query), F.col(content)))
    return docs.withColumn("score", score).filter(F.col("score") >= threshold).orderBy(F.col("score").desc())
