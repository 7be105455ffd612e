"""Ten synthetic registers with valid check digits, shared entities and planted anomalies, as tables or files of four kinds.

Every value is an expression of the entity's number, so registers of any size are made in parallel and a run repeats itself.
"""

from __future__ import annotations

import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldloom.functions import checks

# Source columns of each register and what they hold.
REGISTERS: dict[str, dict[str, str]] = {
    "PESEL": {"PESEL": "pesel", "NumerDowoduOsobistego": "id_card", "NumerPaszportu": "passport", "Imie": "first", "DrugieImie": "second", "Nazwisko": "last", "NazwiskoRodowe": "family", "DataUrodzenia": "birth", "MiejsceUrodzenia": "birth_place", "Plec": "sex", "Obywatelstwo": "citizenship", "Telefon": "phone", "Email": "email", "AdresZameldowania": "address", "AdresKorespondencyjny": "postal_line"},
    "CEIDG": {"firma.wlasciciel.pesel": "pesel", "firma.wlasciciel.imie": "first", "firma.wlasciciel.drugieImie": "second", "firma.wlasciciel.nazwisko": "last", "firma.nazwa": "name", "firma.skroconaNazwa": "short_name", "firma.nip": "nip", "firma.regon": "regon", "firma.dataRozpoczeciaDzialalnosci": "founded", "firma.przewazajacePKD": "scope", "firma.telefon": "phone", "firma.email": "email", "firma.adresDzialalnosci": "address", "firma.adresKorespondencyjny": "postal_line"},
    "KRS": {"nazwa": "name", "nazwaSkrocona": "short_name", "formaPrawna": "form", "dataRejestracji": "founded", "status": "status", "pkd": "scope", "siedziba": "city", "adres": "address", "nip": "nip", "regon": "regon", "numerKRS": "krs", "CzlonekZarzadu1_Imie": "first", "CzlonekZarzadu1_Nazwisko": "last", "CzlonekZarzadu1_PESEL": "pesel"},
    "REGON": {"nazwa": "name", "formaPrawna": "form", "dataPowstania": "founded", "adresSiedziby": "address", "miejscowosc": "city", "kodPocztowy": "postal_code", "powiat": "district", "wojewodztwo": "province", "pkd": "scope", "formaWlasnosci": "ownership", "gmina": "municipality", "telefon": "phone", "email": "email", "stronaWWW": "website", "nip": "nip", "krs": "krs", "regon": "regon"},
    "VAT": {"name": "name", "registrationLegalDate": "founded", "statusVat": "status", "removalDate": "none", "accountNumbers": "account", "hasVirtualAccounts": "virtual", "workingAddress": "address", "residenceAddress": "postal_line", "nip": "nip", "regon": "regon", "krs": "krs"},
    "GLEIF": {"LegalName": "name", "LegalJurisdiction": "country", "EntityLegalFormCode": "form", "InitialRegistrationDate": "founded", "FirstAddressLine": "address", "City": "city", "PostalCode": "postal_code", "Country": "country", "RegistrationStatus": "status", "LastUpdateDate": "updated", "NextRenewalDate": "renewal", "RegisteredAs": "krs", "LEI": "lei"},
    "KNF_AGENT": {"Imię": "first", "DrugieImię": "second", "Nazwisko": "last", "PESEL": "pesel", "Firma/Nazwa": "name", "Miejscowość": "city", "Ulica i numer": "street_line", "Kod pocztowy": "postal_code", "Numer NIP": "nip", "Numer KRS": "krs", "Numer agenta": "number", "Zakład ubezpieczeń": "insurer", "Rodzaj agenta": "kind", "Data wpisu": "founded", "Data zakończenia": "none"},
    "KNF_PRACOWNIK_AGENTA": {"Imię": "first", "DrugieImię": "second", "Nazwisko": "last", "PESEL": "pesel", "Numer pracownika": "number", "Nazwa agenta": "name", "Numer NIP agenta": "nip", "Numer KRS agenta": "krs", "Numer agenta": "number", "Nazwa zakładu ubezpieczeń": "insurer", "Data wpisu": "founded", "Data zakończenia": "none"},
    "KNF_FIRMY_INWESTYCYJNE": {"Firma lub nazwa": "name", "Adres siedziby": "address", "KRS": "krs", "NIP": "nip", "REGON": "regon", "Zakres czynności": "scope", "Data zezwolenia": "founded", "Numer decyzji": "number", "CzlonekZarzadu1_Imie": "first", "CzlonekZarzadu1_Nazwisko": "last", "CzlonekZarzadu1_PESEL": "pesel"},
    "KNF_PIENIADZ_ELEKTRONICZNY": {"Nazwa": "name", "Typ podmiotu": "kind", "Data wpisu": "founded", "Adres siedziby": "address", "Siedziba": "city", "NIP": "nip", "KRS": "krs", "Numer UKNF": "number", "Status": "status", "Data wykreślenia": "none", "Data decyzji": "updated"},
}
# Registers whose first rows are entities of the common pool, and in what share; others share less.
SHARED, SHARE, LITTLE = ("KRS", "CEIDG", "REGON", "VAT", "GLEIF"), 0.30, 0.05
# Planted anomalies and their rates.
RATES = {"typo": 0.02, "blank": 0.0075, "email": 0.01, "domain": 0.02, "identifier": 0.01}
# The ways in which dates are written.
DATES = ("dd/MM/yyyy", "yyyy/dd/MM", "dd-MM-yyyy", "yyyy-dd-MM", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-dd-MM HH:mm", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "yyyyMMddHHmm")

_WORDS = {
    "first": ("ADAM", "ANNA", "EWA", "JAN", "MARIA", "PIOTR", "TOMASZ", "ZOFIA", "OLGA", "MAREK"),
    "last": ("NOWAK", "KOWALSKI", "WOJCIK", "LEWANDOWSKI", "ZIELINSKI", "SZYMANSKI", "MAZUR", "KROL", "DUDA", "BARAN"),
    "city": ("WARSZAWA", "KRAKOW", "OPOLE", "SIERADZ", "GDYNIA", "LUBLIN", "RADOM"),
    "street": ("POLNA", "LESNA", "OGRODOWA", "KWIATOWA", "SZKOLNA", "LIPOWA"),
    "trade": ("BUD", "TRANS", "MED", "AGRO", "TECH", "FIN"),
    "form": ("SPOLKA AKCYJNA", "SPOLKA Z OGRANICZONA ODPOWIEDZIALNOSCIA", "SPOLKA JAWNA"),
    "status": ("AKTYWNY", "CZYNNY", "ZAREJESTROWANY"),
    "province": ("MAZOWIECKIE", "OPOLSKIE", "LODZKIE", "LUBELSKIE"),
}


def _draw(salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64("entity", F.lit(salt)), F.lit(n))


def _pick(words: str) -> Column:
    options = _WORDS[words]
    return F.element_at(F.array(*map(F.lit, options)), (_draw(words, len(options)) + 1).cast("int"))


def _summed(body: Column, weights: tuple[int, ...]) -> Column:
    """body and its check digit modulo 11; a body whose remainder is 10 has its last digit changed, which the weight then moves."""
    n = len(weights)
    total = lambda b: checks.weighted(b, weights) % 11
    other = F.concat(F.substring(body, 1, n - 1), ((F.substring(body, n, 1).cast("int") + 1) % 10).cast("string"))
    sure = F.when(total(body) == 10, other).otherwise(body)
    return F.concat(sure, (total(sure) % 10).cast("string"))


def _lei() -> Column:
    body = F.concat(F.lit("529900"), F.upper(F.lpad(F.conv(F.col("entity").cast("string"), 10, 36), 12, "0")))
    step = lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(body, F.lit("00")), ""), F.lit(0), step)
    return F.concat(body, F.lpad((98 - rest).cast("string"), 2, "0"))


def _values() -> dict[str, Column]:
    """What an entity, person or company, is made of."""
    e = F.col("entity")
    year, month, day = 50 + _draw("year", 50), 1 + _draw("month", 12), 1 + _draw("day", 28)
    pesel = F.format_string("%02d%02d%02d%04d", year, month, day, F.pmod(e, F.lit(10_000)))
    digits = lambda salt, n: F.lpad(_draw(salt, 10**n).cast("string"), n, "1")
    card = F.concat(F.lit("A"), F.lpad(F.conv(F.pmod(e, F.lit(676)).cast("string"), 10, 26), 2, "0"), digits("card", 6))
    founded = F.make_date((1990 + _draw("since", 33)).cast("int"), month.cast("int"), day.cast("int"))
    number, street, city, code = e.cast("string"), _pick("street"), _pick("city"), F.format_string("%02d-%03d", _draw("code", 100), _draw("area", 1000))
    house = (1 + _draw("house", 120)).cast("string")
    name = F.concat(_pick("trade"), F.lit(" "), number, F.lit(" "), _pick("form"))
    line = F.concat(F.lit("ul. "), street, F.lit(" "), house)
    return {
        "pesel": F.concat(pesel, ((10 - checks.weighted(pesel, checks.PESEL_WEIGHTS) % 10) % 10).cast("string")),
        "id_card": card, "passport": F.concat(F.lit("EA"), digits("pass", 7)), "first": _pick("first"), "second": F.when(_draw("two", 3) == 0, F.lit("MARIA")),
        "last": F.concat(_pick("last"), number), "family": F.concat(_pick("last"), number), "birth": F.make_date((1900 + year).cast("int"), month.cast("int"), day.cast("int")),
        "birth_place": city, "sex": F.when(_draw("sex", 2) == 0, "K").otherwise("M"), "citizenship": F.lit("PL"), "phone": F.concat(F.lit("+48"), digits("phone", 9)),
        "email": F.concat(F.lit("user"), number, F.lit("@example.org")), "address": F.concat(line, F.lit(", "), code, F.lit(" "), city), "postal_line": F.concat(code, F.lit(" "), city, F.lit(", "), line),
        "street_line": line, "city": city, "postal_code": code, "district": city, "municipality": city, "province": _pick("province"), "country": F.lit("PL"),
        "name": name, "short_name": F.concat(_pick("trade"), F.lit(" "), number), "form": _pick("form"), "founded": founded, "updated": F.date_add(founded, 400), "renewal": F.date_add(founded, 800),
        "status": _pick("status"), "scope": F.concat(F.lit("62."), F.lpad(_draw("pkd", 99).cast("string"), 2, "0"), F.lit(".Z")), "ownership": F.lit("PRYWATNA"), "insurer": F.concat(F.lit("ZAKLAD "), _draw("insurer", 9).cast("string")),
        "kind": F.lit("AGENT"), "number": F.concat(F.lit("1100"), F.lpad(number, 6, "0")), "account": F.concat(F.lit("PL"), digits("acc", 15)), "virtual": F.lit("NIE"), "website": F.concat(F.lit("https://www.firma"), number, F.lit(".example.org")),
        "nip": _summed(F.concat(F.lit("5"), digits("nip", 8)), checks.NIP_WEIGHTS), "regon": _summed(digits("regon", 8), checks.REGON_WEIGHTS), "krs": F.lpad(number, 10, "0"), "lei": _lei(), "none": F.lit(None).cast("string"),
    }


def register(spark: SparkSession, name: str, rows: int = 200) -> DataFrame:
    """One register: entity (whom a row is about), row and its source columns, all text.

    The first rows are entities of the common pool, so a person or company turns up in several registers. Anomalies come at their
    rates: a letter lost, a field left blank, a mail address without its sign or of an unknown domain, a wrong identifier.
    """
    order = list(REGISTERS).index(name)
    pool = int(rows * (SHARE if name in SHARED else LITTLE))
    row = F.col("id")
    base = spark.range(rows).select(row.alias("row"), F.when(row < pool, row).otherwise(row + (order + 1) * max(rows, 1000)).alias("entity"))
    made, out = _values(), []
    for column, what in REGISTERS[name].items():
        chance = lambda rate, what=what: F.pmod(F.xxhash64("row", F.lit(f"{name}{what}{rate}")), F.lit(10_000)) < int(RATES[rate] * 10_000)
        value = made[what]
        if what in ("birth", "founded", "updated", "renewal"):
            kinds = [F.date_format(value.cast("timestamp"), f) for f in DATES]
            value = F.element_at(F.array(*kinds), (F.pmod(F.xxhash64("row", F.lit(what)), F.lit(len(DATES))) + 1).cast("int"))
        if what in ("last", "name", "city"):
            value = F.when(chance("typo"), F.concat(F.substring(value, 1, 2), F.substring(value, 4, 200))).otherwise(value)
        if what == "email":
            value = F.when(chance("email"), F.replace(value, F.lit("@"), F.lit(""))).when(chance("domain"), F.replace(value, F.lit("example.org"), F.lit("nowhere.invalid"))).otherwise(value)
        if what in ("pesel", "nip", "regon", "lei"):
            value = F.when(chance("identifier"), F.concat(F.substring(value, 1, 3), F.lit("0"), F.substring(value, 5, 30))).otherwise(value)
        out.append(F.when(chance("blank"), F.lit("")).otherwise(value.cast("string")).alias(column))
    return base.select("entity", "row", *out)


def write_register(rows: DataFrame, path: str, kind: str) -> None:
    """A register's source columns as files: csv with a header, json (a line per row), xml of named fields, or one xlsx workbook."""
    plain = rows.drop("entity", "row")
    if kind == "csv":
        plain.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        plain.select(F.to_json(F.struct(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in plain.columns))).alias("value")).write.mode("overwrite").text(path)
    elif kind == "xml":
        fields = F.array(*(F.struct(F.lit(c).alias("_name"), F.col(f"`{c}`").alias("_VALUE")) for c in plain.columns))
        plain.select(fields.alias("field")).write.mode("overwrite").format("xml").option("rootTag", "records").option("rowTag", "record").save(path)
    elif kind == "xlsx":
        _write_book(plain, path)
    else:
        raise ValueError(f"unsupported file type: {kind!r}")


def _write_book(rows: DataFrame, path: str) -> None:
    """One workbook, made on the driver: a sheet holds about a million rows at most."""
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(v or "")}</t></is></c>'
    line = lambda cells: f"<row>{''.join(map(cell, cells))}</row>"
    body = "".join(map(line, [rows.columns, *rows.toLocalIterator()]))
    held = BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
