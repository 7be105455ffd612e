"""Rule tables of matching, survivorship and validation. All values here are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds of the two stages.
FUZZY_AUTO_MERGE, AUTO_MERGE, REVIEW, CANDIDATE = 0.95, 0.90, 0.70, 0.50
JW_CANDIDATE, JW_REVIEW, JW_AUTO_MERGE, JW_CONFLICT = 0.78, 0.86, 0.94, 0.82
STABLE_CONFLICT, BLOCKING_CONFLICTS, MAX_PAIRS = 0.60, 3, 2_000_000
#: Lower-case names of fields whose conflict keeps a high score from merging by itself.
CRITICAL = ("pesel", "nip", "regon", "krs", "id_card", "passport")

STRONG, FIXED, SEMI_FIXED, DYNAMIC, CONTEXT = "STRONG", "FIXED", "SEMI_FIXED", "DYNAMIC", "CONTEXT"


@dataclass(frozen=True)
class FieldRule:
    """A field that is compared: the first of columns and name that a record has a value in."""

    name: str
    weight: float
    role: str
    columns: tuple[str, ...] = ()
    decisive: bool = False
    comparator: str = "levenshtein"

    @property
    def sources(self) -> tuple[str, ...]:
        return (*self.columns, self.name)


PERSON_RULES = (
    FieldRule("PESEL", 1.0, STRONG, ("PESEL_Normalized",), True),
    FieldRule("Serial_Number_ID_Card", 0.95, STRONG, ("Serial_Number_ID_Card_Normalized",), True),
    FieldRule("Serial_Number_Passport", 0.95, STRONG, ("Serial_Number_Passport_Normalized",), True),
    FieldRule("Birth_Date", 0.9, FIXED, ()),
    FieldRule("First_Name", 0.65, SEMI_FIXED, ("First_Name_Normalized",)),
    FieldRule("Second_Name", 0.55, SEMI_FIXED, ("Second_Name_Normalized",)),
    FieldRule("Last_Name", 0.65, SEMI_FIXED, ("Last_Name_Normalized",)),
    FieldRule("Family_Name", 0.55, SEMI_FIXED, ("Family_Name_Normalized",)),
    FieldRule("Full_Name", 0.75, SEMI_FIXED, ("Full_Name_Normalized",)),
    FieldRule("Place_Of_Birth", 0.6, FIXED, ("Place_Of_Birth_Normalized",)),
    FieldRule("Sex", 0.2, SEMI_FIXED, ()),
    FieldRule("Citizenship", 0.15, SEMI_FIXED, ("Citizenship_Normalized",)),
    FieldRule("Phone_Number", 0.1, DYNAMIC, ("Phone_Normalized",)),
    FieldRule("Email_Address", 0.12, DYNAMIC, ("Email_Normalized",)),
    FieldRule("Street", 0.15, DYNAMIC, ("Street_Normalized",)),
    FieldRule("Building_Number", 0.15, DYNAMIC, ("Building_Number_Normalized",)),
    FieldRule("Apartment_Number", 0.08, DYNAMIC, ("Apartment_Number_Normalized",)),
    FieldRule("City", 0.12, DYNAMIC, ("City_Normalized",)),
    FieldRule("Postal_City", 0.12, DYNAMIC, ("Postal_City_Normalized",)),
    FieldRule("Postal_Code", 0.18, DYNAMIC, ("Postal_Code_Normalized",)),
    FieldRule("District", 0.08, DYNAMIC, ("District_Normalized",)),
    FieldRule("Province", 0.06, DYNAMIC, ("Province_Normalized",)),
    FieldRule("Country", 0.08, FIXED, ("Country_Normalized",)),
    FieldRule("Full_Address", 0.12, DYNAMIC, ("Full_Address_Normalized",)),
)
PARTY_RULES = (
    FieldRule("NIP", 1.0, STRONG, ("NIP_Normalized",), True),
    FieldRule("REGON", 0.95, STRONG, ("REGON_Normalized",), True),
    FieldRule("KRS", 0.95, STRONG, ("KRS_Normalized",), True),
    FieldRule("LEI", 1.0, STRONG, ("LEI_Normalized",), True),
    FieldRule("Name", 0.75, SEMI_FIXED, ("Name_Normalized",)),
    FieldRule("Short_Name", 0.55, SEMI_FIXED, ("Short_Name_Normalized",)),
    FieldRule("Legal_Entity_Type", 0.2, SEMI_FIXED, ("Legal_Entity_Type_Normalized",)),
    FieldRule("Registration_Country", 0.08, FIXED, ("Registration_Country_Normalized",)),
    FieldRule("Establishment_Date", 0.55, FIXED, ()),
    FieldRule("Street", 0.15, DYNAMIC, ("Street_Normalized",)),
    FieldRule("Building_Number", 0.15, DYNAMIC, ("Building_Number_Normalized",)),
    FieldRule("Apartment_Number", 0.08, DYNAMIC, ("Apartment_Number_Normalized",)),
    FieldRule("City", 0.12, DYNAMIC, ("City_Normalized",)),
    FieldRule("Postal_City", 0.12, DYNAMIC, ("Postal_City_Normalized",)),
    FieldRule("Postal_Code", 0.18, DYNAMIC, ("Postal_Code_Normalized",)),
    FieldRule("District", 0.08, DYNAMIC, ("District_Normalized",)),
    FieldRule("Province", 0.06, DYNAMIC, ("Province_Normalized",)),
    FieldRule("Country", 0.08, FIXED, ("Country_Normalized",)),
    FieldRule("Full_Address", 0.12, DYNAMIC, ("Full_Address_Normalized",)),
    FieldRule("Register_Status", 0.1, SEMI_FIXED, ("Register_Status_Normalized",)),
    FieldRule("Registration_Date", 0.45, FIXED, ()),
    FieldRule("Deregistration_Date", 0.25, SEMI_FIXED, ()),
    FieldRule("Decision_Date", 0.35, FIXED, ()),
    FieldRule("Decision_Number", 0.75, STRONG, ("Decision_Number_Normalized",), True),
    FieldRule("Register_Number", 0.75, STRONG, ("Register_Number_Normalized",), True),
    FieldRule("Bank_Accounts_JSON", 0.15, DYNAMIC, ("Bank_Accounts_Normalized_JSON",)),
    FieldRule("Has_Virtual_Accounts", 0.05, CONTEXT, ()),
    FieldRule("Business_Scope", 0.08, CONTEXT, ("Business_Scope_Normalized",)),
    FieldRule("Ownership_Form", 0.08, CONTEXT, ("Ownership_Form_Normalized",)),
    FieldRule("Municipality", 0.08, DYNAMIC, ("Municipality_Normalized",)),
    FieldRule("Phone_Number", 0.1, DYNAMIC, ("Phone_Normalized",)),
    FieldRule("Email_Address", 0.12, DYNAMIC, ("Email_Normalized",)),
    FieldRule("Website", 0.12, DYNAMIC, ("Website_Normalized",)),
    FieldRule("Agent_Type", 0.7, SEMI_FIXED, ("Agent_Type_Normalized",)),
    FieldRule("Insurance_Company", 0.7, SEMI_FIXED, ("Insurance_Company_Normalized",)),
    FieldRule("Related_Persons_JSON", 0.2, CONTEXT, ("Related_Persons_Normalized_JSON",)),
    FieldRule("Related_Parties_JSON", 0.2, CONTEXT, ("Related_Parties_Normalized_JSON",)),
    FieldRule("Registration_Status", 0.1, SEMI_FIXED, ("Registration_Status_Normalized",)),
    FieldRule("Last_Update_Date", 0.05, CONTEXT, ()),
    FieldRule("Next_Renewal_Date", 0.05, CONTEXT, ()),
    FieldRule("Managing_LOU", 0.15, CONTEXT, ("Managing_LOU_Normalized",)),
    FieldRule("Validation_Sources", 0.15, CONTEXT, ("Validation_Sources_Normalized",)),
    FieldRule("Validation_Authority_ID", 0.7, SEMI_FIXED, ("Validation_Authority_ID_Normalized",)),
    FieldRule("Validation_Authority_Entity_ID", 0.85, STRONG, ("Validation_Authority_Entity_ID_Normalized",), True),
    FieldRule("Direct_Parent_LEI", 0.95, FIXED, ("Direct_Parent_LEI_Normalized",)),
    FieldRule("Direct_Parent_Name", 0.6, SEMI_FIXED, ("Direct_Parent_Name_Normalized",)),
    FieldRule("Direct_Parent_Relationship_Type", 0.2, CONTEXT, ("Direct_Parent_Relationship_Type_Normalized",)),
    FieldRule("Direct_Parent_Relationship_Status", 0.1, CONTEXT, ("Direct_Parent_Relationship_Status_Normalized",)),
    FieldRule("Direct_Parent_Relationship_Start_Date", 0.7, SEMI_FIXED, ()),
    FieldRule("Direct_Parent_Relationship_End_Date", 0.1, CONTEXT, ()),
    FieldRule("Ultimate_Parent_LEI", 0.95, FIXED, ("Ultimate_Parent_LEI_Normalized",)),
    FieldRule("Ultimate_Parent_Name", 0.6, SEMI_FIXED, ("Ultimate_Parent_Name_Normalized",)),
    FieldRule("Ultimate_Parent_Relationship_Type", 0.2, CONTEXT, ("Ultimate_Parent_Relationship_Type_Normalized",)),
    FieldRule("Ultimate_Parent_Relationship_Status", 0.1, CONTEXT, ("Ultimate_Parent_Relationship_Status_Normalized",)),
    FieldRule("Ultimate_Parent_Relationship_Start_Date", 0.7, SEMI_FIXED, ()),
    FieldRule("Ultimate_Parent_Relationship_End_Date", 0.1, CONTEXT, ()),
)
RULES = {"PERSON": PERSON_RULES, "PARTY": PARTY_RULES}
_JW_FIELDS = {
    "PERSON": ["First_Name", "Second_Name", "Last_Name", "Family_Name", "Full_Name", "Place_Of_Birth", "Street", "City", "Postal_City", "Full_Address"],
    "PARTY": ["Name", "Short_Name", "Legal_Entity_Type", "Street", "City", "Postal_City", "Full_Address", "Business_Scope", "Ownership_Form", "Agent_Type", "Insurance_Company", "Direct_Parent_Name", "Ultimate_Parent_Name"],
}
JW_RULES = {kind: tuple(r for r in RULES[kind] if r.name in names) for kind, names in _JW_FIELDS.items()}

# Keys that records must share to be compared. A text after a colon is cut to so many characters.
BLOCKING = {
    "PERSON": (
        ("PESEL_Normalized",),
        ("Serial_Number_ID_Card_Normalized",),
        ("Serial_Number_Passport_Normalized",),
        ("Email_Normalized",),
        ("Phone_Normalized",),
        ("Birth_Date", "Last_Name_Normalized:4"),
        ("Birth_Date", "First_Name_Normalized:4", "Last_Name_Normalized:4"),
        ("Birth_Date", "Place_Of_Birth_Normalized"),
        ("Postal_Code_Normalized", "Last_Name_Normalized:4"),
    ),
    "PARTY": (
        ("NIP_Normalized",),
        ("REGON_Normalized",),
        ("KRS_Normalized",),
        ("LEI_Normalized",),
        ("Decision_Number_Normalized",),
        ("Register_Number_Normalized",),
        ("Validation_Authority_Entity_ID_Normalized",),
        ("Website_Normalized",),
        ("Email_Normalized",),
        ("Phone_Normalized",),
        ("City_Normalized", "Name_Normalized:4"),
        ("Postal_Code_Normalized", "Name_Normalized:4"),
        ("Country_Normalized|Registration_Country_Normalized", "Name_Normalized:4"),
        ("Country_Normalized|Registration_Country_Normalized", "Short_Name_Normalized"),
        ("Legal_Entity_Type_Normalized", "Name_Normalized:4"),
    ),
}
LEAST_PREFIX = 3

TRUST = {"CEIDG": 80, "KRS": 90, "REGON": 85, "VAT": 85, "PESEL": 90, "KNF_AGENT": 80, "KNF_PRACOWNIK_AGENTA": 80, "KNF_FIRMY_INWESTYCYJNE": 80, "KNF_PIENIADZ_ELEKTRONICZNY": 80, "GLEIF": 75, "INSURANCE_CORE": 70, "WWW_FORM": 50}
SOURCES = tuple(TRUST)

# Orders of sources for the fields of golden dimensions, addresses and identities; other fields have the default.
ADDRESS_FIELDS = ("Street", "Building_Number", "Apartment_Number", "City", "Postal_City", "Postal_Code", "District", "Province", "Country", "Full_Address")
ADDRESS_LINK_FIELDS = ("Full_Address", "Street", "City", "Postal_Code", "Building_Number", "Apartment_Number", "Postal_City", "District", "Province", "Country")
DEFAULT_ORDER = {
    "PERSON": ["PESEL", "CEIDG", "INSURANCE_CORE", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "KNF_FIRMY_INWESTYCYJNE"],
    "PARTY": ["KRS", "REGON", "VAT", "GLEIF", "CEIDG", "KNF_FIRMY_INWESTYCYJNE", "KNF_PIENIADZ_ELEKTRONICZNY", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "INSURANCE_CORE"],
}
_CONTACT = ["CEIDG", "INSURANCE_CORE", "PESEL", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "KNF_FIRMY_INWESTYCYJNE"]
_PERSON_ADDRESS = ["CEIDG", "PESEL", "INSURANCE_CORE", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "KNF_FIRMY_INWESTYCYJNE"]
_PARTY_ADDRESS = ["REGON", "VAT", "CEIDG", "KRS", "KNF_AGENT", "KNF_FIRMY_INWESTYCYJNE", "KNF_PIENIADZ_ELEKTRONICZNY", "GLEIF", "INSURANCE_CORE"]
ORDERS = {
    "PERSON": {"Phone_Number": _CONTACT, "Email_Address": _CONTACT} | {f: _PERSON_ADDRESS for f in ADDRESS_FIELDS if f != "Country"},
    "PARTY": {f: _PARTY_ADDRESS for f in ADDRESS_FIELDS}
    | {
        "NIP": ["VAT", "REGON", "CEIDG", "KRS", "KNF_FIRMY_INWESTYCYJNE", "KNF_PIENIADZ_ELEKTRONICZNY", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "INSURANCE_CORE", "GLEIF"],
        "REGON": ["REGON", "VAT", "CEIDG", "KRS", "KNF_FIRMY_INWESTYCYJNE", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "INSURANCE_CORE", "GLEIF"],
        "KRS": ["KRS", "REGON", "VAT", "CEIDG", "KNF_FIRMY_INWESTYCYJNE", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "INSURANCE_CORE", "GLEIF"],
        "LEI": ["GLEIF", "KRS", "REGON", "VAT", "CEIDG", "INSURANCE_CORE", "KNF_FIRMY_INWESTYCYJNE", "KNF_PIENIADZ_ELEKTRONICZNY"],
        "Name": ["KRS", "REGON", "GLEIF", "VAT", "CEIDG", "KNF_FIRMY_INWESTYCYJNE", "KNF_PIENIADZ_ELEKTRONICZNY", "KNF_AGENT", "KNF_PRACOWNIK_AGENTA", "INSURANCE_CORE"],
        "Short_Name": ["CEIDG", "KRS", "REGON", "GLEIF", "VAT", "KNF_FIRMY_INWESTYCYJNE", "INSURANCE_CORE"],
        "Legal_Entity_Type": ["KRS", "GLEIF", "REGON", "CEIDG", "KNF_PIENIADZ_ELEKTRONICZNY", "INSURANCE_CORE", "VAT"],
        "Registration_Country": ["GLEIF", "KRS", "REGON", "CEIDG", "VAT", "INSURANCE_CORE"],
        "Establishment_Date": ["KRS", "CEIDG", "REGON", "VAT", "GLEIF", "KNF_PIENIADZ_ELEKTRONICZNY", "INSURANCE_CORE"],
        "Postal_City": ["VAT", "REGON", "CEIDG", "KRS", "KNF_AGENT", "GLEIF", "INSURANCE_CORE"],
        "District": ["REGON", "CEIDG", "KRS", "GLEIF", "INSURANCE_CORE"],
        "Province": ["REGON", "CEIDG", "KRS", "GLEIF", "INSURANCE_CORE"],
        "Country": ["GLEIF", "REGON", "KRS", "CEIDG", "VAT", "INSURANCE_CORE"],
    },
}

# Columns that give the value of a golden attribute, in order.
PERSON_FIELDS = {f: (f"{f}_Normalized", f) for f in ("PESEL", "Serial_Number_ID_Card", "Serial_Number_Passport", "First_Name", "Second_Name", "Last_Name", "Family_Name", "Place_Of_Birth", "Citizenship")} | {"Birth_Date": ("Birth_Date",), "Sex": ("Sex",), "Phone_Number": ("Phone_Normalized", "Phone_Number"), "Email_Address": ("Email_Normalized", "Email_Address")}
PARTY_FIELDS = {f: (f"{f}_Normalized", f) for f in ("Name", "Short_Name", "Legal_Entity_Type")} | {"Registration_Country": ("Registration_Country_Normalized", "Country_Normalized", "Registration_Country", "Country"), "Establishment_Date": ("Establishment_Date",)}
GOLDEN_FIELDS = {"PERSON": PERSON_FIELDS, "PARTY": PARTY_FIELDS}
ADDRESS_COLUMNS = {f: (f"{f}_Normalized", f) for f in ADDRESS_FIELDS if f != "Full_Address"}
IDENTITY_COLUMNS = {"NIP": ("NIP_Normalized", "NIP"), "REGON": ("REGON_Normalized", "REGON"), "KRS": ("KRS_Normalized", "KRS"), "LEI": ("LEI_Normalized", "LEI"), "KNF_REGISTER_NUMBER": ("Register_Number_Normalized", "Register_Number"), "DECISION_NUMBER": ("Decision_Number_Normalized", "Decision_Number")}
PERSON_IDENTITIES = ("PESEL", "Serial_Number_ID_Card", "Serial_Number_Passport")
PARTY_IDENTITIES = ("NIP", "REGON", "KRS", "LEI")

# Canonical columns of a staged record.
PERSON_COLUMNS = ("Source_Record_ID", "PESEL", "Serial_Number_ID_Card", "Serial_Number_Passport", "First_Name", "Second_Name", "Last_Name", "Family_Name", "Birth_Date", "Place_Of_Birth", "Sex", "Citizenship", "Phone_Number", "Email_Address", "Street", "Building_Number", "Apartment_Number", "City", "Postal_City", "Postal_Code", "District", "Province", "Country", "Raw_Record_JSON")
PARTY_COLUMNS = ("Source_Record_ID", "Name", "Short_Name", "Legal_Entity_Type", "Registration_Country", "Establishment_Date", "Identifiers_JSON", "Street", "Building_Number", "Apartment_Number", "City", "Postal_City", "Postal_Code", "District", "Province", "Country", "Register_Status", "Registration_Date", "Deregistration_Date", "Decision_Date", "Decision_Number", "Register_Number", "Bank_Accounts_JSON", "Has_Virtual_Accounts", "Business_Scope", "Ownership_Form", "Municipality", "Phone_Number", "Email_Address", "Website", "Agent_Type", "Insurance_Company", "Related_Persons_JSON", "Related_Parties_JSON", "Registration_Status", "Last_Update_Date", "Next_Renewal_Date", "Managing_LOU", "Validation_Sources", "Validation_Authority_ID", "Validation_Authority_Entity_ID", "Direct_Parent_LEI", "Direct_Parent_Name", "Direct_Parent_Relationship_Type", "Direct_Parent_Relationship_Status", "Direct_Parent_Relationship_Start_Date", "Direct_Parent_Relationship_End_Date", "Ultimate_Parent_LEI", "Ultimate_Parent_Name", "Ultimate_Parent_Relationship_Type", "Ultimate_Parent_Relationship_Status", "Ultimate_Parent_Relationship_Start_Date", "Ultimate_Parent_Relationship_End_Date", "Raw_Record_JSON")
CANONICAL = {"PERSON": PERSON_COLUMNS, "PARTY": PARTY_COLUMNS}
IDENTIFIER_KEYS = {"nip": "NIP", "taxnumber": "NIP", "taxref": "NIP", "numernip": "NIP", "numernipagenta": "NIP", "regon": "REGON", "nationalregistryno": "REGON", "statregref": "REGON", "krs": "KRS", "legalregisterno": "KRS", "courtref": "KRS", "numerkrs": "KRS", "numerkrsagenta": "KRS", "numeruknf": "UKNF", "lei": "LEI"}
SOURCE_ID_COLUMNS = ("Source_Record_ID", "source_record_id", "id", "ID", "firma.id", "numerKRS", "PESEL", "LEI")
PERSON_ROLES = {"CzlonekZarzadu": "BOARD_MEMBER", "Prokurent": "PROXY", "WspolnikOsoba": "PERSON_SHAREHOLDER", "Likwidator": "LIQUIDATOR", "CzlonekRadyNadzorczej": "SUPERVISORY_BOARD_MEMBER"}
PERSON_ROLE_FIELDS = {"Imie": "first_name", "DrugieImie": "second_name", "Nazwisko": "last_name", "PESEL": "pesel", "Funkcja": "role_name", "DataOd": "valid_from", "DataDo": "valid_to"}
PARTY_ROLE_FIELDS = {"Nazwa": "name", "KRS": "krs", "NIP": "nip", "DataOd": "valid_from", "DataDo": "valid_to"}


def source_order(entity: str, field: str) -> list[str]:
    return ORDERS[entity].get(field, DEFAULT_ORDER[entity])


def entity_type(name: str) -> str:
    kind = name.strip().upper()
    if kind not in RULES:
        raise ValueError(f"unknown entity type: {name!r}")
    return kind
