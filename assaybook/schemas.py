"""Explicit schemas: the nine staged source tables and the gold fact."""

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
TS = T.TimestampNTZType()
B = T.BooleanType()
PRICE = T.DecimalType(8, 2)


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Keys that reach billions of rows are 64-bit here (the source declares INT).
RESULTS = _st(("ORIGREC", L), ("FOLDERNO", L), ("ORDNO", S), ("TESTCODE", I),
              ("ANALYTE", S), ("FINAL", S), ("NUMRES", S), ("RN2", S),
              ("RN3", S), ("S", S), ("DATEENTER", TS))
FOLDERS = _st(("FOLDERNO", L), ("EXTERNAL_ID", S), ("TESTGROUPNAME", S))
CENTRALRECEIVING = _st(("ORIGREC", L), ("EXTERNAL_ID", S), ("BIRTH_DATE", TS),
                       ("CLIENT_SAMPLE_ID", S), ("DATE_COLLECTED", TS),
                       ("FIRST_NAME", S), ("LAST_NAME", S), ("SPEC_SOURCE", S),
                       ("RASCLIENTID", S))
RASCLIENTS = _st(("RASCLIENTID", S), ("COMPNAME", S), ("CATEGORY", S),
                 ("STATE", S), ("CITY", S), ("ZIP", S), ("PRICELISTID", S))
TESTGROUPNAMES = _st(("TESTGROUPNAME", S), ("TESTPANEL", S))
TESTS = _st(("TESTNO", S), ("TESTCODE", S), ("LEGACY_TESTCODE", S))
RASPRICELIST = _st(("PRICELISTID", S), ("PRICELISTVERSION", I),
                   ("STARTDDATE", TS), ("STATUS", S), ("EXPDATE", TS))
RASTESTPRICES = _st(("PRICELISTID", S), ("PRICELISTVERSION", I),
                    ("TESTCODE", I), ("PRICE", PRICE))
METADATA_LOOKUP_VALUES = _st(("LOOKUP_NAME", S), ("VALUE", S), ("TEXT", S))

SOURCES = {
    "RESULTS": RESULTS,
    "FOLDERS": FOLDERS,
    "CENTRALRECEIVING": CENTRALRECEIVING,
    "RASCLIENTS": RASCLIENTS,
    "TESTGROUPNAMES": TESTGROUPNAMES,
    "TESTS": TESTS,
    "RASPRICELIST": RASPRICELIST,
    "RASTESTPRICES": RASTESTPRICES,
    "METADATA_LOOKUP_VALUES": METADATA_LOOKUP_VALUES,
}

# Gold fact, one row per result; partition columns year/month are added on write.
FACT = _st(
    ("ORDNO", S), ("COMPNAME", S), ("ExternalId", S), ("BirthDate", TS),
    ("ClientSampleId", S), ("FirstName", S), ("LastName", S),
    ("DateCollected", TS), ("SpecSource", S), ("DateEnter", TS),
    ("SourceTestCode", I), ("ResolvedTestCode", I), ("TestGroupName", S),
    ("IsPanel", B), ("Analyte", S), ("Final", S), ("NumRes", S), ("RN2", S),
    ("CancelStatus", S), ("HasPendingResults", B), ("Price", PRICE),
    ("PriceListId", S), ("PriceListVersion", I), ("PricingMethod", S),
    ("Category", S), ("State", S), ("City", S), ("Zip", S),
    ("LatestResultDate", TS), ("ETL_LoadDate", TS),
)
# As stored: FolderNo (for refreshing the folder's flag; readers drop it) and the partition columns.
FACT_STORED = T.StructType(FACT.fields + [T.StructField("FolderNo", L, True), T.StructField("year", I, True),
                                          T.StructField("month", I, True)])

PII = ["BIRTH_DATE", "CLIENT_SAMPLE_ID", "FIRST_NAME", "LAST_NAME"]
