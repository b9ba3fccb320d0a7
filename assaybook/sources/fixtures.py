"""Test fixtures: the driver's TPC-H-like tables mapped onto the nine
source tables (mapping in FIXTURES.md, section B).

Every table is a projection of the given Parquet files, so Catalyst prunes
columns and pushes filters into those scans exactly as it would for staged
source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.sources.tables import Sources


_READS: dict[tuple, DataFrame] = {}


def _session_key(spark: SparkSession) -> tuple:
    """Identity of a live session (a bare id() can be reused after GC)."""
    try:
        return (spark.sparkContext.applicationId, id(spark))
    except Exception:  # sessions without a local SparkContext
        return (id(spark),)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet read, reused within a session (schema discovery reads footers)."""
    key = (_session_key(spark), sf_dir, name)
    if key not in _READS:
        _READS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READS[key]


def _txt(c: Column) -> Column:
    return c.cast("string")


def _entered() -> Column:
    """Ship date with a time of day: midnight and 00:01 each for a fifth of the
    rows (both sides of a closed window's end), else any millisecond."""
    supp = F.col("l_suppkey") % 5
    ms = (F.when(supp == 0, F.lit(0)).when(supp == 1, F.lit(60_000))
          .otherwise((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104_729) % 86_400_000))
    return F.timestamp_add("MILLISECOND", ms.cast("long"), F.col("l_shipdate").cast("timestamp_ntz"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").cast("long").alias("ORIGREC"),
        F.col("l_orderkey").cast("long").alias("FOLDERNO"),
        _txt(F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("ORDNO"),
        F.when(part % 12 == 0, F.lit(315)).otherwise(300 + part % 180)
         .cast("int").alias("TESTCODE"),
        F.concat(F.lit("A"), _txt(part % 7)).alias("ANALYTE"),
        F.col("l_returnflag").alias("FINAL"),
        F.when(q == 1, "QNS").when(q == 2, "C").when(q == 3, "U")
         .when(q == 4, F.lit(None).cast("string"))
         .otherwise(_txt(q.cast("int"))).alias("NUMRES"),
        F.concat(F.lit(" "), F.col("l_linestatus"), F.lit(" ")).alias("RN2"),
        F.when(F.col("l_tax") > 0.07, "C").otherwise("N").alias("RN3"),
        F.when(F.col("l_discount") > 0.095, "Cancel")
         .when(supp % 97 == 5, "Logged").when(supp % 97 == 6, "Draft")
         .otherwise("Released").alias("S"),
        _entered().alias("DATEENTER"),
    )


def _group_name(o: DataFrame) -> Column:
    pr = F.col("o_orderpriority")
    return (F.when(pr == "1-URGENT", "Histo Panel")
            .when(pr == "2-HIGH", "Fungal panel")
            .when(pr == "5-LOW", F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("GRP"), _txt(F.col("o_orderkey") % 9))))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("FOLDERNO"),
        F.concat(F.lit("E"), _txt(F.col("o_orderkey"))).alias("EXTERNAL_ID"),
        _group_name(o).alias("TESTGROUPNAME"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    od = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.col("o_orderkey").cast("long").alias("ORIGREC"),
        F.concat(F.lit("E"), _txt(F.col("o_orderkey"))).alias("EXTERNAL_ID"),
        (od - F.expr("INTERVAL 30 YEARS")).alias("BIRTH_DATE"),
        F.concat(F.lit("CS"), _txt(F.col("o_orderkey"))).alias("CLIENT_SAMPLE_ID"),
        od.alias("DATE_COLLECTED"),
        F.concat(F.lit("F"), _txt(F.col("o_custkey"))).alias("FIRST_NAME"),
        F.concat(F.lit("L"), _txt(F.col("o_custkey"))).alias("LAST_NAME"),
        F.col("o_orderstatus").alias("SPEC_SOURCE"),
        _txt(F.col("o_custkey")).alias("RASCLIENTID"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients, and for some a second row whose name differs in case and blanks."""
    one = client_rows(spark, sf_dir)
    again = one.where(F.col("RASCLIENTID").cast("long") % 40 == 7)
    return one.unionByName(again.withColumn("COMPNAME", F.concat(F.upper("COMPNAME"), F.lit("  "))))


def client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation")
    r = _read(spark, sf_dir, "region")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    cnr = (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))
    return cnr.select(
        _txt(k).alias("RASCLIENTID"),
        F.when(k % 10 == 0, F.concat(F.lit("Santa Clara "), F.col("c_name")))
         .when(k % 50 == 1, F.concat(F.lit("ZZZ "), F.col("c_name")))
         .when(k % 50 == 2, F.lit("RESEARCH ONLY"))
         .when(k % 50 == 3, F.concat(F.lit("VA Indianapolis "), F.col("c_name")))
         .when(k % 50 == 4, F.lit("Greater Than"))
         .otherwise(F.col("c_name")).alias("COMPNAME"),
        F.when(seg == "HOUSEHOLD", "Clinical").when(seg == "MACHINERY", "Veterinary")
         .when(seg == "FURNITURE", "Internal").when(seg == "BUILDING", "Research")
         .otherwise(F.lit(None).cast("string")).alias("CATEGORY"),
        F.col("r_name").alias("STATE"),
        F.concat(F.col("n_name"), F.lit("  ")).alias("CITY"),
        F.concat(_txt(10000 + k), F.lit("\n")).alias("ZIP"),
        F.concat(F.lit("PL"), _txt(F.col("c_nationkey") % 5)).alias("PRICELISTID"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (folders(spark, sf_dir).select("TESTGROUPNAME")
             .where(F.col("TESTGROUPNAME").isNotNull()).distinct())
    return names.select(
        "TESTGROUPNAME",
        F.when(F.lower("TESTGROUPNAME").contains("panel"), "Y").otherwise("N")
         .alias("TESTPANEL"))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").where(F.col("n_nationkey") < 7)
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("GRP"), _txt(k)).alias("TESTNO"),
        F.when(k == 0, F.lit("")).otherwise(_txt(315 + k)).alias("TESTCODE"),
        _txt(331 + k).alias("LEGACY_TESTCODE"),
    )


def price_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    version = (F.floor(k / 5) + 1).cast("int")
    return n.select(
        F.concat(F.lit("PL"), _txt(k % 5)).alias("PRICELISTID"),
        version.alias("PRICELISTVERSION"),
        F.make_date((1995 + F.floor(k / 5)).cast("int"), (1 + k % 5).cast("int"),
                    F.lit(1)).cast("timestamp_ntz").alias("STARTDDATE"),
        F.when(version.isin(4, 5), "Released").otherwise("Retired").alias("STATUS"),
        F.lit(None).cast("timestamp_ntz").alias("EXPDATE"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per code ``300 + p_partkey % 180``: cheapest part price + 10 per version,
    for every price-list version, minus ``(code + version) % 11 = 0``."""
    p = _read(spark, sf_dir, "part")
    per_code = (p.groupBy((300 + F.col("p_partkey") % 180).cast("int").alias("TESTCODE"))
                .agg(F.min("p_retailprice").alias("base")))
    # Price-list versions come from nation keys; generate the 25 keys per code
    # and equi-join them to the price-list rows (no cross join).
    lists = price_lists(spark, sf_dir).select(
        "PRICELISTID", "PRICELISTVERSION",
        F.concat(F.col("PRICELISTID"), F.lit("/"), _txt(F.col("PRICELISTVERSION"))).alias("_k"))
    keyed = per_code.select(
        "TESTCODE", "base",
        F.explode(F.sequence(F.lit(0), F.lit(24))).alias("_n"))
    keyed = keyed.select(
        "TESTCODE", "base",
        F.concat(F.lit("PL"), _txt(F.col("_n") % 5), F.lit("/"),
                 _txt((F.floor(F.col("_n") / 5) + 1).cast("int"))).alias("_k"))
    out = keyed.join(lists, "_k")
    price = (F.col("base").cast("decimal(8,2)") + 10 * F.col("PRICELISTVERSION")).cast("decimal(8,2)")
    return (out.where((F.col("TESTCODE") + F.col("PRICELISTVERSION")) % 11 != 0)
            .select("PRICELISTID", "PRICELISTVERSION", "TESTCODE", price.alias("PRICE")))


# The panel-pricing lookup rows (code -> name, name -> price).
LOOKUP_ROWS = [
    ("PanelPricing", "401", "Histo Panel"),
    ("PanelPricing", "Histo Panel", "150.00"),
    ("PanelPricing", "401", "HISTO PANEL "),
    ("PanelPricing", "histo panel", "150.00 "),
    ("PanelPricing", "402", "Fungal panel"),
    ("PanelPricing", "Fungal panel", "275.50"),
]


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as literals: the planner knows the table's size, as it does for a
    staged one, and does not shuffle the fact by panel name to join it."""
    rows = ", ".join(str(r) for r in LOOKUP_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(LOOKUP_NAME, VALUE, TEXT)")


def load(spark: SparkSession, sf_dir: str) -> Sources:
    sf_dir = sf_dir.rstrip("/")
    return Sources(
        results=results(spark, sf_dir),
        folders=folders(spark, sf_dir),
        samples=samples(spark, sf_dir),
        clients=clients(spark, sf_dir),
        groups=groups(spark, sf_dir),
        tests=tests(spark, sf_dir),
        price_lists=price_lists(spark, sf_dir),
        prices=prices(spark, sf_dir),
        lookup=lookup(spark, sf_dir),
        origin=sf_dir,
    )


_LOADED: dict[tuple, Sources] = {}


def load_cached(spark: SparkSession, sf_dir: str) -> Sources:
    """``load`` reused within a session (DataFrames are immutable plans)."""
    key = (_session_key(spark), sf_dir.rstrip("/"))
    if key not in _LOADED:
        _LOADED[key] = load(spark, sf_dir)
    return _LOADED[key]


def client_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two client snapshots for change capture: old lacks ids % 17 = 0 and has
    ZIP altered where id % 13 = 0; new lacks ids % 19 = 0, has a trailing blank in
    the ids % 23 = 0, the company in upper case where id % 5 = 0 and two blanks after
    the city where id % 7 = 0 (each of these alone is no change)."""
    key = F.col("RASCLIENTID").cast("long")
    c = client_rows(spark, sf_dir).select(key.alias("ORIGREC"), "*")
    old = (c.where(key % 17 != 0)
            .withColumn("ZIP", F.when(key % 13 == 0, F.concat(F.lit("X"), F.col("ZIP")))
                        .otherwise(F.col("ZIP"))))
    new = (c.where(key % 19 != 0)
            .withColumns({"RASCLIENTID": F.when(key % 23 == 0, F.concat(F.col("RASCLIENTID"), F.lit(" ")))
                          .otherwise(F.col("RASCLIENTID")),
                          "COMPNAME": F.when(key % 5 == 0, F.upper("COMPNAME")).otherwise(F.col("COMPNAME")),
                          "CITY": F.when(key % 7 == 0, F.concat("CITY", F.lit("  "))).otherwise(F.col("CITY"))}))
    return old, new
