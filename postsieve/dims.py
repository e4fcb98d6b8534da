"""Fixed values of the posting digest and the small lookup tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values ---------------------------------------------------------------------------

# Search windows, in seconds. Codes are case-sensitive; any other code means "no time filter".
TIMELINE_SECONDS = {"24H": 86400, "7D": 604800, "1W": 604800, "1M": 2592000}

# Location aliases (compared in lower case, untrimmed) per geo id.
GEO_ALIASES = {
    "103644278": ("usa", "united states", "america", "us", "united states of america"),
    "102713980": ("india", "in", "ind"),
    "101282230": ("germany", "de", "ger", "deutschland", "deu"),
    "102454443": ("singapore", "sg", "sing", "sin"),
    "106204383": ("uae", "united arab emirates", "dubai"),
}
DEFAULT_GEO_ID = "103644278"

# Categories a posting may get, each with the words that point to it.
CATEGORY_KEYWORDS = {
    "Java": ("java", "spring", "j2ee"),
    "Python": ("python", "django", "flask"),
    "Web Development": ("html", "css", "javascript"),
    "API Development": ("rest", "soap"),
    "Rust": ("rust",),
    "Full Stack": ("full stack",),
    "Mobile Development": ("android", "ios"),
    "Microservices": ("kubernetes", "docker"),
    "Healthcare": ("hl7", "fhir"),
    "Generative AI": ("gans", "transformers"),
    "Databases": ("sql", "nosql"),
    "Data Engineering": ("etl", "data pipelines"),
    "DevOps": ("kubernetes", "docker"),
    "Finance": ("trading", "risk management"),
    "Cloud Development": ("aws", "azure"),
    "SDE": ("software development",),
    "Big Data": ("hadoop", "spark"),
    "Machine Learning": ("ml", "dl"),
}
DEFAULT_CATEGORY = "SDE"

# Postings on one result page.
PAGE_SIZE = 25

# The scans of a daily run, in order: (scan, pages). The first lists the best matches; the
# others are searches over the named timeline.
RECOMMENDED = "recommended"
DAILY_SCANS = ((RECOMMENDED, 1), ("24H", 2), ("7D", 1), ("1M", 1))

# Experience values that mean "not stated".
NO_EXPERIENCE = ("N/A", "")

# Defaults of the three commands.
DEFAULT_QUERY = "Software Engineer"
DEFAULT_LOCATION = "USA"
DEFAULT_TIMELINE = "24H"
DEFAULT_YEARS = 2

# --------------------------------------------------------------------------------------------

_GEO_BY_ALIAS = {alias: geo_id for geo_id, aliases in GEO_ALIASES.items() for alias in aliases}


def geo_id_of(location: str) -> str:
    """Geo id of one location given as a parameter."""
    return _GEO_BY_ALIAS.get(location.lower(), DEFAULT_GEO_ID)


def geo_alias(spark: SparkSession) -> DataFrame:
    return _values(spark, "alias, geo_id", _GEO_BY_ALIAS.items())


def timeline(spark: SparkSession) -> DataFrame:
    return _values(spark, "code, seconds", TIMELINE_SECONDS.items())


def category_keyword(spark: SparkSession) -> DataFrame:
    return _values(
        spark,
        "category, keyword",
        ((category, word) for category, words in CATEGORY_KEYWORDS.items() for word in words),
    )


def scan_plan(spark: SparkSession, scans=DAILY_SCANS) -> DataFrame:
    return _values(
        spark, "scan_rank, scan, page_count", ((rank, scan, pages) for rank, (scan, pages) in enumerate(scans))
    )


def _values(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A constant table that stays on the JVM side (a VALUES list, known to the optimizer)."""
    text = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def sql_literal(value: str | int) -> str:
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
