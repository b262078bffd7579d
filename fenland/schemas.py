"""Raw, clean and warehouse schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}


def schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def text_schema(*names: str) -> T.StructType:
    return schema(**{name: "string" for name in names})


# The columns of the raw sources, as their files spell and order them.
# Every column is text, the clean step types it.
PRICE_RAW = text_schema(
    "transaction_id", "price", "date", "postcode", "property_type", "old_new", "duration", "paon",
    "saon", "street", "locality", "town", "district", "county", "category", "record_status",
)

# Raw column -> clean column.
SPEED_COLUMNS = {
    "postcode": "postcode",
    "Average download speed (Mbit/s)": "avg_speed",
    "Maximum download speed (Mbit/s)": "max_speed",
}
CRIME_COLUMNS = {
    "Month": "month",
    "Reported by": "reported_by",
    "Falls within": "police_force",
    "LSOA code": "lsoa_code",
    "LSOA name": "lsoa_name",
    "Crime type": "crime_type",
    "Last outcome category": "outcome",
}
SCHOOL_COLUMNS = {
    "RECTYPE": "rectype",
    "LEA": "lea_code",
    "ESTAB": "estab",
    "SCHNAME": "school_name",
    "TOWN": "town",
    "PCODE": "postcode",
    "TOTPUPS": "total_pupils",
    "ATT8SCR": "att8_score",
}
POPULATION_COLUMNS = {
    "LSOA 2021 Code": "lsoa_code",
    "LSOA 2021 Name": "lsoa_name",
    "Total": "population",
}

# Where a row stood in the raw files; kept where a later step takes the first of several rows.
POSITION = {"_file": "string", "_block": "long", "_row": "long"}

CLEAN = {
    "house_price_clean": schema(
        date="date", postcode="string", town="string", district="string", county="string",
        price="double", year="int",
    ),
    "broadband_clean": schema(postcode="string", avg_speed="double", max_speed="double", county="string", **POSITION),
    "norfolk_clean": schema(
        month="date", reported_by="string", police_force="string", lsoa_code="string",
        lsoa_name="string", crime_type="string", outcome="string", year="int", **POSITION,
    ),
    "suffolk_clean": schema(
        month="date", reported_by="string", police_force="string", lsoa_code="string",
        lsoa_name="string", crime_type="string", outcome="string", year="int", **POSITION,
    ),
    "education_clean": schema(
        lea_code="string", estab="string", school_name="string", town="string", postcode="string",
        total_pupils="double", att8_score="double", county="string", academic_year="string",
    ),
    "population_clean": schema(lsoa_code="string", lsoa_name="string", population="double"),
}

WAREHOUSE = {
    "dim_county": schema(county_id="int", county_name="string"),
    "dim_district": schema(district_id="int", district_name="string", county_id="int"),
    "dim_lsoa": schema(lsoa_code="string", lsoa_name="string", county_id="int"),
    "dim_school": schema(estab="string", school_name="string", town="string", postcode="string", county_id="int"),
    "fact_population": schema(lsoa_code="string", population="double"),
    "fact_house_price": schema(
        transaction_pk="long", date="date", year="int", postcode="string", district_id="int", price="double"
    ),
    "fact_broadband": schema(postcode="string", avg_speed="double", max_speed="double", county_id="int"),
    "fact_crime": schema(
        crime_pk="long", crime_date="date", year="int", lsoa_code="string", crime_type="string",
        outcome="string", police_force="string", in_boundary="boolean",
    ),
    "fact_education": schema(
        education_pk="long", estab="string", academic_year="string", total_pupils="double", att8_score="double"
    ),
}

TOWN_LOOKUP = schema(district="string", town="string")
SPAN_MONTHS = schema(month_num="string", month_name="string", month_order="int")
EDUCATION_ALL_YEARS = schema(
    estab="string", school_name="string", town="string", la_name="string", postcode="string",
    att8_score="double", academic_year="string", county_name="string",
)
