"""Names, patterns and lookup rows that results depend on.

All values here are fixed: they have to equal the published area names, file
name forms and postcode lookup for the results to be right.
"""

from __future__ import annotations

# Counties, in id order.
COUNTIES = [(1, "Norfolk"), (2, "Suffolk")]

# Districts as the price data spells them (title case), in id order.
DISTRICTS = [
    (1, "Breckland", "Norfolk"),
    (2, "Broadland", "Norfolk"),
    (3, "Great Yarmouth", "Norfolk"),
    (4, "King's Lynn And West Norfolk", "Norfolk"),
    (5, "North Norfolk", "Norfolk"),
    (6, "Norwich", "Norfolk"),
    (7, "South Norfolk", "Norfolk"),
    (8, "Babergh", "Suffolk"),
    (9, "East Suffolk", "Suffolk"),
    (10, "Ipswich", "Suffolk"),
    (11, "Mid Suffolk", "Suffolk"),
    (12, "West Suffolk", "Suffolk"),
]

# Districts as the crime data spells them, by reporting county.
CRIME_DISTRICTS = {
    "Norfolk": [
        "Breckland",
        "Broadland",
        "Great Yarmouth",
        "King's Lynn and West Norfolk",
        "North Norfolk",
        "Norwich",
        "South Norfolk",
    ],
    "Suffolk": ["Babergh", "East Suffolk", "Ipswich", "Mid Suffolk", "West Suffolk"],
}

# Postcode area -> county, postcode district pattern.
POSTCODE_AREA_COUNTY = {"NR": "Norfolk", "IP": "Suffolk"}
POSTCODE_DISTRICT_PATTERN = "^[A-Z]{1,2}[0-9]{1,2}"

# Local-authority name pattern -> county.
AUTHORITY_PATTERNS = {
    "norfolk": "Norfolk",
    "suffolk|ipswich|babergh|mid suffolk": "Suffolk",
}

# Months of a May-to-April span, in span order.
SPAN_MONTHS = [
    ("05", "May", 1),
    ("06", "Jun", 2),
    ("07", "Jul", 3),
    ("08", "Aug", 4),
    ("09", "Sep", 5),
    ("10", "Oct", 6),
    ("11", "Nov", 7),
    ("12", "Dec", 8),
    ("01", "Jan", 9),
    ("02", "Feb", 10),
    ("03", "Mar", 11),
    ("04", "Apr", 12),
]

# School record kinds kept, and markers that stand for "no number".
SCHOOL_RECORD_TYPES = ["1", "2"]
SUPPRESSED_SCORES = ["NE", "SUPP"]
SUPPRESSED_PUPILS = ["NEW", "SUPP"]

# Input file names.
PRICE_FILES = "pp-202{1,2,3,4,5,6}.csv"
SCHOOL_FILES = {
    "Norfolk": "[0-9][0-9][0-9][0-9]-[0-9][0-9][0-9][0-9]_926_ks4final.csv",
    "Suffolk": "[0-9][0-9][0-9][0-9]-[0-9][0-9][0-9][0-9]_935_ks4final.csv",
}
ACADEMIC_YEAR_PATTERN = "^[0-9]{4}-[0-9]{4}"

# Header names of the yearly school files, in order of preference.
SCHOOL_COLUMN_NAMES = {
    "estab": ["URN", "ESTAB", "estab", "LAESTAB", "SCHNAME_ESTAB"],
    "school_name": ["SCHNAME", "school_name", "SCH_NAME"],
    "town": ["TOWN", "town", "ADDRESS3", "SCH_TOWN"],
    "la_name": ["NEW_LA_NAME", "LEA_NAME", "LA_NAME", "la_name"],
    "att8_score": ["ATT8SCR", "AVG_ATT8", "att8_score", "ATT8SCR_AVG"],
    "postcode": ["PCODE", "POSTCODE", "postcode"],
}

# Postcode district -> town.
POSTCODE_TOWNS = [
    ("NR1", "Norwich"),
    ("NR2", "Norwich"),
    ("NR3", "Norwich"),
    ("NR4", "Norwich"),
    ("NR5", "Norwich"),
    ("NR6", "Norwich"),
    ("NR7", "Norwich"),
    ("NR8", "Norwich"),
    ("NR9", "Norwich"),
    ("NR10", "Norwich"),
    ("NR11", "Norwich"),
    ("NR12", "Norwich"),
    ("NR13", "Norwich"),
    ("NR14", "Norwich"),
    ("NR15", "Norwich"),
    ("NR16", "Norwich"),
    ("NR17", "Attleborough"),
    ("NR18", "Wymondham"),
    ("NR19", "Dereham"),
    ("NR20", "Dereham"),
    ("NR21", "Fakenham"),
    ("NR22", "Walsingham"),
    ("NR23", "Wells-Next-The-Sea"),
    ("NR24", "Melton Constable"),
    ("NR25", "Holt"),
    ("NR26", "Sheringham"),
    ("NR27", "Cromer"),
    ("NR28", "North Walsham"),
    ("NR29", "Great Yarmouth"),
    ("NR30", "Great Yarmouth"),
    ("NR31", "Great Yarmouth"),
    ("NR32", "Lowestoft"),
    ("NR33", "Lowestoft"),
    ("NR34", "Beccles"),
    ("NR35", "Bungay"),
    ("NR46", "Norwich"),
    ("NR47", "Norwich"),
    ("NR50", "Norwich"),
    ("NR58", "Norwich"),
    ("NR59", "Norwich"),
    ("NR65", "Norwich"),
    ("NR66", "Norwich"),
    ("NR67", "Norwich"),
    ("NR70", "Norwich"),
    ("NR78", "Norwich"),
    ("NR79", "Norwich"),
    ("NR85", "Norwich"),
    ("NR86", "Norwich"),
    ("NR87", "Norwich"),
    ("NR93", "Norwich"),
    ("NR94", "Norwich"),
    ("NR95", "Norwich"),
    ("IP1", "Ipswich"),
    ("IP2", "Ipswich"),
    ("IP3", "Ipswich"),
    ("IP4", "Ipswich"),
    ("IP5", "Ipswich"),
    ("IP6", "Ipswich"),
    ("IP7", "Ipswich"),
    ("IP8", "Ipswich"),
    ("IP9", "Ipswich"),
    ("IP10", "Ipswich"),
    ("IP11", "Felixstowe"),
    ("IP12", "Woodbridge"),
    ("IP13", "Woodbridge"),
    ("IP14", "Stowmarket"),
    ("IP15", "Aldeburgh"),
    ("IP16", "Leiston"),
    ("IP17", "Saxmundham"),
    ("IP18", "Southwold"),
    ("IP19", "Halesworth"),
    ("IP20", "Harleston"),
    ("IP21", "Diss"),
    ("IP22", "Diss"),
    ("IP23", "Eye"),
    ("IP24", "Thetford"),
    ("IP25", "Thetford"),
    ("IP26", "Thetford"),
    ("IP27", "Brandon"),
    ("IP28", "Bury St Edmunds"),
    ("IP29", "Bury St Edmunds"),
    ("IP30", "Bury St Edmunds"),
    ("IP31", "Bury St Edmunds"),
    ("IP32", "Bury St Edmunds"),
    ("IP33", "Bury St Edmunds"),
    ("IP38", "Ipswich"),
    ("IP39", "Ipswich"),
    ("IP41", "Ipswich"),
    ("IP42", "Ipswich"),
    ("IP43", "Ipswich"),
    ("IP44", "Ipswich"),
    ("IP45", "Ipswich"),
    ("IP51", "Ipswich"),
    ("IP52", "Ipswich"),
    ("IP53", "Ipswich"),
    ("IP60", "Ipswich"),
    ("IP68", "Ipswich"),
    ("IP69", "Ipswich"),
    ("IP75", "Ipswich"),
    ("IP76", "Ipswich"),
    ("IP77", "Ipswich"),
    ("IP83", "Ipswich"),
    ("IP84", "Ipswich"),
    ("IP91", "Ipswich"),
    ("IP92", "Ipswich"),
    ("PE13", "Wisbech"),
    ("PE14", "Wisbech"),
    ("PE30", "King's Lynn"),
    ("PE31", "King's Lynn"),
    ("PE32", "King's Lynn"),
    ("PE33", "King's Lynn"),
    ("PE34", "King's Lynn"),
    ("PE36", "Hunstanton"),
    ("PE37", "Swaffham"),
    ("PE38", "Downham Market"),
    ("CB74", "Ely"),
    ("CB75", "Ely"),
    ("CB80", "Newmarket"),
    ("CB87", "Newmarket"),
    ("CB88", "Newmarket"),
    ("CB89", "Newmarket"),
    ("CB90", "Haverhill"),
    ("CB97", "Haverhill"),
    ("CB98", "Haverhill"),
    ("CB99", "Haverhill"),
    ("CO10", "Sudbury"),
    ("CO11", "Manningtree"),
    ("CO64", "Colchester"),
    ("CO65", "Colchester"),
    ("CO76", "Colchester"),
    ("CO85", "Bures"),
]
