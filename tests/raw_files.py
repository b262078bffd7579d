"""Small raw files with one row per rule of the cleaners."""

from __future__ import annotations

from pathlib import Path

from fenland.plans.jobs import RawInput

# id, price, date, postcode, town, district, county
SALES = {
    "pp-2024.csv": [
        ("a1", "200000", "2024-03-01 00:00", " nr2 9ab ", "NORWICH", "NORWICH", "NORFOLK"),
        ("a2", "300000", "2024-04-02 00:00", "NR29 1AB", "GREAT YARMOUTH", "GREAT YARMOUTH", "NORFOLK"),
        ("a3", "250000", "2024-05-03 00:00", "PE30 2AA", "WELLS-NEXT-THE-SEA", "KING'S LYNN AND WEST NORFOLK", "NORFOLK"),
        ("a4", "abc", "2024-05-03 00:00", "NR1 1AA", "NORWICH", "NORWICH", "NORFOLK"),
        ("a5", "100000", "2024-06-01 00:00", "", "NORWICH", "NORWICH", "NORFOLK"),
        ("a6", "400000", "2024-06-01 00:00", "CM1 1AA", "CHELMSFORD", "CHELMSFORD", "ESSEX"),
        ("a7", "200000", "2024-03-01 00:00", "NR2 9AB", "NORWICH", "NORWICH", "NORFOLK"),
    ],
    "pp-2025.csv": [
        ("b1", "260000", "2025-01-10 00:00", "IP4 2BB", "IPSWICH", "IPSWICH", "SUFFOLK"),
        ("b2", "240000", "2025-02-11 00:00", "IP12 1AA", "WOODBRIDGE", "EAST SUFFOLK", "SUFFOLK"),
        ("b3", "500000", "2025-02-12 00:00", "NR11 6AA", "NORWICH", "BROADLAND", "NORFOLK"),
        ("b4", "150000", "2025-02-12 00:00", "NR3 1AA", "NORWICH", "NORWICH", "NORFOLK"),
        ("b5", "99000", "2025-02-12 00:00", "IP1 1AA", "IPSWICH", "ELSEWHERE", "SUFFOLK"),
    ],
    "pp-2026.csv": [("c1", "280000", "2026-01-05 00:00", "NR1 1AA", "NORWICH", "NORWICH", "NORFOLK")],
    "pp-2019.csv": [("z1", "1", "2019-01-05 00:00", "NR1 1AA", "NORWICH", "NORWICH", "NORFOLK")],
}

SPEEDS = """postcode,postcode area,Average download speed (Mbit/s),Maximum download speed (Mbit/s)
nr1  1aa,NR,10,30
NR1 1AA,NR,10,30
NR11AA,NR,12,31
NR29 1AB,NR,20,40
NR2 9AB,NR,22,44
IP4 2BB,IP,40,80
IP12 1AA,IP,60,90
IP12 1AB,IP,,90
CB1 1AA,CB,50,70
IP4 2BC,IP,44.5,81
"""

CRIME_HEADER = (
    "Crime ID,Month,Reported by,Falls within,Longitude,Latitude,Location,LSOA code,LSOA name,Crime type,"
    "Last outcome category,Context"
)


def _crime(ident, month, force, code, name, kind, outcome):
    return f"{ident},{month},{force} Constabulary,{force} Constabulary,1,2,On Road,{code},{name},{kind},{outcome},"


CRIME = {
    "2024-05/2024-05-norfolk-street.csv": [
        _crime("1", "2024-05", "Norfolk", "E1", "Norwich 001A", "Drugs", ""),
        _crime("2", "2024-05", "Norfolk", "E1", "Norwich 001A", "Drugs", ""),
        _crime("3", "2024-05", "Norfolk", "E1", "Norwich 001A", "Drugs", "Local resolution"),
        _crime("4", "2024-05", "Norfolk", "E2", "Broadland 002B", "  Violence  and sexual offences ", "Charged"),
        _crime("5", "2024-05", "Norfolk", "E9", "Cambridge 002B", "Robbery", "Charged"),
        _crime("6", "2024-05", "Norfolk", "", "Norwich 001A", "Robbery", "Charged"),
        _crime("7", "2024-13", "Norfolk", "E1", "Norwich 001A", "Robbery", "Charged"),
        _crime("8", "2024-05", "Norfolk", "E3", "King's Lynn and West Norfolk 003C", "Drugs", "Charged"),
        _crime("9", "2024-05", "Norfolk", "E1", "Norwich 001A", "Robbery", "Charged"),
        _crime("10", "2024-05", "Norfolk", "E1", "Norwich 001A", "Vehicle crime", "Charged"),
    ],
    "2025-02/2025-02-norfolk-street.csv": [
        _crime("11", "2025-02", "Norfolk", "E1", "Norwich 001A", "Drugs", "Charged"),
        _crime("12", "2025-02", "Norfolk", "E2", "Broadland 002B", "Drugs", "Charged"),
        _crime("13", "2025-02", "Norfolk", "E1", "Norwich 001A", "Vehicle crime", "Charged"),
    ],
    "2024-05/2024-05-suffolk-street.csv": [
        _crime("20", "2024-05", "Suffolk", "E5", "Ipswich 004D", "Drugs", "Charged"),
        _crime("21", "2024-05", "Suffolk", "E6", "East Suffolk 005E", "Drugs", "Charged"),
        _crime("22", "2024-05", "Suffolk", "E9", "Cambridge 002B", "Robbery", "Charged"),
        _crime("23", "2024-05", "Suffolk", "E5", "Ipswich 004D", "Robbery", "Charged"),
        _crime("24", "2024-05", "Suffolk", "E7", "Mid Suffolk 006F", "Robbery", "Charged"),
        _crime("25", "2024-06", "Suffolk", "E5", "Ipswich 004D", "Vehicle crime", "Charged"),
    ],
}

SCHOOL_HEADER = "RECTYPE,LEA,ESTAB,SCHNAME,TOWN,PCODE,TOTPUPS,ATT8SCR"
SCHOOLS = {
    "Norfolk": {
        "2023-2024_926_ks4final.csv": [
            "1,926,4001,High School,Norwich,NR2 9AB,120,45.2",
            "1,926,4001,High School again,Norwich,NR2 9AB,120,99",
            "2,926,4002, Coast School ,Cromer,NR27 0AA,NEW,SUPP",
            "4,926,4003,Local average,Norwich,NR1 1AA,1000,44",
            "1,926,4004,No Town School,,NR1 1AB,90,40",
        ],
        "2024-2025_926_ks4final.csv": [
            "1,926,4001,High School,Norwich,NR2 9AB,130,47.2",
            "1,926,4005,Shared Code,Norwich,NR11 6AA,SUPP,50",
            "1,926,4002,Coast School,Cromer,NR27 0AA,80,NE",
        ],
    },
    "Suffolk": {
        "2024-2025_935_ks4final.csv": [
            "1,935,4005,Shared Code Suffolk,Ipswich,IP4 2BB,100,40",
            "1,935,4006,Heath School,Woodbridge,IP12 1AA,100,52.5",
        ],
    },
}

POPULATION = """Mid-2024 population estimates,,,
Released for tests,,,
,,,
LAD Name,LSOA 2021 Code,LSOA 2021 Name,Total
Norwich,E1 ,Norwich 001A,1000
Norwich,E1,Norwich 001A again,5
Broadland,E2,Broadland 002B,2000
Kings Lynn,E3,King's Lynn and West Norfolk 003C,1500
Ipswich,E5,Ipswich 004D,1000
East Suffolk,E6,East Suffolk 005E,4000
Mid Suffolk,E7,Mid Suffolk 006F,0
Elsewhere,E8,Elsewhere 007G,700
Cambridge,E9,Cambridge 002B,text
"""


def write_raw_files(folder: Path) -> None:
    def put(path: Path, lines: list[str] | str) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(lines if isinstance(lines, str) else "\n".join(lines) + "\n")

    for name, rows in SALES.items():
        put(
            folder / "prices" / name,
            [
                f'"{{{i}}}","{price}","{date}","{postcode}","T","N","F","1","","STREET","","{town}","{district}","{county}","A","A"'
                for i, price, date, postcode, town, district, county in rows
            ],
        )
    put(folder / "broadband" / "201805_fixed_pc_performance_r03.csv", SPEEDS)
    for name, rows in CRIME.items():
        put(folder / "crime" / name, [CRIME_HEADER, *rows])
    for county, files in SCHOOLS.items():
        for name, rows in files.items():
            put(folder / "schools" / county / name, [SCHOOL_HEADER, *rows])
    put(folder / "schools" / "Norfolk" / "notes.csv", ["a,b", "1,2"])
    put(folder / "population" / "lsoa.csv", POPULATION)


def raw_input(folder: Path) -> RawInput:
    return RawInput(
        prices=str(folder / "prices"),
        broadband=[str(folder / "broadband" / "201805_fixed_pc_performance_r03.csv")],
        crime=str(folder / "crime"),
        schools={county: str(folder / "schools" / county) for county in SCHOOLS},
        population=str(folder / "population" / "lsoa.csv"),
    )
