"""The warehouse as a set of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fenland.schemas import WAREHOUSE


class Warehouse:
    """The nine tables as attributes, each made by `load(name)` when it is first used."""

    dim_county: DataFrame
    dim_district: DataFrame
    dim_lsoa: DataFrame
    dim_school: DataFrame
    fact_population: DataFrame
    fact_house_price: DataFrame
    fact_broadband: DataFrame
    fact_crime: DataFrame
    fact_education: DataFrame

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load

    def __getattr__(self, name: str) -> DataFrame:
        if name not in WAREHOUSE:
            raise AttributeError(name)
        found = self._load(name)
        setattr(self, name, found)
        return found

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in WAREHOUSE}

    def create_views(self) -> None:
        """Temporary views under the table names, for SQL text."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)
