"""Registered queries: the library's reports and operators over the benchmark tables, with SQL twins."""
