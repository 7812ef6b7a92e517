"""Registered queries: each takes (spark, sf_dir); SQL twins are in ORACLE of the same module."""
