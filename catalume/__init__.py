"""Catalogue analytics on Spark DataFrames: ingest, matching, merging, auditing and catalogue queries."""
