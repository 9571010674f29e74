"""Credential and endpoint scanning over Spark DataFrames."""
