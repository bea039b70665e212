"""Broadsheet: page-layout article analytics as Spark DataFrame plans."""
