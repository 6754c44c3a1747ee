"""Registered queries: each name pairs a Spark query over the test tables with the SQL that checks it."""
