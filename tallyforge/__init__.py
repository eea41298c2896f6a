"""Reconciliation and data-preparation analytics on Spark DataFrames."""
