"""Assemble multi-source text corpora and audit what is written from them, on Spark.

Every public function takes DataFrames (or columns) and returns DataFrames
(or columns).  Nothing collects rows to the driver.
"""
