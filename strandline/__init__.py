"""Strandline: leak-free labelled sequence datasets, built and evaluated on Spark."""
