"""contigua: sequence analytics on Spark DataFrames (reads, k-mers, extension tables, contigs)."""

__version__ = "0.1.0"
