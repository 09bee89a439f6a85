"""Document-layout analytics on Spark: pages, text runs, annotations, outlines and edit histories as DataFrames."""

__version__ = "0.1.0"
