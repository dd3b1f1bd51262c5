"""quadloom: a knowledge-graph query and data-processing engine on Spark DataFrames."""

__version__ = "0.1.0"
