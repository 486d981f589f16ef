"""rowloom: DataFrame operators for collections of semi-structured tables.

Convert markup to records, compare two collections of tables without keys,
edit tables in batches, cut them into chunks and answer retrieval questions,
all as Spark jobs.
"""

__version__ = "0.1.0"
