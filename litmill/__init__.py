"""litmill: document-corpus, retrieval, graph and activity analytics as PySpark jobs.

Every operator takes DataFrames and returns a DataFrame. Nothing here holds rows on
the driver; sizes are checked before anything is shipped to all executors.
"""
