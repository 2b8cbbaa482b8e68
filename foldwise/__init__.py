"""foldwise: labelled tabular data preparation and classification experiments as Spark jobs.

Every operator takes and returns DataFrames, keeps a ``row_id`` key, and leaves rows on the
cluster. Randomness comes from md5(seed, key), so results repeat and are checkable by SQL.
"""

__version__ = "0.1.0"
