"""Storage and forensic analytics on Spark DataFrames.

``operators`` holds DataFrame-to-DataFrame operators, ``functions`` column
expressions and pandas UDFs, ``sources`` readers and writers, ``streaming``
the Structured Streaming pipelines and ``plans`` the registered queries with
their SQL.  The optional subpackage for language-model data stands alone:
nothing here imports it.
"""
