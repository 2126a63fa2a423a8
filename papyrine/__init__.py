"""papyrine: a Spark-first analytics engine for document corpora.

Every operator is a function from DataFrames to a DataFrame.  The package is split into

* ``functions``  column expressions (text keys, tokenisers, small statistics),
* ``operators``  relational operators over those expressions,
* ``sources``    readers and writers,
* ``streaming``  incremental forms,
* ``plans``      the registered queries and the SQL they are checked with.
"""

__version__ = "0.1.0"
