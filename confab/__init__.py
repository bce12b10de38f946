"""confab: meeting analytics expressed as Spark DataFrames.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
builders and vectorised UDFs), ``operators`` (DataFrame -> DataFrame),
``streaming`` (Structured Streaming twins), ``plans`` (named queries with
their SQL twins) and, optional and imported by nothing else, ``llm``.
"""

__version__ = "0.1.0"
