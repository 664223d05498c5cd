"""folioframe: a PySpark-native engine for digital-library data.

Catalogue queries, document pipelines, entity resolution and reader state as
DataFrame transforms.  The optional subpackage ``llm`` adds operators for
training-data pipelines; nothing in the rest of the package imports it.
"""

__version__ = "0.1.0"
