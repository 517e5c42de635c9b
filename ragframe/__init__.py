"""ragframe: document-pipeline and vector-retrieval operators on Spark DataFrames.

Sub-packages:
  functions/  Column -> Column building blocks (text, tokens, vectors)
  sources/    readers that turn tables / files into DataFrames
  operators/  DataFrame -> DataFrame operators (chunking, sections, search, ...)
  plans/      composed pipelines and the registered queries
  streaming/  Structured Streaming variants
"""

__version__ = "0.1.0"


def _ship_with_tasks() -> None:
    """Serialise this package's functions by value inside UDF closures, so
    executors run them without having the package installed."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on the installed package
        pass


_ship_with_tasks()
