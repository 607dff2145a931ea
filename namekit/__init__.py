"""namekit: multilingual entity-name tables as Spark DataFrame plans.

Every operator is a ``Column -> Column`` function (``namekit.functions``) or a
``DataFrame -> DataFrame`` function (``namekit.operators``); sources and sinks
live in ``namekit.sources``, whole pipelines in ``namekit.plans`` and the
Structured Streaming jobs in ``namekit.streaming``.
"""

__version__ = "0.1.0"
