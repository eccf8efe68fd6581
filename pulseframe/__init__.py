"""pulseframe: database-activity analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame -> DataFrame`` or a
small fitted object with ``fit(df)`` / ``transform(df)``; fitted state is a
small DataFrame so that the same ``transform`` serves batch and streaming.
"""

__version__ = "0.1.0"
