"""wavewright: a Spark-first engine for auditing denoised time series.

Every operator maps DataFrame to DataFrame and takes its key columns as
arguments, so operators chain with ``df.transform``.
"""

__version__ = "0.1.0"
