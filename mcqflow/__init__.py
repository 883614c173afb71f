"""Multiple-choice fine-tuning data and answer scoring as Spark jobs.

``functions``  column expressions (``Column`` in, ``Column`` out)
``operators``  table operators (``DataFrame`` in, ``DataFrame`` out)
``sources``    reading splits, writing prepared tables and records
``plans``      the end-to-end jobs composed from the above
``streaming``  the same work over Structured Streaming inputs
"""

__version__ = "0.1.0"
