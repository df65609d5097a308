"""Spark-native analytics for automated scan imaging.

Layers, from small to large:

* ``functions``  Column expressions (names, geometry, colour, bands, optics) and the small NumPy pixel kernels
* ``operators``  DataFrame -> DataFrame building blocks (focus, hot tiles, pairs, canvas, marks, ...)
* ``sources``    readers and sinks (frames, logs, settings, documents)
* ``plans``      the user-facing jobs composed from operators
* ``streaming``  Structured Streaming twins of the batch jobs
"""

__version__ = "0.1.0"
