"""netwarden — Spark-native network-flow threat analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``); the heavy lifting is left to Catalyst and whole-stage codegen.
Python runs inside tasks for the forests and a few kernels (README).
"""

__version__ = "0.1.0"
