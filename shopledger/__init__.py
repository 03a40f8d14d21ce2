"""Retail analytics as lazy PySpark DataFrame functions.

``sources``    typed loading, table adapters, sinks
``functions``  column expressions (dates, money, banding)
``operators``  reusable relational operators (skew-safe joins and windows, ranking, merge, ...)
``plans``      the staging, intermediate, mart and feature models
``streaming``  the staging models over Structured Streaming
``quality`` and ``metrics``  data rules and business metrics
"""
