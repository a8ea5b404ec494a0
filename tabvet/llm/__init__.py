"""Operators for training-data pipelines (documents, pages, benchmarks).

Each module holds one operator; ``queries`` registers them with the driver.
Nothing else in the library imports this subpackage.
"""
