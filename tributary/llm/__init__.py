"""Operators for training-data pipelines over document tables.

Each module holds one operator with its own interface; ``queries`` binds them
to the ``op<N>_<name>`` queries.  Nothing outside this folder (and
``corpus_pipeline.py``, which belongs to it) imports it.
"""
