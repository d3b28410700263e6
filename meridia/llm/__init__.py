"""Training-data operators: one module each, with their queries in ``queries``.

Nothing outside this subpackage (but ``corpus_pipeline.py``, which counts as
part of it) imports it.
"""
