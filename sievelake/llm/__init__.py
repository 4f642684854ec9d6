"""Training-data operators for language-model corpora.

Nothing outside this folder imports it, apart from the optional hook in ``__spark_entry__.py`` and
``corpus_pipeline.py``.  Each module holds one operator with a general interface (any DataFrame, named
columns, documented parameters); ``queries.py`` derives the ``opN_*`` results from them.
"""
