"""Training-data operators: near-duplicates, quality, language, tokens, mixing, toxicity, licences.

One module per operator; ``components``, ``neardup`` and ``common`` hold what they share, and
``queries`` registers ``op1_`` to ``op10_`` and ``pipeline``. Nothing outside this package (except
the guarded hook in ``__spark_entry__``) and ``corpus_pipeline`` imports it.
"""
