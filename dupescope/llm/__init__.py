"""Training-data operators: packing, language identification, language-model scoring, chat formatting, byte-pair
encoding, nearest neighbours, quality rules and classifier, token files and near-duplicate detection.

Nothing outside this subpackage (and ``corpus_pipeline.py``, ``tests/llm``) imports it.
"""
