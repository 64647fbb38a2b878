"""Operators for preparing training text, each a Spark job over a whole table.

Nothing else in the library imports this subpackage.  The operators:

==================  ======================================================
``packing``         best-fit packing by bin completion
``mixing``          mixing sources to target weights (DataFrame functions only)
``audio``           chroma fingerprints and their alignment
``jaccard``         shingle Jaccard join by chosen paths
``binary``          packed token-id matrices
``language``        language ID by segmentation-marginalised unigrams
``sketch``          threshold-scaled document fingerprints
``substrings``      repeated word windows by level-wise doubling
``lines``           near-equal lines by exact prefix-filtered set join
``counting``        token counts from pre-token frequencies
``ranking``         ranked search by a tree of items and a tree of documents
``variants``        spelling variants by a trie of letter-group counts
``pieces``          SentencePiece encoding and decoding in merge rounds
==================  ======================================================

Tokenizer files are read by path on every executor; the default path comes
from the installed ``public_tokenizers`` package and is a parameter.
"""
