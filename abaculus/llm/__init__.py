"""Training-data operators: dedup, decontamination, classifiers, tokenizers and archives.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
