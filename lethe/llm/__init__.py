"""Training-data operators: toxicity, deduplication, quality, PII surrogates,
decontamination, tokenisation, chat formatting and sharding.

Nothing outside this subpackage imports it.
"""
