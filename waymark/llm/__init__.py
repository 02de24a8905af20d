"""Training-data operators: quality, toxicity, tokenisation, URL filters, language, decontamination,
nearest neighbours, near duplicates, token files and line deduplication.

Nothing outside this subpackage imports it.
"""
