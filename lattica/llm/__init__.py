"""Training-data operators: language ID, toxicity, dedup, PII, mixing and so on.

Nothing outside this subpackage imports it.  ``lattica.llm.queries`` holds what
``__spark_entry__`` registers.
"""
