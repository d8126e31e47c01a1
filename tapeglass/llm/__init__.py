"""Training-data operators: packing, tokenising, language ID, near-duplicates,
extraction, sharding and quality rules, each as a Spark job.

Nothing outside this subpackage imports it.
"""
