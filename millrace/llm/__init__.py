"""Training-data pipeline operators.

Ten operators over document tables: secret scan, near-duplicate detection, benchmark
decontamination, substring deduplication, language-model scoring, sharding, media columns,
sequence packing, token output and language identification.
"""
