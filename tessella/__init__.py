"""Spark-first analytics over image blocks, palettes and transform records."""
