"""Regulus: PySpark table operators for reproducibility analysis of regulatory-genomic signal."""
