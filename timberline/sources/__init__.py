"""Readers of training tables: CSV by position, CSV by inference, Parquet."""

from timberline.sources.csv import dataset_summary, load_inferred, load_positional
from timberline.sources.parquet import load_table

__all__ = ["dataset_summary", "load_inferred", "load_positional", "load_table"]
