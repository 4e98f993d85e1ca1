"""Dataset-quality analytics for labelled image collections, expressed as Spark plans."""

__version__ = "0.1.0"
