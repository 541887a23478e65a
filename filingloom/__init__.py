"""Filing-document analytics on Spark: parsing, sections, chunks, notes and corpus reports as DataFrame operators."""

__version__ = "0.1.0"
