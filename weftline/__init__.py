"""weftline: entity matching, panel forecasting and batch analytics as DataFrame operators."""

__version__ = "0.1.0"
