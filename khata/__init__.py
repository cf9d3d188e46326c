"""khata: GST invoice-audit operators for PySpark DataFrames."""
