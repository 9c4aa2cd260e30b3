"""textsieve: text-quality and personal-data analytics on PySpark DataFrames."""
