"""quillstone: filing analytics and text-corpus processing on PySpark DataFrames."""
