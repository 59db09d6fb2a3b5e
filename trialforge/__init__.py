"""Event-aligned trial analytics and rule discovery on PySpark DataFrames."""
