"""sparkveil: detection, masking and audit of personal data in text, on Spark DataFrames."""
