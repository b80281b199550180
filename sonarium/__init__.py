"""Evidence fusion, record cleaning and matching on Spark DataFrames."""
