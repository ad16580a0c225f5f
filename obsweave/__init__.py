"""obsweave: harmonize many differently shaped sensor tables into one graph of observations, on Spark."""
