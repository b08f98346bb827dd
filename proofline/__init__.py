"""Set-oriented verification of label readings against filings, on Spark DataFrames."""
