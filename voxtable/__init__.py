"""voxtable: speech and text corpus preparation and evaluation on Spark DataFrames."""
