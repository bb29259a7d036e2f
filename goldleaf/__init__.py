"""goldleaf: master data management and entity resolution on Spark DataFrames."""
