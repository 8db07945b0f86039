"""Quality checks of data packages, as Spark DataFrames."""
