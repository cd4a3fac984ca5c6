"""sparkredact: pseudonymisation and corpus preparation on Spark DataFrames."""
