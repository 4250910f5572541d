"""quarrylens: forensic-triage analytics on Spark DataFrames."""
