"""corpuslens: document-fidelity analytics and corpus preparation on Spark DataFrames."""
