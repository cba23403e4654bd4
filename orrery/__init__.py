"""orrery: equi-joins over key/payload relations and iterative graph analytics, declared on Spark DataFrames."""
