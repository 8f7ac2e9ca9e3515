"""loam: text, record and graph analytics written as Spark DataFrame plans."""
