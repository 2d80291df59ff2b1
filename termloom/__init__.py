"""termloom: terminology standardisation as Spark DataFrame transformations."""
