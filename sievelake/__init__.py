"""sievelake: build, filter, deduplicate, decontaminate, sample and score text datasets with Spark DataFrames."""
