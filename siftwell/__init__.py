"""siftwell: messy tables into trusted, explainable data, on Spark."""
