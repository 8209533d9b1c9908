"""tickloom: market-bar features, labels, alignment and model scoring on Spark."""
