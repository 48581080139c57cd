"""Shop operators: DataFrame in, DataFrame out, over all keys at once."""
