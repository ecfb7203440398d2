"""siftlake: multidimensional Bloom filter analytics on Spark DataFrames."""
