"""nearfold: a Spark-native engine for nearest-neighbour graphs and what is derived from them."""
