"""strataplan: Spark-native analytics over vector drawings, and the tables around them."""
