"""cairn: Spark-native analytics over code metrics, code graphs, episodes and text corpora."""
