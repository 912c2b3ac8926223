"""linkloom: Spark-native analytics over large collections of saved web links."""

__version__ = "0.1.0"
