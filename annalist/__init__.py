"""annalist: a Spark-native engine over the recorded history of software projects."""
