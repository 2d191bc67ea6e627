"""cadenza: Spark-native analytics for voice-command evaluation and text corpora."""
