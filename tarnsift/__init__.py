"""tarnsift: Spark-native evidence analytics (DataFrame in, DataFrame out)."""
