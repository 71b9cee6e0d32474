"""fjordframe: Spark-native analytics for weighted time series, free-energy grids and structures."""
