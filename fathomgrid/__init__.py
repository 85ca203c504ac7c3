"""A Spark-native engine for panel forecasting: panels, point-in-time features, model fits, backtests and their statistics."""
