"""Panel forecasting evaluation on Spark."""
