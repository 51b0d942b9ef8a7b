"""intervalia: time-series segmentation, interval analytics and corpus preparation on Spark."""
