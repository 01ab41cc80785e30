"""Log-count anomaly analytics on Spark: counting, baselines, judging, review, linking and evaluation."""
