"""placetrail: visual revisit analytics and frame/text data preparation on Spark."""
