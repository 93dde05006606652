"""Analytics on irregular longitudinal data, written as Spark DataFrame plans."""
