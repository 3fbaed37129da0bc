"""Legacy-text analytics and corpus preparation as DataFrame operations on Spark."""
