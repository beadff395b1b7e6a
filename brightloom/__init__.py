"""brightloom: measurement and group-comparison analytics as Spark DataFrame operators."""
