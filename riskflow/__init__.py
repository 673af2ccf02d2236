"""riskflow: card-transaction risk analytics as Spark DataFrame jobs."""
