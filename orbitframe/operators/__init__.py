"""DataFrame operators: joins, aggregations, models and generators."""
