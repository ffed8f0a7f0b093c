"""DataFrame -> DataFrame operators: cleaning, linking, aggregates, ranking, series, forecasts, risk,
outliers, lead times and similarity."""
