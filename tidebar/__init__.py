"""Market-data analytics on Spark: bars, order flow, indicators, projections, calendars, alerts and archives."""
