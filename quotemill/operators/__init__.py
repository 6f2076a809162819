"""DataFrame operators: staging, quality checks, KPIs, alerts, search, forecast."""
