"""stratamill: parameter-search and backtest analytics written as Spark jobs."""
