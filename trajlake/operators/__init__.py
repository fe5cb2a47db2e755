"""DataFrame operators: reshaping, filters, joins, selection, metrics, returns and similarity."""
