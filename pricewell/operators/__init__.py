"""DataFrame-to-DataFrame operators: filters, joins, groupings, upserts, retention."""
