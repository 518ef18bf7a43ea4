"""DataFrame operators: cleaning, joins, panels, windows, sets, verification, models, checks."""
