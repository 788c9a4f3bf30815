"""Plans over the driver's tables: one query for each operator, with its SQL."""
