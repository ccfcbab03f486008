"""Training-data pipeline operators. Nothing else in docproof imports this subpackage."""
