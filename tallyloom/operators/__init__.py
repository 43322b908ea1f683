"""Jobs from DataFrames to DataFrames: engagement, catalog, ranking, search, messaging, learning."""
