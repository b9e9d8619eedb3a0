"""DataFrame operators: parsing, windows, models, similarity, alerts and reports."""
