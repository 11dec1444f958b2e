"""Training-data operators: filters, duplicate removal, tokens and packing on Spark."""
