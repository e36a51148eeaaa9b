"""Where tables come from: CSV files, the derived campaign table, shared scratch space."""
