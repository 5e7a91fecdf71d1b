"""Training-data operators (ten of them) and the queries that apply them to whole tables."""
