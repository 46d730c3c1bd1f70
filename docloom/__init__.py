"""docloom: declarative document queries and training-data operators on Spark."""
