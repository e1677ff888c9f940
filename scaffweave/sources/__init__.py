"""File formats as DataFrames. Every record has its file and its place in it (`ord`)."""
