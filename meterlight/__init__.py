"""Usage analytics over coding-agent transcripts, as Spark DataFrame functions."""
